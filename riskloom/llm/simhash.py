"""SimHash near-duplicates found in BK-trees.

1. Every text becomes a 64-bit fingerprint (Arrow batches, one text at a time).
2. Distinct fingerprints are sharded by exact agreement.  Of n bit blocks two
   fingerprints at r or fewer differing bits agree on at least n - r, so each is
   put into one shard for every choice of n - r blocks (the blocks, its bits
   there).  The first level has n = r + 1.  Members of a shard above
   `shard_rows` are dealt anew, once, by more and smaller blocks that agree on
   more bits, whatever shards they came from: a level writes at most C(n, r)
   rows a fingerprint, whatever the data.  A shard that is still too large at
   the last level is searched as pairs of bounded parts.  No shard is dropped
   or capped.
3. In each shard a BK-tree (children keyed by their Hamming distance to the
   parent) is built while it is searched: only edges within the radius of the
   distance to the node are followed.  A shard returns one edge per fingerprint
   to the smallest fingerprint that its links reach, so links grow with the
   fingerprints and not with their pairs.
4. Shard edges are joined into components over the whole table.

Shard trees reach their queries by shuffle: a broadcast of all trees would grow
with the corpus.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, parts, read_table
from .components import connected_components

SHINGLE_WORDS = 3
MAX_BITS = 3
SHARD_ROWS = 1024
#: Levels stop before a fingerprint would be in more shards than this.
MAX_MASKS = 128
#: Large shards whose names are broadcast (24 bytes each); with more of them Spark chooses the join.
MAX_HOT = 200_000
_ALL = (1 << 64) - 1
_SLICE = 1 << 16


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is 1 if set in over half of the shingles' XXH64."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    digest = xxhash.xxh64_intdigest
    lo, hi = starts[:n].tolist(), ends[min(words, len(found)) - 1:].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _SLICE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(lo[at:at + _SLICE], hi[at:at + _SLICE])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = SHINGLE_WORDS,
                 keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` plus `fp` (long: the fingerprint's bits)."""
    keep = keep if keep is not None else ["doc_id"]
    source = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text_col].alias("t"))
    out = source.drop("t").withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array([_signed(fingerprint(t.as_py(), words)) for t in b.column(b.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], fp], [*b.schema.names[:-1], "fp"])

    got = source.mapInArrow(run, out)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "fp")


class BKTree:
    """Keys are fingerprints; a child hangs at its distance to the parent."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, key: int, radius: int) -> list[int]:
        found, open_ = [], [0] if self.keys else []
        while open_:
            node = open_.pop()
            d = (self.keys[node] ^ key).bit_count()
            if d <= radius:
                found.append(node)
            open_ += [child for edge, child in self.children[node].items() if -radius <= edge - d <= radius]
        return found

    def add(self, key: int) -> None:
        self.keys.append(key)
        self.children.append({})
        node, new = 0, len(self.keys) - 1
        while node != new:
            d = (self.keys[node] ^ key).bit_count()
            node = self.children[node].setdefault(d, new)


def shard_links(keys: list[int], radius: int, asked: list[int] = ()) -> list[tuple[int, int]]:
    """(fingerprint, smallest fingerprint it is linked to) of one shard's distinct
    keys; with `asked`, of the links between those and the keys alone."""
    tree, both = BKTree(), [*keys, *asked]
    up = list(range(len(both)))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, key in enumerate(both):
        if not asked or i >= len(keys):
            for j in tree.within(key, radius):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        if i < len(keys):
            tree.add(key)
    low: dict[int, int] = {}
    for i, key in enumerate(both):
        low[top(i)] = min(low.get(top(i), key), key)
    return [(key, low[top(i)]) for i, key in enumerate(both) if low[top(i)] != key]


def _levels(radius: int) -> list[list[int]]:
    """Masks of agreed bits by level: all choices of n - radius of n bit blocks."""
    out = []
    for n in range(radius + 1, min(64, radius + 8), 2):
        if out and math.comb(n, radius) > MAX_MASKS:
            break
        blocks = [sum(1 << i for i in block.tolist()) for block in np.array_split(range(64), n)]
        out.append([sum(some) for some in itertools.combinations(blocks, n - radius)])
    return out


def links(nodes: DataFrame, radius: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct fingerprints `fp` -> edges (u, v) that connect all pairs at
    `radius` or fewer differing bits."""
    if not 0 <= radius < 64:
        raise ValueError("radius must be from 0 to 63 bits")
    members, ready = nodes.select("fp"), None
    shard, whole = ["mask", "value"], [F.lit(0).alias("cell"), F.lit(False).alias("asked"), "fp"]
    for masks in _levels(radius):
        table = F.array(*[F.lit(_signed(m)).cast("long") for m in masks])
        placed = members.select(F.explode(table).alias("mask"), "fp").withColumn("value", F.expr("fp & mask"))
        sizes = cut_lineage(placed.groupBy(*shard).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        hot = sizes.filter(F.col("n") > shard_rows)
        n_hot = hot.count()
        some = placed.join(sizes.filter(F.col("n") <= shard_rows), shard).select(*shard, *whole)
        ready = some if ready is None else ready.unionByName(some)
        if not n_hot:
            break
        # a few rows each standing for more than shard_rows others; beyond the bound Spark chooses the join
        large = placed.join(F.broadcast(hot) if n_hot <= MAX_HOT else hot, shard)
        members = cut_lineage(large.select("fp").distinct())
    else:
        parts_ = F.ceil(F.col("n") / shard_rows).cast("int")
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        # cell (i, j), i <= j: the tree of part i, asked by part j
        cells = (large.withColumn("parts", parts_).withColumn("own", own)
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
        i, j = F.least("own", "other"), F.greatest("own", "other")
        ready = ready.unionByName(cells.select(*shard, (i * F.col("parts") + j + 1).alias("cell"),
                                               (F.col("own") > F.col("other")).alias("asked"), "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, asked = None, [], []

        def edges() -> pa.RecordBatch:
            got = shard_links(keys, radius, asked)
            return pa.RecordBatch.from_arrays(
                [pa.array([_signed(x[i]) for x in got], pa.int64()) for i in (0, 1)], ["u", "v"])

        for b in batches:
            for m, v, c, ask, fp in zip(*(c.to_pylist() for c in b.columns)):
                if (m, v, c) != now:
                    if len(keys) + len(asked) > 1:
                        yield edges()
                    now, keys, asked = (m, v, c), [], []
                (asked if ask else keys).append(fp & _ALL)
        if len(keys) + len(asked) > 1:
            yield edges()

    return (ready.repartition(parts(nodes.sparkSession), *shard, "cell").sortWithinPartitions(*shard, "cell", "fp")
            .mapInArrow(run, "u long, v long").distinct())


def row_key(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.coalesce(docs[c].cast("string"), F.lit("\0null")) for c in docs.columns])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """One row per document: id_col, fingerprint (16 hex digits), component_id
    (smallest id reachable over links), row_key (hash of the whole row) and
    chosen_key (row_key of the row that stands for the group).

    Defined results: a null or empty text has fingerprint zero and links like
    any other; a null id never names a component unless the whole group has
    none (component_id is null then); repeated rows stay rows; an empty table
    gives an empty result; other columns only enter row_key.
    """
    src = docs.select(docs[id_col].alias("id"), row_key(docs).alias("row_key"), docs[text_col].alias("text"))
    fps = cut_lineage(fingerprints(src, "text", words, ["id", "row_key"]))
    first = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row_key").alias("row_key"))
    nodes = cut_lineage(fps.groupBy("fp").agg(F.min(first).alias("first")))
    labels = connected_components(links(nodes.select("fp"), radius))
    placed = (nodes.join(labels, nodes["fp"] == labels["node"], "left")
              .select("fp", "first", F.coalesce("label", "fp").alias("label")))
    chosen = placed.groupBy("label").agg(F.min("first").alias("chosen"))
    by_fp = cut_lineage(placed.join(chosen, "label").select("fp", "chosen"))
    return fps.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("chosen.id").alias("component_id"), "row_key", F.col("chosen.row_key").alias("chosen_key"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """The documents with one of each near-duplicate group left: the smallest
    id (a null id only if the group has no other); of rows that are equal in
    every column one stays."""
    cols = docs.columns
    members = near_duplicates(docs, id_col, text_col, words, radius)
    stay = (members.filter(F.col(id_col).eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("chosen_key")))
            .groupBy(F.col(id_col).alias("id"), "row_key").agg(F.count(F.lit(1)).alias("copies")))
    stay = cut_lineage(stay)
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)], docs[id_col].alias("own_id"),
                      row_key(docs).alias("own_key"))
    kept = src.join(stay, src["own_id"].eqNullSafe(stay["id"]) & (src["own_key"] == stay["row_key"]))
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]
    return (kept.filter("copies = 1").select(*back)
            .unionByName(kept.filter("copies > 1").select(*back).distinct()))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
