"""Line dedup over levelled sorted runs of line hashes.

`LineRuns` keeps what earlier batches held: sorted Parquet runs of (line hash,
documents that hold it).  A new batch anti-joins the keys that the runs know to
be frequent already, counts the others, merges nothing else and adds itself as
a run of level 0; `fanout` runs of a level are compacted to one of the next.
The frequent keys are those whose counts over all runs reach the threshold.

All of it is DataFrame operations.  Lines travel as a 96-bit hash (XXH64 and
Murmur3 of the key); texts are shuffled once, to meet the positions of their
dropped lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, cut_lineage, read_table, written

MIN_DOCS = 10
MIN_CHARS = 1
FANOUT = 4
#: More than the fanout: runs are compacted and a later batch meets the compacted run.
BATCHES = FANOUT + 2


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(docs: DataFrame, text_col: str, *keep: str) -> DataFrame:
    """One row per line: `keep`, pos, h1, h2 (null for keys that are too short)."""
    lines = docs.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
                        .alias("pos", "line")).withColumn("key", line_key(F.col("line")))
    return lines.select(*keep, "pos", F.length("key").alias("chars"),
                        F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"))


class LineRuns:
    """Levelled sorted runs of (h1, h2, docs)."""

    def __init__(self, spark: SparkSession, min_docs: int = MIN_DOCS, fanout: int = FANOUT) -> None:
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def _all(self) -> DataFrame | None:
        out = None
        for run in (r for level in self.levels for r in level):
            out = run if out is None else out.unionByName(run)
        return out

    @staticmethod
    def _merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def frequent(self) -> DataFrame | None:
        rows = self._all()
        return None if rows is None else self._merge(rows).filter(F.col("docs") >= self.min_docs).select("h1", "h2")

    def add(self, keys: DataFrame) -> None:
        """keys (h1, h2): one row per document and distinct key of the batch."""
        known = self.frequent()
        if known is not None:
            keys = keys.join(known, ["h1", "h2"], "left_anti")
        run = keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs")).sortWithinPartitions("h1", "h2")
        self._push(0, written(run, "line-run"))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            rows = self.levels[level][0]
            for other in self.levels[level][1:]:
                rows = rows.unionByName(other)
            self.levels[level] = []
            self._push(level + 1, written(self._merge(rows).sortWithinPartitions("h1", "h2"), "line-run"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES,
               fanout: int = FANOUT, text_col: str = "text") -> DataFrame:
    """All rows of `docs` plus _lines (array of the text's lines) and _dropped
    (positions of the lines to drop, from 0, null if none).

    Defined results: a null or empty text is one empty line, whose key is too
    short to count; a line counts once per row that holds it, so repeated rows
    count each; equal texts keep equal lines; an empty table gives an empty result; docs may have any other columns
    (those named _lines or _dropped are replaced).
    """
    cols = docs.columns
    src = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)], docs[text_col].alias("_t"))
    # equal texts drop equal lines: a text's hashes name it
    src = src.withColumn("_u1", F.xxhash64("_t")).withColumn("_u2", F.hash(F.reverse("_t")))
    # distinct keys of a row, by row: the generator keeps a row's lines in one task, so the count needs no shuffle
    keys = src.select("_u1", F.explode(F.array_distinct(F.transform(
        F.filter(F.transform(F.split("_t", "\n", -1), line_key), lambda k: F.length(k) >= min_chars),
        lambda k: F.struct(F.xxhash64(k).alias("h1"), F.hash(k).alias("h2"))))).alias("k")).select(
        F.pmod("_u1", F.lit(batches)).cast("int").alias("batch"), "k.h1", "k.h2")
    stored = written(keys, "line-keys", ["batch"])
    runs = LineRuns(docs.sparkSession, min_docs, fanout)
    for batch in range(batches):
        runs.add(stored.filter(F.col("batch") == batch).select("h1", "h2"))
    frequent = cut_lineage(runs.frequent())
    texts = src.select("_t", "_u1", "_u2")
    hits = (_lines(texts, "_t", "_u1", "_u2").filter(F.col("chars") >= min_chars)
            .join(frequent, ["h1", "h2"], "left_semi")
            .groupBy("_u1", "_u2").agg(F.collect_set("pos").alias("_dropped")))
    return (src.join(hits, ["_u1", "_u2"], "left")
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols) if c not in ("_lines", "_dropped")],
                    F.split(F.coalesce("_t", F.lit("")), "\n", -1).alias("_lines"), "_dropped"))


def kept_text(lines: str = "_lines", dropped: str = "_dropped") -> Column:
    """The lines at positions that are not dropped, in order, joined by newlines."""
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(dropped))
    return F.when(F.col(dropped).isNull(), F.array_join(F.col(lines), "\n")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(F.col(lines), i)), "\n"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = drop_lines(docs)
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"),
                      F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
                      F.sha2(kept_text(), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT rid, doc_id, g.i AS pos, ls[g.i] AS line,
         translate(regexp_replace(ls[g.i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       unnest(range(1, len(ls) + 1)) AS g(i)),
f AS (SELECT k FROM l WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY rid, doc_id
"""
