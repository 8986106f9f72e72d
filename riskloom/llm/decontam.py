"""Benchmark decontamination by latent semantic retrieval.

1. Benchmark items are worked through in blocks of at most BLOCK_ITEMS; a
   block's words are the vocabulary, with document frequencies counted over all
   documents.  Its terms are the words found in at most TERM_SHARE of the
   documents and, whatever their frequency, the rarest ones of each item and
   of each part of an item longer than a passage.
2. A randomised SVD of the TF-IDF passages of all documents and of the block's
   items gives a latent basis.  Passages with the same terms are counted once
   with their number, before and after the shuffle; Spark multiplies by them, the
   driver holds vocabulary x rank matrices.  The items together weigh as much as
   all passages together, at any size, so the basis spans them.
3. Every document is searched for passages, of two lengths from each of its
   terms on, whose latent cosine with an item or with a part of a long item
   reaches MIN_COSINE.
4. A candidate counts if the longest common subsequence of words covers
   MIN_COVERED of the item within a stretch of about its length, and if most of
   the item's answer words (its rarest ones) are in that stretch.

Documents are read where they lie: no text is shuffled.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written

RANK, OVERSAMPLE, POWER = 256, 8, 1
BLOCK_ITEMS = 256
TERM_SHARE, LEAST_TERMS = 0.01, 8
MIN_WORDS = 5
#: Words per passage; documents are fitted in passages of the longer one.
LENGTHS = (24, 64)
#: Words from one part of a long item to the next (parts are as long as the longer passage).
STEP = 32
MIN_COSINE = 0.4
MIN_COVERED = 0.7
ANSWER_SHARE, ANSWER_FOUND = 0.25, 0.6
#: Terms looked at together, passages multiplied together (both stay in the processor's cache), words searched together.
_HITS, _ROWS, _WORDS = 512, 256, 1 << 17
#: Different passages that a task counts before it hands the counts on.
_COUNTED = 200_000

_TABLE = bytes.maketrans(string.ascii_uppercase.encode() + string.punctuation.encode(),
                         string.ascii_lowercase.encode() + b" " * len(string.punctuation))


def words(text: str | None) -> list[bytes]:
    """Words in ASCII lower case, split at white space and ASCII punctuation."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := at.get(x):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def parts_of(item: list) -> list[list]:
    """The item and, if it is longer than a passage, its overlapping parts."""
    n = LENGTHS[-1]
    if len(item) <= n:
        return [item]
    return [item, *(item[at:at + n] for at in (*range(0, len(item) - n, STEP), len(item) - n))]


class Block:
    """Some benchmark items with their latent space."""

    def __init__(self, items: list[tuple[int, list[bytes]]]) -> None:
        self.ids = [i for i, _ in items]
        self.items = [w for _, w in items]
        self.vocab = {w: i + 1 for i, w in enumerate(sorted({w for x in self.items for w in x}))}   # 0: any other word
        self.coded = [self.codes(w).tolist() for w in self.items]
        self.bags = [np.bincount(c) for c in self.coded]

    def weigh(self, found: dict[int, int], docs: int) -> None:
        df = np.zeros(len(self.vocab) + 1)
        df[list(found)] = list(found.values())
        idf = np.log((1 + docs) / (1 + df)) + 1
        rarest = [sorted(set(w), key=lambda x: (-idf[self.vocab[x]], x)) for w in self.items]
        indexed = [sorted(set(w), key=lambda x: (-idf[self.vocab[x]], x)) for item in self.items for w in parts_of(item)]
        self.answers = [x[:max(2, math.ceil(ANSWER_SHARE * len(x)))] for x in rarest]
        term = df <= TERM_SHARE * docs
        term[[self.vocab[w] for x in indexed for w in x[:LEAST_TERMS]]] = True
        self.weight = np.where(term, idf, 0.0)
        self.weight[0] = 0
        # fewer terms than this in a passage cannot cover enough of any item
        self.least = min(3, *(math.ceil(MIN_COVERED * min(len(x), LEAST_TERMS)) for x in indexed))

    def codes(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocab.get, tokens, repeat(0)), np.int64, len(tokens))

    def set_basis(self, basis: np.ndarray) -> None:
        self.project = (self.weight[:, None] * basis).astype(np.float32)
        indexed = [(i, w) for i, item in enumerate(self.items) for w in parts_of(item)]
        self.owner = [i for i, _ in indexed]
        z = np.stack([self.project[self.codes(w)].sum(0) for _, w in indexed])
        self.latent = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)).T

    def candidates(self, codes: np.ndarray) -> dict[int, list[tuple[int, int, float]]]:
        """item place -> (first word, end, cosine) of the passages close to it."""
        out: dict[int, list[tuple[int, int, float]]] = {}
        hits = np.flatnonzero(self.weight[codes])
        for at in range(0, len(hits), _HITS):
            own = hits[at:at + _HITS]
            reach = hits[at:np.searchsorted(hits, own[-1] + max(LENGTHS))]
            total = np.concatenate((np.zeros((1, self.project.shape[1])),
                                    np.cumsum(self.project[codes[reach]], axis=0, dtype=np.float64)))
            for length in LENGTHS:
                last = np.searchsorted(reach, own + length)
                some = np.flatnonzero(last - np.arange(len(own)) >= self.least)
                z = (total[last[some]] - total[some]).astype(np.float32)
                z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
                cosine = z @ self.latent
                for p, i in zip(*np.nonzero(cosine >= MIN_COSINE)):
                    first = int(own[some[p]])
                    out.setdefault(self.owner[i], []).append((first, min(len(codes), first + length), float(cosine[p, i])))
        return out

    def search(self, texts: Iterable[str | None]) -> Iterator[list[tuple[int, float, float, int, int]]]:
        """For each text the (item id, cosine, covered, first word, end) of the items that it holds."""
        group, size = [], 0
        for t in texts:
            group.append(words(t))
            size += len(group[-1])
            if size >= _WORDS:
                yield from self._found(group)
                group, size = [], 0
        if group:
            yield from self._found(group)

    def _found(self, texts: list[list[bytes]]) -> Iterator[list[tuple[int, float, float, int, int]]]:
        codes = [self.codes(w) for w in texts]
        gap = np.zeros(max(LENGTHS), np.int64)                   # no passage reaches into the next text
        starts = np.cumsum([0, *(len(c) + len(gap) for c in codes)])
        close: list[dict[int, list[tuple[int, int, float]]]] = [{} for _ in texts]
        for i, passages in self.candidates(np.concatenate([x for c in codes for x in (c, gap)])).items():
            text = np.searchsorted(starts, [p[0] for p in passages], "right") - 1
            for (first, end, cosine), t in zip(passages, text.tolist()):
                at = int(starts[t])
                close[t].setdefault(i, []).append((first - at, min(len(codes[t]), end - at), cosine))
        for tokens, own, passages in zip(texts, codes, close):
            yield self._checked(tokens, own, passages)

    def _checked(self, tokens: list[bytes], codes: np.ndarray, close: dict) -> list[tuple[int, float, float, int, int]]:
        out = []
        for i, passages in close.items():
            item, best = self.items[i], None
            coded, bag = self.coded[i], self.bags[i]
            tried = set()
            for start, end, cosine in passages:
                middle, reach = (start + end) // 2, max(len(item), (end - start) // 2)
                if len(item) > LENGTHS[-1]:                      # passages near each other share a stretch that holds all of theirs
                    middle, reach = middle // STEP * STEP, reach + STEP
                lo, hi = max(0, middle - reach), min(len(tokens), middle + reach)
                if (lo, hi) in tried:
                    continue
                tried.add((lo, hi))
                near = codes[lo:hi]
                # no subsequence is longer than the words that both have
                if np.minimum(np.bincount(near[near < len(bag)], minlength=len(bag)), bag)[1:].sum() < MIN_COVERED * len(item):
                    continue
                covered = lcs(coded, near.tolist()) / len(item)
                here = set(tokens[lo:hi])
                answer = self.answers[i]
                if covered >= MIN_COVERED and sum(w in here for w in answer) >= ANSWER_FOUND * len(answer):
                    best = max(best or (0,), (covered, cosine, lo, hi))
            if best:
                out.append((self.ids[i], best[1], best[0], best[2], best[3]))
        return sorted(out, key=lambda x: x[0])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_items: int) -> Iterator[Block]:
    rows = benchmark.select(benchmark[id_col].alias("id"), benchmark[text_col].alias("text")).filter(
        "id is not null and text is not null").withColumn("h", F.xxhash64("id", "text"))
    n = max(1, math.ceil(rows.count() / block_items))
    for k in range(n):                                           # one bounded part of the benchmark at a time
        items = [(r.id, words(r.text)) for r in rows.filter(F.pmod("h", F.lit(n)) == k).orderBy("id", "text").collect()]
        if items := [(i, w) for i, w in items if len(w) >= MIN_WORDS]:
            yield Block(items)


def _mapped(rows: DataFrame, each: Callable[[Iterator[list[str]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return rows.select("text").mapInArrow(lambda it: each(b.column(0).to_pylist() for b in it), schema)


def _document_frequencies(texts: DataFrame, block: Block) -> tuple[dict[int, int], int]:
    shared = texts.sparkSession.sparkContext.broadcast(block.vocab)

    def each(batches: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        vocab = shared.value
        known = frozenset(vocab)
        for b in batches:
            n += len(b)
            for t in b:
                seen.update(known.intersection(words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([0, *(vocab[w] for w in seen)], pa.int64()),
                                          pa.array([n, *seen.values()], pa.int64())], ["term", "n"])

    got = _mapped(texts, each, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = {r.term: r.n for r in got}
    return df, df.pop(0, 0)


def _term_bags(codes: np.ndarray, weight: np.ndarray) -> Iterator[bytes]:
    """The terms of each passage that has any, ascending, repeats included."""
    hits = np.flatnonzero(weight[codes])
    if not len(hits):
        return
    passage = hits // LENGTHS[-1]
    terms = codes[hits].astype("<i4")
    order = np.lexsort((terms, passage))
    raw = terms[order].tobytes()
    ends = 4 * np.append(np.flatnonzero(np.diff(passage)) + 1, len(hits))
    first = 0
    for end in ends.tolist():
        yield raw[first:end]
        first = end


def passages(texts: DataFrame, block: Block) -> DataFrame:
    """texts (text) -> (bag, n): the terms of the passages of all texts, how many passages hold just these."""
    shared = texts.sparkSession.sparkContext.broadcast((block.vocab, block.weight))

    def each(batches: Iterator[list[str]]) -> Iterator[pa.RecordBatch]:
        vocab, weight = shared.value
        seen = Counter()

        def counted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())],
                                              ["bag", "n"])

        for b in batches:
            for t in b:
                tokens = words(t)
                seen.update(_term_bags(np.fromiter(map(vocab.get, tokens, repeat(0)), np.int64, len(tokens)), weight))
            if len(seen) > _COUNTED:
                yield counted()
                seen.clear()
        yield counted()

    return _mapped(texts, each, "bag binary, n long").groupBy("bag").agg(F.sum("n").alias("n"))


def _multiplied(bags: list[bytes], times: np.ndarray, weight: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A'A basis for the unit TF-IDF rows A of some passages, each counted `times`."""
    total, basis = np.zeros_like(basis), basis.astype(np.float32)
    for at in range(0, len(bags), _ROWS):
        some = bags[at:at + _ROWS]
        codes = np.frombuffer(b"".join(some), "<i4").astype(np.int64)
        row = np.repeat(np.arange(len(some)), [len(x) // 4 for x in some])
        cell, n = np.unique(row * len(weight) + codes, return_counts=True)
        row, codes = cell // len(weight), cell % len(weight)
        a = weight[codes] * n
        a = (a / np.sqrt(np.bincount(row, a * a))[row]).astype(np.float32)
        z = np.add.reduceat(a[:, None] * basis[codes], np.flatnonzero(np.diff(row, prepend=-1)), axis=0)
        z *= times[at:at + len(some), None].astype(np.float32)
        order = np.argsort(codes, kind="stable")
        firsts = np.flatnonzero(np.diff(codes[order], prepend=-1))
        total[codes[order][firsts]] += np.add.reduceat(a[order, None] * z[row[order]], firsts, axis=0)
    return total


def _products(counted: DataFrame, block: Block, basis: np.ndarray) -> np.ndarray:
    """A'A basis over counted passages: one row per vocabulary word, summed by Spark."""
    shared = counted.sparkSession.sparkContext.broadcast((block.weight, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, q = shared.value
        total = np.zeros_like(q)
        for b in batches:
            total += _multiplied(b.column(0).to_pylist(), b.column(1).to_numpy().astype(np.float64), weight, q)
        at = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(list(total[at]), pa.list_(pa.float64()))],
                                         ["term", "v"])

    add = F.array(*[F.sum(F.get("v", F.lit(i))) for i in range(basis.shape[1])])
    out = np.zeros_like(basis)
    for r in counted.select("bag", "n").mapInArrow(run, "term long, v array<double>").groupBy("term").agg(add.alias("v")).collect():
        out[r.term] = r.v
    return out


def latent_basis(counted: DataFrame, block: Block, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF matrix of counted passages
    and the block's items, by a randomised range finder with POWER extra
    multiplications."""
    items = [bag for w in block.items for bag in _term_bags(block.codes(w), block.weight)]
    mass = (counted.agg(F.sum("n")).first()[0] or 1) / max(1, len(items))

    def times(q: np.ndarray) -> np.ndarray:
        return _products(counted, block, q) + _multiplied(items, np.full(len(items), mass), block.weight, q)

    terms = len(block.vocab) + 1
    q = np.random.default_rng(seed).normal(size=(terms, min(terms, rank + OVERSAMPLE)))
    for _ in range(1 + POWER):
        q = np.linalg.qr(times(q))[0]
    small = q.T @ times(q)                                       # Rayleigh-Ritz on the range found
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return q @ vectors[:, np.argsort(-values)[:rank]]


def _fitted(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str,
            block_items: int) -> Iterator[Block]:
    texts = docs.select(docs[text_col].alias("text"))
    for block in _blocks(benchmark, item_col, item_text, block_items):
        block.weigh(*_document_frequencies(texts, block))
        block.set_basis(latent_basis(written(passages(texts, block), "passages"), block))
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per document and benchmark item found in it: id, item, cosine,
    covered (share of the item's words in the common subsequence), first_word
    and end_word of the stretch.

    Defined results: null texts and ids of items, and items of fewer than
    MIN_WORDS words, take no part; a null or empty text holds nothing; repeated
    documents and items each give their own rows; empty tables give an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, item long, cosine double, covered double, first_word long, end_word long"
    out = spark.createDataFrame([], schema)
    for block in _fitted(docs, benchmark, id_col, text_col, item_col, item_text, block_items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, hits = [], []
                for i, found in enumerate(shared.value.search(t.as_py() for t in b.column(1))):
                    at += [i] * len(found)
                    hits += found
                columns = [pa.array([h[k] for h in hits], x) for k, x in enumerate(
                    (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns],
                                                 ["id", "item", "cosine", "covered", "first_word", "end_word"])

        out = out.unionByName(src.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         item_col: str = "item_id", item_text: str = "text",
                         block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, in their columns; each task filters what it reads."""
    place = docs.columns.index(text_col)
    out = docs
    for block in _fitted(docs, benchmark, id_col, text_col, item_col, item_text, block_items):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                clean = [not found for found in shared.value.search(t.as_py() for t in b.column(place))]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                        read_table(spark, sf_dir, "benchmark"))
