"""Language-model scoring with a probabilistic suffix tree over words.

States are the contexts of up to two words.  A context is a candidate if
training holds it at least MIN_CONTEXT times (one seen once has a gain of 0, so
only the divergence test chooses); it is retained if its own
next-word distribution predicts its training words better than the shorter
context's does, each word left out of the counts that predict it (a divergence
test: the sum of the log ratios must reach MIN_GAIN).  Next-word distributions
are smoothed into those of the next shorter context with a weight that grows as
count ** PRIOR; the empty context is the add-0.1 word distribution.  A token is
scored in its longest retained context.

Everything counted grows with the corpus, so no model is broadcast.  Texts are
tokenised once into blocks (rows of packed integers, written to the shared
folder).  A block asks for the totals of its own n-grams only: it sends packed,
sorted hashes with its counts to hash buckets; a bucket adds them up over all
blocks and answers each block in the order it asked.  What contains a word or a
pair that one block alone holds is counted in that block and not sent.  Spark
shuffles the pieces; numpy works on one block or bucket at a time.  N-grams are
named by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, written
from .langid import _pieces, held_out

ALPHA = 0.1
MIN_CONTEXT = 2
MIN_GAIN = 3.0
PRIOR = 0.8
BLOCK_CHARS = 1 << 23
BUCKET_ROWS = 1 << 20
FOLDS, FOLD = 10, 0
_END = xxhash.xxh64_intdigest(b"")                               # no word is empty
WORDS, PAIRS, GAINS, TRIPLES, GAINS2 = range(5)
#: Counts are sent as integers and answered as 2 * total + (one block alone holds the key), gains are answered by whether they reach MIN_GAIN.
_SENT = {k: np.float64 if k in (GAINS, GAINS2) else np.uint64 for k in range(5)}
_TOLD = {k: np.uint8 if k in (GAINS, GAINS2) else np.uint64 for k in range(5)}

_PIECE = "kind int, bucket int, block long, keys binary, values binary"
_ANSWER = "block long, kind int, bucket int, totals binary, seen long, total double"


def pack(a: np.ndarray) -> bytes:
    """Byte planes of an array, compressed: high bytes that are mostly zero cost little."""
    return zstandard.ZstdCompressor(1).compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes())


def unpack(b: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def token_blocks(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs (id, text, held_out) -> one row per block of whole documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            texts, away = [t or "" for t in b.column(1).to_pylist()], b.column(2).to_numpy(zero_copy_only=False)
            for s in _pieces(texts, block_chars):
                ids = _Ids({b"": 0})
                lists = [[*map(ids.__getitem__, t.encode("utf-8", "surrogatepass").lower().split()), 0] for t in texts[s]]
                lens = np.fromiter(map(len, lists), np.uint32, len(lists))
                tokens = np.fromiter((x for one in lists for x in one), np.uint32, int(lens.sum()))
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
                # small numbers for frequent words, so that they pack well; the end stays 0
                order = np.argsort(-np.bincount(tokens, minlength=len(ids))[1:], kind="stable") + 1
                place = np.zeros(len(ids), np.uint32)
                place[order] = np.arange(1, len(ids), dtype=np.uint32)
                tokens, hashes = place[tokens], hashes[np.concatenate(([0], order))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + n], pa.int64()),
                     pa.ListArray.from_arrays(pa.array([0, len(lens)], pa.int32()), b.column(0).slice(s.start, len(lens))),
                     pa.array([pack(away[s].astype(np.uint8))]), pa.array([pack(lens)]), pa.array([pack(tokens)]),
                     pa.array([pack(hashes)]), pa.array([len(tokens)], pa.int64()), pa.array([len(hashes)], pa.int64())],
                    ["block", "ids", "away", "lens", "tokens", "hashes", "n_tokens", "n_words"])
                n += 1

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text", "held_out").mapInArrow(
        run, f"block long, ids array<{kind}>, away binary, lens binary, tokens binary, hashes binary, "
             "n_tokens long, n_words long")


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _pieces_of(kind: int, block: int, keys: np.ndarray, values: np.ndarray, buckets: int) -> list[tuple]:
    """The keys in ascending order, cut at the bucket limits."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order].astype(_SENT[kind])
    limits = [(i << 64) // buckets for i in range(1, buckets)]
    at = [0, *np.searchsorted(keys, np.array(limits, np.uint64)).tolist(), len(keys)]
    return [(kind, i, block, pack(np.diff(keys[a:b], prepend=np.uint64(0))), pack(values[a:b]))
            for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def _frame(pieces: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(pieces, columns=["kind", "bucket", "block", "keys", "values"])


def exchange(pieces: DataFrame, min_gain: float = MIN_GAIN) -> DataFrame:
    """Adds up each key's values over all blocks and answers every piece."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"]]
        values = np.concatenate([unpack(v, _SENT[key[0]]) for v in rows["values"]])
        ends = np.cumsum([len(k) for k in keys])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(at, values)
        if key[0] in (GAINS, GAINS2):
            told = (totals >= min_gain).astype(np.uint8)
        else:
            told = totals.astype(np.uint64) * np.uint64(2) + (np.bincount(at) == 1).astype(np.uint64)
        back = told[at]
        return pd.DataFrame({
            "block": rows["block"].to_numpy(), "kind": key[0], "bucket": key[1],
            "totals": [pack(x) for x in np.split(back, ends[:-1])],
            "seen": [int((totals > 0).sum())] + [0] * (len(rows) - 1),
            "total": [float(totals.sum())] + [0.0] * (len(rows) - 1)})

    return pieces.groupBy("kind", "bucket").applyInPandas(run, _ANSWER)


class BlockState:
    """A block's tokens with what has been answered so far."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame | None = None, n: float = 0, v: int = 0,
                 min_context: int = MIN_CONTEXT, min_gain: float = MIN_GAIN) -> None:
        self.block, self.ids = int(row["block"]), row["ids"]
        self.lens, self.words = unpack(row["lens"], np.uint32).astype(np.int64), unpack(row["tokens"], np.uint32)
        self.away = unpack(row["away"], np.uint8).astype(bool)
        self.hashes = unpack(row["hashes"], np.uint64)
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        self.train = ~self.away[self.doc]
        self.n, self.v, self.min_context, self.min_gain = n, v, min_context, min_gain
        self.answers = {}
        if answers is not None and len(answers):
            for kind, rows in answers.groupby("kind"):
                self.answers[kind] = np.concatenate([unpack(x, _TOLD[kind]) for x in rows.sort_values("bucket")["totals"]])

    def answer(self, kind: int, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), _TOLD[kind])
        if len(keys):
            out[np.argsort(keys)] = self.answers[kind]
        return out

    @staticmethod
    def _told(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(totals, whether this block alone holds the key) of an answer."""
        return (totals >> np.uint64(1)).astype(float), (totals & np.uint64(1)).astype(bool)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.words[self.train], minlength=len(self.hashes)).astype(float)

    def count_words(self) -> None:
        """c: training count of each local word; p0: the empty context's distribution."""
        self.c, self.word_alone = self._told(self.answer(WORDS, self.hashes))
        self.p0 = (self.c + ALPHA) / (self.n + ALPHA * (self.v + 1))

    def make_pairs(self) -> None:
        """Distinct pairs (context, word) whose context is a candidate."""
        first = np.zeros(len(self.words), bool)
        first[np.cumsum(self.lens) - self.lens] = True
        self.before = np.where(first, 0, np.concatenate(([0], self.words[:-1])))     # a text begins after an end
        self.first = first
        self.in1 = np.flatnonzero(self.c[self.before] >= self.min_context)
        code = self.before[self.in1].astype(np.int64) * len(self.hashes) + self.words[self.in1]
        kinds, self.pair = np.unique(code, return_inverse=True)
        self.pair_context, self.pair_word = kinds // len(self.hashes), kinds % len(self.hashes)
        self.pair_keys = _mix(self.hashes[self.pair_context], self.hashes[self.pair_word])
        self.pair_own = np.bincount(self.pair[self.train[self.in1]], minlength=len(kinds)).astype(float)
        self.pair_sent = ~(self.word_alone[self.pair_context] | self.word_alone[self.pair_word])

    @staticmethod
    def smoothed(count: np.ndarray, context: np.ndarray, shorter: np.ndarray, less: int = 0) -> np.ndarray:
        prior = context ** PRIOR
        return (np.maximum(count - less, 0) + prior * shorter) / (context - less + prior)

    def count_pairs(self) -> None:
        self.pair_count, self.pair_alone = self.pair_own.copy(), ~self.pair_sent
        self.pair_count[self.pair_sent], self.pair_alone[self.pair_sent] = self._told(
            self.answer(PAIRS, self.pair_keys[self.pair_sent]))
        shorter, context = self.p0[self.pair_word], self.c[self.pair_context]
        self.p1 = self.smoothed(self.pair_count, context, shorter)
        loo = self.smoothed(self.pair_count, context, shorter, 1)
        gain = np.bincount(self.pair_context, self.pair_own * np.log(loo / shorter), len(self.hashes))
        self.contexts = np.unique(self.pair_context)
        self.gain, self.gain_sent = gain[self.contexts], ~self.word_alone[self.contexts]

    def make_triples(self) -> None:
        """Distinct (pair as context, word) whose pair is a candidate."""
        place = np.full(len(self.words), -1, np.int64)
        place[self.in1] = self.pair
        last = np.concatenate(([-1], place[:-1]))                # the pair that ends at the word before
        ok = (last >= 0) & ~self.first
        ok[ok] = self.pair_count[last[ok]] >= self.min_context
        self.in2, last = np.flatnonzero(ok), last[ok]
        code = last * len(self.hashes) + self.words[self.in2]
        kinds, self.triple = np.unique(code, return_inverse=True)
        self.triple_context, self.triple_word = kinds // len(self.hashes), kinds % len(self.hashes)
        self.triple_keys = _mix(self.pair_keys[self.triple_context], self.hashes[self.triple_word])
        self.triple_own = np.bincount(self.triple[self.train[self.in2]], minlength=len(kinds)).astype(float)
        # the pair a triple ends with; -1 if its context is no candidate
        self.triple_end = np.full(len(kinds), -1, np.int64)
        self.triple_end[self.triple] = place[self.in2]
        end = self.triple_end
        self.triple_sent = ~(self.pair_alone[self.triple_context] | self.word_alone[self.triple_word])
        self.triple_sent[end >= 0] &= ~self.pair_alone[end[end >= 0]]

    def count_triples(self) -> None:
        self.triple_count = self.triple_own.copy()
        self.triple_count[self.triple_sent] = self._told(self.answer(TRIPLES, self.triple_keys[self.triple_sent]))[0]
        # the shorter context of a triple's token: the pair of the last two words
        at = self.triple_end
        shorter = np.where(at >= 0, self.p1[at] if len(self.p1) else 0.0, self.p0[self.triple_word])
        context = self.pair_count[self.triple_context]
        self.p2 = self.smoothed(self.triple_count, context, shorter)
        loo = self.smoothed(self.triple_count, context, shorter, 1)
        gain = np.bincount(self.triple_context, self.triple_own * np.log(loo / shorter), len(self.pair_keys))
        self.contexts2 = np.unique(self.triple_context)
        self.gain2, self.gain2_sent = gain[self.contexts2], ~self.pair_alone[self.contexts2]

    def _reached(self, kind: int, keys: np.ndarray, own: np.ndarray, sent: np.ndarray) -> np.ndarray:
        reached = own >= self.min_gain
        reached[sent] = self.answer(kind, keys[sent])
        return reached

    def scores(self) -> pd.DataFrame:
        base = np.log10(self.p0)[self.words]
        own = base.copy()
        kept = np.zeros(len(self.hashes), bool)
        kept[self.contexts] = self._reached(GAINS, self.hashes[self.contexts], self.gain, self.gain_sent)
        use = kept[self.before[self.in1]]
        own[self.in1[use]] = np.log10(self.p1[self.pair[use]])
        kept2 = np.zeros(len(self.pair_keys), bool)
        kept2[self.contexts2] = self._reached(GAINS2, self.pair_keys[self.contexts2], self.gain2, self.gain2_sent)
        use = kept2[self.triple_context[self.triple]]
        own[self.in2[use]] = np.log10(self.p2[self.triple[use]])
        size = len(self.lens)
        return pd.DataFrame({
            "id": self.ids, "held_out": self.away, "n_tokens": self.lens,
            "n_known": np.bincount(self.doc, self.c[self.words] > 0, size).astype(np.int64), "train_tokens": int(self.n),
            "base_score": np.bincount(self.doc, base, size), "score": np.bincount(self.doc, own, size)})


@contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Executors delete the shuffle files of every query run inside as soon as it ends (results are written by then).
    Else Spark keeps them as long as it holds the query, and all passes' files lie on disk together."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                folds: int = FOLDS, fold: int = FOLD,
                min_context: int = MIN_CONTEXT, min_gain: float = MIN_GAIN, block_chars: int = BLOCK_CHARS,
                bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score (log10 probabilities).

    Defined results: a null or empty text is its end token alone; a null id
    counts as crc32 0, so as held out; with nothing to learn from every token is
    the one unknown word of probability 1; repeated rows are counted and scored
    each; an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                      held_out(docs[id_col], folds, fold).alias("held_out"))
    with _shuffles_freed(spark):
        blocks = written(token_blocks(src, block_chars), "tokens")
        size = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    b_words, b_grams = int(size["w"]) // bucket_rows + 1, int(size["t"]) // bucket_rows + 1
    n, v = 0.0, 0

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for _, row in f.iterrows():
                s = BlockState(row)
                yield _frame(_pieces_of(WORDS, s.block, s.hashes, s.word_counts(), b_words))

    with _shuffles_freed(spark):
        answers = written(exchange(blocks.mapInPandas(words, _PIECE)), "words")
        total = answers.agg(F.sum("seen").alias("v"), F.sum("total").alias("n")).first()
    n, v = total["n"] or 0.0, total["v"] or 0

    def state(row: pd.DataFrame, got: pd.DataFrame) -> BlockState:
        s = BlockState(row.iloc[0], got, n, v, min_context, min_gain)
        s.count_words()
        s.make_pairs()
        return s

    def pairs(row: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        s = state(row, got)
        return _frame(_pieces_of(PAIRS, s.block, s.pair_keys[s.pair_sent], s.pair_own[s.pair_sent], b_grams))

    def triples(row: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        s = state(row, got)
        s.count_pairs()
        s.make_triples()
        return _frame(_pieces_of(GAINS, s.block, s.hashes[s.contexts[s.gain_sent]], s.gain[s.gain_sent], b_words)
                      + _pieces_of(TRIPLES, s.block, s.triple_keys[s.triple_sent], s.triple_own[s.triple_sent], b_grams))

    def gains(row: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        s = state(row, got)
        s.count_pairs()
        s.make_triples()
        s.count_triples()
        return _frame(_pieces_of(GAINS2, s.block, s.pair_keys[s.contexts2[s.gain2_sent]], s.gain2[s.gain2_sent], b_words))

    def last(row: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        s = state(row, got)
        s.count_pairs()
        s.make_triples()
        s.count_triples()
        return s.scores()

    for step, name in ((pairs, "pairs"), (triples, "triples"), (gains, "gains")):
        asked = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(step, _PIECE)
        with _shuffles_freed(spark):
            answers = answers.unionByName(written(exchange(asked, min_gain), name))
    kind = src.schema["id"].dataType.simpleString()
    return (blocks.groupBy("block").cogroup(answers.groupBy("block"))
            .applyInPandas(last, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                 "base_score double, score double").withColumnRenamed("id", id_col))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
