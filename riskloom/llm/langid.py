"""Language identification with interpolated Kneser-Ney character models.

Characters fold to 64 classes (0 for what is no letter, one per a-z, further
letters by code point, 63 for the edge of a text), so a language has at most
64^3 trigrams: model size and broadcast are bounded by the number of languages
whatever the corpus holds.  Spark counts trigrams over all training texts; the
driver turns the counts into one Kneser-Ney model per language, kept in sorted
arrays of n-gram hashes.  A text takes the language of the lowest cross-entropy
per character.  It is rejected if that entropy lies far above what the
training texts of the language have at that length; the limits are calibrated
on all training texts.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

CLASSES, EDGE, SIZE = 64, 63, 64 ** 3
DISCOUNT = 0.75
#: Standard deviations above the usual entropy at which a text is rejected.
REJECT_AT = 6.0
#: Characters beyond which further text does not make the score surer.
SURE_CHARS = 60
UND = "und"


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            low = ord(low) if len(low) == 1 else cp
            out[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 36
    out[0] = EDGE
    return out


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram codes of all texts; the text of each; whether a text has a letter.
    Runs of non-letters count as one; a text's first trigrams begin at its edge."""
    raw = np.frombuffer(("\0" + "\0".join(texts)).encode("utf-32-le", "surrogatepass"), "<u4")
    c = _classes()[np.minimum(raw, 0x10FFFF)]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
    letters = np.zeros(len(texts), bool)
    letters[owner[(c > 0) & (c < EDGE)]] = True
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c, owner = c[keep].astype(np.int32), owner[keep]
    b = np.concatenate(([EDGE], c[:-1]))
    a = np.concatenate(([EDGE, EDGE], c[:-2]))[:len(c)]
    a = np.where(b == EDGE, EDGE, a)
    scored = c != EDGE
    return (a[scored] << 12) | (b[scored] << 6) | c[scored], owner[scored], letters


def _hash(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.uint32) * np.uint32(0x9E3779B1)       # odd factor: no two codes collide


class SortedHashes:
    """Values by n-gram hash in sorted arrays."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        h = _hash(codes)
        order = np.argsort(h)
        self.keys, self.values = h[order], values[order]

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values and whether they are there."""
        h = _hash(codes)
        at = np.minimum(np.searchsorted(self.keys, h), max(0, len(self.keys) - 1))
        there = self.keys[at] == h if len(self.keys) else np.zeros(len(h), bool)
        return self.values[at] if len(self.keys) else np.zeros((len(h), *self.values.shape[1:])), there


def kneser_ney(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """counts[a, b, c] -> P(c|ab) interpolated, the weight left by context ab, P(c|b)."""
    d = DISCOUNT
    c3 = counts.reshape(CLASSES, CLASSES, CLASSES).astype(float)
    kinds = c3 > 0
    n2 = kinds.sum(0).astype(float)                              # left neighbours of bc
    n1 = (n2 > 0).sum(0).astype(float)                           # left neighbours of c
    p1 = (np.maximum(n1 - d, 0) + d * (n1 > 0).sum() / CLASSES) / max(n1.sum(), 1)
    if not n1.any():
        p1 = np.full(CLASSES, 1 / CLASSES)
    t2 = n2.sum(1, keepdims=True)
    left2 = np.where(t2 > 0, d * (n2 > 0).sum(1, keepdims=True) / np.maximum(t2, 1), 1.0)
    p2 = np.maximum(n2 - d, 0) / np.maximum(t2, 1) + left2 * p1
    t3 = c3.sum(2, keepdims=True)
    left3 = np.where(t3 > 0, d * kinds.sum(2, keepdims=True) / np.maximum(t3, 1), 1.0)
    return np.maximum(c3 - d, 0) / np.maximum(t3, 1) + left3 * p2, left3[:, :, 0], p2


class LanguageModels:
    """Kneser-Ney models of several languages; one column of values for each."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs = langs
        models = [kneser_ney(c) for c in counts]
        seen3 = np.flatnonzero(counts.sum(0))
        ctx = np.unique(seen3 >> 6)
        stack = [np.log2(np.stack([m[i].ravel() for m in models], 1)) for i in range(3)] if langs else [
            np.zeros((n, 0)) for n in (SIZE, CLASSES ** 2, CLASSES ** 2)]
        self.full = SortedHashes(seen3, stack[0][seen3])
        self.left = SortedHashes(ctx, stack[1][ctx])
        self.pair = SortedHashes(np.arange(CLASSES ** 2), stack[2])

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """(codes, languages) log2 P(c|ab), backing off where no language has the trigram."""
        value, there = self.full.get(codes)
        rest = codes[~there]
        if len(rest):
            left, known = self.left.get(rest >> 6)
            value[~there] = self.pair.get(rest & (CLASSES ** 2 - 1))[0] + np.where(known[:, None], left, 0.0)
        return value

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) bits per character; characters; whether there are letters."""
        codes, owner, letters = trigrams(texts)
        n = np.bincount(owner, minlength=len(texts))
        kinds = np.flatnonzero(np.bincount(codes, minlength=1))
        place = np.zeros(SIZE, np.int32)
        place[kinds] = np.arange(len(kinds))
        table, at = self.log2(kinds), place[codes]
        bits = np.stack([np.bincount(owner, weights=table[at, i], minlength=len(texts))
                         for i in range(len(self.langs))], 1) if self.langs else np.zeros((len(texts), 0))
        return -bits / np.maximum(n, 1)[:, None], n, letters


def _pieces(texts: list[str], most: int = 1 << 21) -> Iterator[slice]:
    """Consecutive texts of about `most` characters together (one text is never cut)."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield slice(start, len(texts))


def count_trigrams(rows: DataFrame) -> DataFrame:
    """rows (lang, text) -> (lang, code, n)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()),
                                                  pa.array(c[at], pa.int64())], ["lang", "code", "n"])
            counts.clear()

        for b in batches:
            langs, texts = np.array(b.column(0).to_pylist(), object), b.column(1).to_pylist()
            for s in _pieces(texts):
                codes, owner, _ = trigrams(texts[s])
                own = langs[s][owner] if len(codes) else np.zeros(0, object)
                for lang in set(langs[s]):
                    counts[lang] = counts.get(lang, 0) + np.bincount(codes[own == lang], minlength=SIZE)
                if len(counts) > 32:
                    yield from flush()
        yield from flush()

    return (rows.select("lang", "text").mapInArrow(run, "lang string, code long, n long")
            .groupBy("lang", "code").agg(F.sum("n").alias("n")))


def fit(rows: DataFrame) -> LanguageModels:
    """rows (lang, text), neither null.  At most 64^3 counts per language reach the driver."""
    got = count_trigrams(rows).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.zeros((len(langs), SIZE), np.int64)
    counts[np.searchsorted(langs, got["lang"].to_numpy()) if langs else [], got["code"].to_numpy()] = got["n"].to_numpy()
    return LanguageModels(langs, counts)


def predict(docs: DataFrame, models: LanguageModels, text: Column, keep: dict[str, Column]) -> DataFrame:
    """Columns `keep` plus lang_pred, score, bits (per character) and chars."""
    src = docs.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], text.alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(models)
    out = src.drop("t").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits": F.lit(0.0),
                                     "chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
            pred, score, bits, chars = [], [], [], []
            for s in _pieces(texts):
                h, n, letters = m.entropies(texts[s])
                if not m.langs:
                    letters, h = letters & False, np.zeros((len(n), 1))
                best = h.argmin(1)
                gap = (h - h.min(1, keepdims=True)) * np.minimum(n, SURE_CHARS)[:, None]
                sure = 1 / np.exp2(-np.minimum(gap, 1000)).sum(1)
                pred += [m.langs[i] if ok else UND for i, ok in zip(best, letters)]
                score.append(np.where(letters, sure, 0.0))
                bits.append(np.where(letters, h[np.arange(len(h)), best], 0.0))
                chars.append(n)
            cat = lambda x, kind: pa.array(np.concatenate(x) if x else [], kind)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array(pred, pa.string()), cat(score, pa.float64()), cat(bits, pa.float64()),
                 cat(chars, pa.int64())], [*b.schema.names[:-1], "lang_pred", "score", "bits", "chars"])

    got = src.mapInArrow(run, out)
    return got.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "bits", "chars")


def _limits(learned: DataFrame) -> DataFrame:
    """learned: predict() rows of training texts whose own language was found.
    One row per language: mean entropy, its deviation, and its noise per character."""
    usual = learned.groupBy("lang_pred").agg(F.avg("bits").alias("mean"),
                                             F.coalesce(F.stddev_pop("bits"), F.lit(0.0)).alias("sd"))
    # one row per learned language: as many as the broadcast models have
    noise = learned.join(F.broadcast(usual), "lang_pred").groupBy("lang_pred").agg(
        F.sqrt(F.avg(F.pow(F.col("bits") - F.col("mean"), 2) * F.col("chars"))).alias("noise"))
    return cut_lineage(usual.join(noise, "lang_pred"))


def _with_rejected(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds `rejected`: und, or an entropy above the limit of the language at that length."""
    noise = F.col("noise") / F.sqrt(F.greatest("chars", F.lit(1)))
    # and never below half way to the entropy of characters drawn at random
    half = (F.col("mean") + math.log2(CLASSES)) / 2
    limit = F.greatest(half, F.col("mean") + REJECT_AT * F.greatest("sd", noise))
    return scored.join(F.broadcast(limits), "lang_pred", "left").withColumn(
        "rejected", (F.col("lang_pred") == UND) | F.coalesce(F.col("bits") > limit, F.lit(False)))


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % folds == fold


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 3, fold: int = 1) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score, bits, chars, rejected.

    Learns from documents outside the held-out fold with a text and a language.
    Defined results: `und` with score 0 if the text is null, has no letter or
    nothing could be learned; equal entropies go to the language that sorts
    first; a null id counts as crc32 0; repeated rows stay rows; an empty table
    gives an empty result; other columns are not read.
    """
    away = held_out(docs[id_col], folds, fold)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"),
                       away.alias("held_out"))
    models = fit(rows.filter(~F.col("held_out") & F.col("text").isNotNull() & F.col("lang").isNotNull())
                 .select("lang", "text"))
    scored = cut_lineage(predict(rows, models, F.col("text"),
                                 {c: F.col(c) for c in ("id", "lang", "held_out")}))
    learned = ~F.col("held_out") & (F.col("lang") == F.col("lang_pred")) & (F.col("lang_pred") != UND)
    return _with_rejected(scored, _limits(scored.filter(learned))).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score", "bits",
                                                "chars", "rejected")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    folds: int = 3, fold: int = 1) -> DataFrame:
    """The rows of `docs` that are not rejected, in their columns and without a shuffle of texts."""
    away = held_out(docs[id_col], folds, fold)
    cols = docs.columns
    models = fit(docs.filter(~away & docs[text_col].isNotNull() & docs[lang_col].isNotNull())
                 .select(docs[lang_col].alias("lang"), docs[text_col].alias("text")))
    learned = (predict(docs, models, docs[text_col], {"lang": docs[lang_col], "held_out": away})
               .filter(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")) & (F.col("lang_pred") != UND)))
    limits = _limits(cut_lineage(learned))
    scored = predict(docs, models, docs[text_col], {f"c{i}": docs[c] for i, c in enumerate(cols)})
    return (_with_rejected(scored, limits).filter(~F.col("rejected"))
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
