"""Toxicity from class-conditional Kneser-Ney models.

An expression is a word or, where the word is rare, its stem (the first 6, 5 or
4 letters).  At each length the class is the context of a Kneser-Ney model:

    P(e | class) = max(c(class, e) - D, 0) / c(class) + D * kinds(class) / c(class) * P_shared(e)
    P_shared(e)  = classes that hold e / sum of that over all expressions

c(class, e) counts the labelled texts of a class that hold e, equal texts once,
so that neither a long text nor a group of copies makes an expression.  Rare
expressions take shared counts in both models: one that fewer than MIN_TEXTS
texts hold, or whose counts differ from the classes' usual share by less than
MIN_DEVIATION standard deviations, backs off to the next stem and at last to
what both classes share.  What is shared cancels when the two log-likelihoods
are compared, so only expressions with counts of their own are kept, with
log P(e | toxic) - log P(e | ordinary).

A text's feature is its log-likelihood difference, normalised by its length
and by the root of its length; a logistic calibration, fitted on labelled texts
that the models have not seen, turns it into a score.

Counting runs in Spark over a sample of at most MAX_LABELLED distinct labelled
texts; that bounds the models, which are broadcast, and the calibration rows,
which reach the driver as three numbers each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, cut_lineage, read_table
from .langid import held_out

MAX_LABELLED = 200_000
DISCOUNT = 0.75
STEMS = (0, 6, 5, 4)                                             # 0: the whole word
MIN_TEXTS = 4
MIN_DEVIATION = 6.0
CALIBRATE = 4                                                    # one labelled text in so many calibrates
THRESHOLD = 0.5
_WORD = re.compile(r"\w+")
_MEMO = 400_000


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _stem(word: str, length: int) -> str:
    return word[:length] if length else word


def count_expressions(rows: DataFrame) -> DataFrame:
    """rows (text, y) -> (length, e, n0, n1): ordinary and toxic texts that hold the expression."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], list[int]] = {}

        def flush() -> pa.RecordBatch:
            keys, both = list(counts), list(counts.values())
            counts.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()),
                 pa.array([b[0] for b in both], pa.int64()), pa.array([b[1] for b in both], pa.int64())],
                ["length", "e", "n0", "n1"])

        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held = set(words(text))
                for length in STEMS:
                    for e in {_stem(w, length) for w in held}:
                        counts.setdefault((length, e), [0, 0])[y] += 1
                if len(counts) > _MEMO:
                    yield flush()
        yield flush()

    return (rows.select("text", F.col("y").cast("int").alias("y")).mapInArrow(run, "length int, e string, n0 long, n1 long")
            .groupBy("length", "e").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))


def expression_ratios(counts: DataFrame, min_texts: int = MIN_TEXTS, min_deviation: float = MIN_DEVIATION) -> DataFrame:
    """(length, e, ratio) of the expressions that have counts of their own."""
    d = F.lit(DISCOUNT)
    kinds = (F.col("n0") > 0).cast("long") + (F.col("n1") > 0).cast("long")
    # one row per stem length
    totals = counts.groupBy("length").agg(
        F.sum("n0").alias("c0"), F.sum("n1").alias("c1"), F.sum(kinds).alias("kinds"),
        F.sum((F.col("n0") > 0).cast("long")).alias("k0"), F.sum((F.col("n1") > 0).cast("long")).alias("k1"))
    rows = counts.filter(F.col("n0") + F.col("n1") >= min_texts).join(F.broadcast(totals), "length")
    share = F.col("c1") / (F.col("c0") + F.col("c1"))
    usual = (F.col("n0") + F.col("n1")) * share
    rows = rows.filter((F.col("c0") > 0) & (F.col("c1") > 0)
                       & (F.abs(F.col("n1") - usual) >= min_deviation * F.sqrt(usual * (1 - share))))

    def p(y: int) -> Column:
        n, c, k = F.col(f"n{y}"), F.col(f"c{y}"), F.col(f"k{y}")
        return F.greatest(n - d, F.lit(0.0)) / c + d * k / c * kinds / F.col("kinds")

    return rows.select("length", "e", (F.log(p(1)) - F.log(p(0))).alias("ratio"))


class ToxicityModels:
    """Log-likelihood differences of expressions by stem length, and the calibration's weights."""

    def __init__(self, lengths: list[int], expressions: list[str], ratios: list[float]) -> None:
        self.ratios: dict[int, dict[str, float]] = {n: {} for n in STEMS}
        for n, e, r in zip(lengths, expressions, ratios):
            self.ratios[n][e] = r
        self.weights = np.zeros(4)
        self.memo: dict[str, float] = {}

    def ratio(self, word: str) -> float:
        """Of the longest expression of a word that has counts of its own; else 0."""
        for length in STEMS:
            r = self.ratios[length].get(_stem(word, length))
            if r is not None:
                return r
        return 0.0

    def difference(self, text: str | None) -> tuple[float, int]:
        """Toxic minus ordinary log-likelihood, what they share left out; words."""
        found = words(text)
        if len(self.memo) > _MEMO:
            self.memo.clear()
        for w in found:
            if w not in self.memo:
                self.memo[w] = self.ratio(w)
        return sum(map(self.memo.__getitem__, found)), len(found)

    def score(self, sums: np.ndarray, lens: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(sums, lens) @ self.weights, -500, 500)))


def features(sums: np.ndarray, lens: np.ndarray) -> np.ndarray:
    n = np.maximum(lens, 1).astype(float)
    return np.stack([np.ones(len(n)), 10 * sums / n, sums / np.sqrt(n), np.log(n) / 5], 1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        w[0] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - penalty * w)
    return w


def _differences(rows: DataFrame, models: ToxicityModels, keep: list[str]) -> DataFrame:
    """rows (*keep, text) -> (*keep, sum, n)."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    src = rows.select(*keep, "text")
    out = src.drop("text").withColumns({"sum": F.lit(0.0), "n": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.difference(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.int64())],
                [*b.schema.names[:-1], "sum", "n"])

    return src.mapInArrow(run, out)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", folds: int = 5, fold: int = 0, max_labelled: int = MAX_LABELLED,
                    min_texts: int = MIN_TEXTS, min_deviation: float = MIN_DEVIATION) -> DataFrame:
    """One row per document: id, held_out, log_ratio (toxic minus ordinary
    log-likelihood), n_words, score (0 to 1), predicted.

    Defined results: a null or empty text has ratio 0 and is scored like any
    other; a null id counts as crc32 0, so as held out; labels that are null,
    other than 0 and 1, of unknown ids or that contradict each other (also on
    equal texts) are not learned from; without a label, or with one class only,
    all rows get the smoothed rate of label 1; repeated rows stay rows and are
    counted once; an empty table gives an empty result; other columns are not
    read.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"),
                      held_out(docs[id_col], folds, fold).alias("held_out"))
    marks = (labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).filter("id is not null and y in (0, 1)")
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top"))
    # one id for each distinct labelled text; no text moves
    texts = (src.filter(~F.col("held_out")).select("id", F.xxhash64("text").alias("h"), F.hash("text").alias("h2"))
             .join(marks, "id").groupBy("h", "h2").agg(F.min("id").alias("id"), F.min("y").alias("y"), F.max("y").alias("top"))
             .filter("y = top").select("id", "y"))
    chosen = cut_lineage(bounded_sample(texts, "id", max_labelled))
    # at most max_labelled rows of (id, y)
    known = src.join(F.broadcast(chosen), "id").dropDuplicates(["id"])
    apart = F.floor(F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(0)) / folds) % CALIBRATE == 0
    counts = count_expressions(known.filter(~apart))
    kept = expression_ratios(cut_lineage(counts), min_texts, min_deviation).toPandas()
    models = ToxicityModels(kept["length"].tolist(), kept["e"].tolist(), kept["ratio"].tolist())
    seen = _differences(known.filter(apart), models, ["id", "y"]).select("sum", "n", "y", "id").toPandas().sort_values("id")
    y = seen["y"].to_numpy(float)
    if len(y) and y.min() != y.max():
        models.weights = logistic(features(seen["sum"].to_numpy(float), seen["n"].to_numpy()), y)
    else:
        rate = chosen.agg(F.coalesce(F.sum("y"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("n")).first()
        models.weights[0] = np.log((rate["a"] + 1) / (rate["n"] - rate["a"] + 1))
    models.memo.clear()
    shared = spark.sparkContext.broadcast(models)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.score(b.column("sum").to_numpy(), b.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, "score"])

    scored = _differences(src, models, ["id", "held_out"])
    return scored.mapInArrow(finish, scored.withColumn("score", F.lit(0.0)).schema).select(
        F.col("id").alias(id_col), "held_out", F.col("sum").alias("log_ratio"), F.col("n").alias("n_words"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                           read_table(spark, sf_dir, "labels"))
