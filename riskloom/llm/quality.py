"""Quality scores from histogram gradient-boosted trees over text statistics.

Spark computes the statistics of every text and scores them; the trees are
fitted on at most MAX_LABELLED labelled rows (those with the smallest hash of
their id), which bounds what the driver holds whatever the corpus.  A fitted
model is a few flat arrays; scoring walks all rows of a batch down a tree at
once with numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read_table
from .langid import held_out

MAX_LABELLED = 40_000
TREES, DEPTH, BINS, RATE, L2, MIN_ROWS = 80, 4, 64, 0.15, 1.0, 10
THRESHOLD = 0.7
STATISTICS = ("log_chars", "log_words", "word_length", "word_length_sd", "alpha", "digit", "upper", "space", "mark",
              "symbol", "pipe", "bang", "words_upper", "words_symbol_end", "words_title", "unique_words", "top_word",
              "repeated_pairs", "log_lines", "repeated_lines", "words_per_line", "words_per_stop", "entropy",
              "long_words")


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of a text, all finite; an empty or null text has zeros."""
    t = text or ""
    words = t.split()
    if not words:
        return [float(np.log1p(len(t)))] + [0.0] * (len(STATISTICS) - 1)
    n, m = len(t), len(words)
    cp = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    small = np.bincount(np.minimum(cp, 255), minlength=256)
    upper = int(small[65:91].sum())
    digit, space = int(small[48:58].sum()), int(small[9:14].sum() + small[32])
    marks = int(small[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum())
    alpha = upper + int(small[97:123].sum() + small[192:].sum())
    lengths = np.fromiter(map(len, words), np.int64, m)
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in t.split("\n") if x.strip()]
    share = small[small > 0] / n
    stops = max(1, int(small[[33, 46, 63]].sum()))
    return [float(np.log1p(n)), float(np.log1p(m)), lengths.mean(), lengths.std(), alpha / n, digit / n, upper / n,
            space / n, marks / n, (n - alpha - digit - space - marks) / n, int(small[124]) / n, int(small[33]) / n,
            sum(w.isupper() and len(w) > 1 for w in words) / m,
            sum(not (w[-1].isalnum() or w[-1] in ".,;:!?'\")") for w in words) / m,
            sum(w.istitle() for w in words) / m, len(counts) / m, max(counts.values()) / m,
            1 - pairs / max(1, m - 1) if m > 1 else 0.0, float(np.log1p(len(lines))),
            1 - len(set(lines)) / max(1, len(lines)), m / max(1, len(lines)), m / stops,
            float(-(share * np.log2(share)).sum()), float((lengths > 20).mean())]


class BoostedTrees:
    """Logistic loss, second-order leaves, complete trees of one depth in flat arrays."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rows, cols = x.shape
        self.base = 0.0
        self.feature = np.zeros((TREES, 2 ** DEPTH - 1), np.int32)
        self.cut = np.full((TREES, 2 ** DEPTH - 1), np.inf)
        self.leaf = np.zeros((TREES, 2 ** DEPTH))
        if not rows or y.min() == y.max():
            rate = (y.sum() + 1) / (rows + 2)
            self.base = float(np.log(rate / (1 - rate)))
            return self
        self.base = float(np.log(y.mean() / (1 - y.mean())))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(cols)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        flat = binned + np.arange(cols) * BINS
        raw = np.full(rows, self.base)
        for t in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h, node = y - p, p * (1 - p), np.zeros(rows, np.int64)
            for level in range(DEPTH):
                width, first = 2 ** level, 2 ** level - 1
                at = (node[:, None] * (cols * BINS) + flat).ravel()
                hist = [np.bincount(at, np.repeat(v, cols), width * cols * BINS).reshape(width, cols, BINS).cumsum(2)
                        for v in (g, h, np.ones(rows))]
                gl, hl, nl = hist
                gt, ht, nt = (v[:, :, -1:] for v in hist)
                gain = gl ** 2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt ** 2 / (ht + L2)
                gain[(nl < MIN_ROWS) | (nt - nl < MIN_ROWS)] = 0
                for j, e in enumerate(edges):
                    gain[:, j, len(e):] = 0
                best = gain.reshape(width, -1).argmax(1)
                ok = gain.reshape(width, -1).max(1) > 1e-9
                f, b = best // BINS, best % BINS
                self.feature[t, first:first + width] = f
                self.cut[t, first:first + width] = [edges[j][k] if good else np.inf for j, k, good in zip(f, b, ok)]
                right = np.where(ok[node], binned[np.arange(rows), f[node]] > b[node], False)
                node = node * 2 + right
            gs, hs = (np.bincount(node, v, 2 ** DEPTH) for v in (g, h))
            self.leaf[t] = RATE * gs / (hs + L2)
            raw += self.leaf[t][node]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        raw, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            raw += leaf[node - (2 ** DEPTH - 1)]
        return 1 / (1 + np.exp(-raw))


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], ["id", "stats"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return src.mapInArrow(run, src.select("id").withColumn("stats", F.array(F.lit(0.0))).schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_col: str = "quality", folds: int = 4, fold: int = 2,
                   max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted.

    Defined results: a null or empty text is scored like any other; labels that
    are null, other than 0 and 1, of unknown ids or that contradict each other
    are not learned from; with no label, or one class only, all rows get the
    smoothed rate of label 1; repeated rows stay rows; an empty table gives an
    empty result; other columns are not read.
    """
    stats = cut_lineage(with_statistics(docs, id_col, text_col).withColumn("held_out", held_out(F.col("id"), folds, fold)))
    marks = (labels.select(labels[id_col].alias("id"), labels[label_col].alias("y")).filter("y in (0, 1)")
             .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("top")).filter("y = top").drop("top"))
    known = (stats.filter(~F.col("held_out")).join(marks, "id")
             .withColumn("order", F.xxhash64("id", "stats")).orderBy("order", "id").limit(max_labelled)
             .select("stats", "y").toPandas())
    x = np.array(known["stats"].tolist(), float).reshape(len(known), len(STATISTICS))
    shared = docs.sparkSession.sparkContext.broadcast(BoostedTrees().fit(x, known["y"].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("stats").to_pylist(), float).reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("held_out"), pa.array(shared.value.score(x))],
                                             ["id", "held_out", "score"])

    out = stats.drop("stats").withColumn("score", F.lit(0.0)).schema
    return stats.select("id", "stats", "held_out").mapInArrow(run, out).select(
        F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents").select("doc_id", "text"),
                          read_table(spark, sf_dir, "labels"))
