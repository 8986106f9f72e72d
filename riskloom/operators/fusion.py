"""Weighted soft vote, F1-optimal threshold, threshold predict, and
the stacking helpers.  Statistics are aggregates; weights and thresholds
reach the rows through scalar subqueries (no collect, no cross join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRID_START, GRID_STEP, GRID_POINTS = 0.20, 0.01, 62        # arange(.20, .81, .01): 62 points


def threshold_grid() -> list[float]:
    """The grid as numpy's arange builds it: start + i*((start+step)-start) (trap T16)."""
    delta = (GRID_START + GRID_STEP) - GRID_START
    return [GRID_START + i * delta for i in range(GRID_POINTS)]


def f1_expr(tp: Column, fp: Column, fn: Column) -> Column:
    """F1 with zero division -> 0."""
    den = 2 * tp + fp + fn
    return F.when(den > 0, (2 * tp) / den).otherwise(F.lit(0.0))


def vote_weights(df: DataFrame, prob_cols: list[str], label_col: str = "label") -> DataFrame:
    """One row per model: (model, f1, weight); predict = p > 0.5 (argmax);
    all-zero F1 -> equal weights.  One aggregate over the validation rows."""
    y = F.col(label_col) == 1
    aggs = []
    for m in prob_cols:
        p = F.col(m) > 0.5
        aggs += [F.count_if(p & y).alias(f"{m}__tp"), F.count_if(p & ~y).alias(f"{m}__fp"),
                 F.count_if(~p & y).alias(f"{m}__fn")]
    s = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(m).alias("model"),
                              f1_expr(F.col(f"{m}__tp"), F.col(f"{m}__fp"), F.col(f"{m}__fn")).alias("f1"))
                     for m in prob_cols])
    out = s.select(F.inline(rows))
    tot = F.sum("f1").over(Window.partitionBy(F.lit(1)))   # one row per model: bounded
    return out.select("model", "f1", F.when(tot > 0, F.col("f1") / tot)
                      .otherwise(F.lit(1.0 / len(prob_cols))).alias("weight"))


def fitted_weights(weights: DataFrame) -> dict[str, float]:
    """The fitted vote weights as constants (one small row per model)."""
    return {r["model"]: r["weight"] for r in weights.collect()}


def soft_vote(df: DataFrame, prob_cols: list[str], weights=None, out_col: str = "soft_vote") -> DataFrame:
    """sum_m w_m p_m with weights renormalised; no weights -> mean.
    `weights` is a fitted dict or the lazy weights table (scalar subquery)."""
    if weights is None:
        return df.withColumn(out_col, sum(F.col(m) for m in prob_cols) / len(prob_cols))
    if isinstance(weights, dict):
        total = sum(weights[m] for m in prob_cols)
        return df.withColumn(out_col, sum(F.col(m) * F.lit(weights[m]) for m in prob_cols) / F.lit(total))
    return soft_vote(df, prob_cols, fitted_weights(weights), out_col)


def optimal_threshold(df: DataFrame, prob_col: str, label_col: str = "label") -> DataFrame:
    """F1-optimal threshold on the 62-point grid; first maximum wins.
    Each score is bucketed once (number of grid points <= p), counts are
    grouped by bucket (<= 63 groups), and cumulative sums over that tiny table
    give tp/fp for every threshold.  Not a rows x grid cross join."""
    grid = threshold_grid()
    garr = F.array(*[F.lit(g) for g in grid])
    b = df.select(F.size(F.filter(garr, lambda t: t <= F.col(prob_col))).alias("k"),
                  (F.col(label_col) == 1).cast("long").alias("pos"))
    counts = b.groupBy("k").agg(F.sum("pos").alias("pos"), F.sum(1 - F.col("pos")).alias("neg"))
    # dense bucket table 0..62 (equi-join with a 63-row range; bounded size)
    ks = df.sparkSession.range(GRID_POINTS + 1).select(F.col("id").cast("int").alias("k"))
    dense = ks.join(counts, "k", "left").na.fill(0, ["pos", "neg"])
    # tp(i) = positives in buckets k >= i+1: a descending running sum over 63 rows
    w_desc = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    w_all = Window.partitionBy(F.lit(1))
    cum = dense.select("k", F.sum("pos").over(w_desc).alias("tp"), F.sum("neg").over(w_desc).alias("fp"),
                       F.sum("pos").over(w_all).alias("P"))
    per = cum.where(F.col("k") >= 1)
    f1 = f1_expr(F.col("tp"), F.col("fp"), F.col("P") - F.col("tp"))
    thr = F.element_at(garr, F.col("k"))          # threshold index i = k-1 (1-based element k)
    return (per.select(thr.alias("threshold"), f1.alias("f1"))
            .orderBy(F.col("f1").desc(), F.col("threshold")).limit(1))


def threshold_predict(df: DataFrame, prob_col: str, threshold, out_col: str = "pred") -> DataFrame:
    """1 when p >= threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return df.withColumn(out_col, (F.col(prob_col) >= t).cast("int"))
