"""Multivariate chained imputation on Spark ML.

Round 0 fills every missing cell with the column mean (one aggregate, fitted
once).  Each later round regresses every incomplete column (ascending missing
count, complete columns skipped) on all other columns with a random forest
fitted on the rows where it was observed, and predicts the rows where it was
missing.  Observed cells never change.  Stops when the largest change is below
tol x the largest observed magnitude, or after max_iter rounds; every round
cuts lineage with a reliable checkpoint."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def missing_counts(df: DataFrame, cols: list[str]) -> dict:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def mean_start(df: DataFrame, cols: list[str]) -> DataFrame:
    """Missing -> column mean; `_m_<c>` flags remember which cells were missing."""
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return df.select("*", *[F.col(c).isNull().alias(f"_m_{c}") for c in cols]) \
             .select(*[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) if c in cols else F.col(c)
                       for c in df.columns], *[f"_m_{c}" for c in cols])


def impute_chained(df: DataFrame, cols: list[str], max_iter: int = 10, trees: int = 10, tol: float = 1e-3,
                   seed: int = 42) -> DataFrame:
    miss = missing_counts(df, cols)
    incomplete = sorted([c for c in cols if miss[c] > 0], key=lambda c: (miss[c], c))
    rows = df.count()
    cols = [c for c in cols if miss[c] < rows or not rows]          # a column without any value stays as it is
    incomplete = [c for c in incomplete if c in cols]
    x = cut_lineage(mean_start(df, cols).withColumn("_row", F.monotonically_increasing_id()))
    if not incomplete:
        return x.drop("_row", *[f"_m_{c}" for c in cols])
    inf_norm = df.agg(F.max(_greatest([F.abs(F.col(c).cast("double")) for c in cols]))).first()[0] or 0.0
    for _ in range(max_iter):
        prev = x
        for c in incomplete:
            others = [o for o in cols if o != c]
            va = VectorAssembler(inputCols=others, outputCol="_f")
            train = va.transform(x.where(~F.col(f"_m_{c}")))
            rf = RandomForestRegressor(featuresCol="_f", labelCol=c, predictionCol="_pred", numTrees=trees,
                                       seed=seed).fit(train)
            pred = rf.transform(va.transform(x))
            x = pred.withColumn(c, F.when(F.col(f"_m_{c}"), F.col("_pred")).otherwise(F.col(c))) \
                    .drop("_f", "_pred")
            x = cut_lineage(x)                                      # the next column's fit reads this one's values
        change = _max_change(prev, x, incomplete)
        if change < tol * inf_norm:
            break
    return x.drop("_row", *[f"_m_{c}" for c in cols])


def _greatest(values: list):
    return F.greatest(*values) if len(values) > 1 else values[0]


def _max_change(prev: DataFrame, cur: DataFrame, cols: list[str]) -> float:
    """Largest absolute change of an imputed cell between two rounds."""
    key = "_row"
    a = prev.select(key, *[F.col(c).alias(f"a_{c}") for c in cols])
    b = cur.select(key, *[F.col(c).alias(f"b_{c}") for c in cols])
    d = a.join(b, key).agg(F.max(_greatest([F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) for c in cols])))
    return d.first()[0] or 0.0
