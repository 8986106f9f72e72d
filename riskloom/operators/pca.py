"""PCA fit (95 % variance), projection and loadings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fit_pca(df: DataFrame, in_col: str = "features", out_col: str = "pca", variance: float = 0.95):
    """The fewest components whose cumulative explained variance exceeds
    `variance` (input already centred: Spark's transform does not centre).
    The covariance is a D x D aggregate (bounded by the feature count)."""
    d = len(df.select(in_col).first()[in_col])
    full = PCA(k=d, inputCol=in_col, outputCol=out_col).fit(df)
    ratio = np.asarray(full.explainedVariance.toArray())
    k = int(min(d, np.searchsorted(np.cumsum(ratio), variance, side="right") + 1))
    model = full if k == d else PCA(k=k, inputCol=in_col, outputCol=out_col).fit(df)
    return model, ratio[:k]


def loadings(model) -> list[list[float]]:
    """K x D component matrix (rows = components)."""
    return np.asarray(model.pc.toArray()).T.tolist()


def loadings_table(spark: SparkSession, model, feature_names: list[str], explained) -> DataFrame:
    """Long form (component, feature_idx, feature, loading, explained_pct) for X07."""
    V = loadings(model)
    rows = [(k, j, feature_names[j], float(V[k][j]), float(explained[k]) * 100)
            for k in range(len(V)) for j in range(len(feature_names))]
    return spark.createDataFrame(rows, "component int, feature_idx int, feature string, loading double, "
                                       "explained_pct double")


def component_report(table: DataFrame, n_top: int = 5) -> DataFrame:
    """Top-n loadings by |loading| per component with explained variance %."""
    from pyspark.sql import Window
    w = Window.partitionBy("component").orderBy(F.abs("loading").desc(), "feature_idx")
    return table.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n_top)
