"""Assembling, standardising, padding and PCA.

Standardisation statistics are one aggregate (mean, population std per column)
referenced through a scalar subquery; the transform stays a narrow projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """V06 fit: one row with mean_<c>, std_<c> (population std, like the reference)."""
    return df.agg(*[x for c in cols for x in (F.avg(c).alias(f"mean_{c}"), F.stddev_pop(c).alias(f"std_{c}"))])


def standardize(df: DataFrame, cols: list[str], stats: DataFrame | None = None, prefix: str = "z_",
                keep: list[str] | None = None) -> DataFrame:
    """V06 transform: (x - mean) / std; constant column (std 0) -> 0.
    V07: a column absent from `df` is padded with its training mean (z = 0), by name."""
    stats = stats if stats is not None else scaler_stats(df, cols)
    s = fitted_row(stats)
    out = [F.col(k) for k in (keep or [])]
    for c in cols:
        mean, sd = s[f"mean_{c}"], s[f"std_{c}"]
        x = F.col(c) if c in df.columns else F.lit(mean)
        if sd is None or sd == 0 or mean is None:
            out.append(F.lit(0.0).alias(prefix + c))
        else:
            out.append(((x - F.lit(mean)) / F.lit(sd)).alias(prefix + c))
    return df.select(*out)


def fitted_row(stats: DataFrame) -> dict:
    """Fitted statistics are one aggregate row of bounded width (a few numbers per
    column); they are fetched once and embedded as literals, so the transform
    is a pure projection (no subquery re-running the upstream plan)."""
    return stats.first().asDict()
