"""Distributed running totals / ranks without a single-partition window.

A window with no PARTITION BY moves every row into one task.  Instead the rows
are range-partitioned on the ordering key, each partition's totals are summed
(one row per partition and group), those few rows get exclusive offsets, and a
per-partition window adds the offset back.  This is the DataFrame form of a
distributed prefix sum; the partition assignment is pinned with a reliable
checkpoint so both uses of it agree even after an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def running_totals(df: DataFrame, order_cols: list[str], sum_cols: list[str],
                   group_col: str | None = None, n_parts: int | None = None,
                   inclusive: bool = False, prefix: str = "cum_") -> DataFrame:
    """Adds `cum_<c>` = sum of c over rows strictly before this row in
    (group_col, *order_cols) order (inclusive=True also counts the row itself).
    `order_cols` must make the order total (end with a unique key)."""
    spark = df.sparkSession
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group_col] if group_col else []) + order_cols
    r = cut_lineage(df.repartitionByRange(n_parts, *keys).withColumn("_pid", F.spark_partition_id()))
    gkeys = ["_pid"] + ([group_col] if group_col else [])
    tot = r.groupBy(*gkeys).agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = (Window.partitionBy(*([group_col] if group_col else [])).orderBy("_pid")
             .rowsBetween(Window.unboundedPreceding, -1))
    offs = tot.select(*gkeys, *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}")
                                for c in sum_cols])
    # `offs` has at most n_parts + groups rows; no hint, since groups may be many: Spark broadcasts it by its size
    w_in = Window.partitionBy(*gkeys).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    out = r.join(offs, gkeys, "left")
    for c in sum_cols:
        out = out.withColumn(f"{prefix}{c}", F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0)))
    return out.drop("_pid", *[f"_o_{c}" for c in sum_cols])


def dense_rank_in_group(df: DataFrame, group_col: str, order_cols: list[str],
                        n_parts: int | None = None, name: str = "rank") -> DataFrame:
    """1-based row rank inside each group, computed with running_totals (scales
    when a group holds a third of the table)."""
    out = running_totals(df.withColumn("_one", F.lit(1)), order_cols, ["_one"], group_col,
                         n_parts, inclusive=True)
    return out.withColumnRenamed("cum__one", name).drop("_one")
