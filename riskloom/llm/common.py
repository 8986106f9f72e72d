"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, scratch_path

__all__ = ["ascii_lower", "bounded_sample", "cut_lineage", "ensure_checkpoint_dir", "parts", "read_table", "written"]

#: ASCII white space as the contracts define it: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else (`lower` would also fold other alphabets)."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and read it back:
    cuts lineage so that a lost executor never repeats the work above it."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(rows: DataFrame, key: str, most: int, seed: int = 42) -> DataFrame:
    """All rows, or if there are more than `most` the `most` that a seeded hash of
    `key` puts first.  Only about `most` rows reach the final sort: those above
    a hash limit set by the number of rows are left out before it."""
    n = rows.count()
    if n <= most:
        return rows
    ranked = rows.withColumn("_rank", F.xxhash64(F.lit(seed), F.col(key)))
    limit = int(-(1 << 63) + (1 << 64) * min(1.0, 1.1 * most / n + 10 * (most ** 0.5) / n)) - 1
    near = ranked.filter(F.col("_rank") <= F.lit(min(limit, (1 << 63) - 1)).cast("long"))
    return near.orderBy("_rank", key).limit(most).drop("_rank")
