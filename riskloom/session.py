"""Session construction and lineage management.

On a cluster the session is created by the platform; `configure` only sets
what a job needs (AQE, UTC, Arrow) and reads the shared checkpoint folder from
`spark.checkpoint.dir`.  A private folder is created only when that setting is
unset and the master is local (tests, benches).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

JOB_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # texts differ in length by orders of magnitude: a batch of 10,000 long ones would not fit a Python worker
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}


def build_local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                        app: str = "riskloom") -> SparkSession:
    """Local session for tests and benches (UI off, no server opened)."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", "16g")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for k, v in JOB_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    for k, v in JOB_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked conf on a managed cluster
            pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, setting a local one only when none is named."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
        return shared
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="riskloom-ckpt-")
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint root for written intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "tables", name)


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage like `cut_lineage`, by a Parquet table under the checkpoint folder.  For rounds of joins: a
    checkpoint keeps the estimated size of its plan, which multiplies from join to join, so that small tables
    are shuffled; of a table Spark knows the size."""
    path = scratch_path(df.sparkSession, f"settled-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of every query run inside are deleted when it ends (its result is written by then), so that
    those of several passes do not lie on disk together."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
