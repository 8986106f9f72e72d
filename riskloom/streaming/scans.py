"""ST01: a monitor whose scans fail alone.

Every micro-batch is one scan: scored once, its history and alerts written to
folders of their own, and then committed by one small row, so readers see both
or neither and a replayed batch rewrites what it wrote.  A scan that raises is
kept with its rows and its error instead, the next one runs, and
retry_failed() scans it again under its own number.  The alert table is the
latest alert per (level, user, day) over all committed scans, whatever order
they came in, so the query holds no state and needs no watermark.  compact()
folds committed scans into one folder.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .monitor import latest_alerts, route_alerts

log = logging.getLogger(__name__)

HISTORY = "scan_id string, scan_ts timestamp, mode string, username string, label string, probability double, risk_band string"
ALERTS = f"{HISTORY}, alert_level string, alert_date date"
_COMMIT = "epoch long, upto long, results long, alerts long"


@dataclass(frozen=True)
class ScanLog:
    """The folders of one monitor under a shared root."""
    spark: SparkSession
    root: str

    def _folder(self, kind: str, epoch: int) -> str:
        return f"{self.root}/{kind}/epoch={epoch}"

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def _read(self, kind: str, schema: str, epochs: list[int]) -> DataFrame:
        paths = [self._folder(kind, e) for e in epochs]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, epoch int")
        reader = self.spark.read.schema(f"{schema}, epoch int").option("basePath", f"{self.root}/{kind}")
        return reader.json(paths) if kind == "alerts" else reader.parquet(*paths)

    def commits(self) -> DataFrame:
        """(epoch, upto, results, alerts) of the scans to read: the newest compaction and what came after it."""
        if not self._exists(f"{self.root}/commits"):
            return self.spark.createDataFrame([], _COMMIT)
        rows = self.spark.read.schema("upto long, results long, alerts long, epoch long").parquet(f"{self.root}/commits")
        done = rows.agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]
        # a compaction has the number of the newest scan that it holds, less by half: it is stored under -2 - upto
        return rows.filter((F.col("upto") == done) if done >= 0 else F.lit(False)).unionByName(
            rows.filter(F.col("upto").isNull() & (F.col("epoch") > done))).select("epoch", "upto", "results", "alerts")

    def _epochs(self) -> list[int]:
        return [r["epoch"] for r in self.commits().select("epoch").collect()]

    def history(self) -> DataFrame:
        """The results of all committed scans."""
        return self._read("history", HISTORY, self._epochs())

    def alerts(self) -> DataFrame:
        """The latest alert per (level, user, day) of all committed scans."""
        return latest_alerts(self._read("alerts", ALERTS, self._epochs()).drop("epoch"))

    def failed(self) -> DataFrame:
        """(epoch, error, at) of the scans that failed and have not succeeded since."""
        if not self._exists(f"{self.root}/errors"):
            return self.spark.createDataFrame([], "error string, epoch int")
        rows = self.spark.read.schema("error string, epoch int").parquet(f"{self.root}/errors")
        last = self.commits().agg(F.max("upto")).first()[0]
        return (rows.join(self.commits().select("epoch"), "epoch", "left_anti")
                .filter(F.lit(last).isNull() | (F.col("epoch") > F.coalesce(F.lit(last), F.lit(-1)))))

    def _write(self, scored: DataFrame, epoch: int, upto: int | None = None) -> None:
        alerts = latest_alerts(route_alerts(scored))
        scored.write.mode("overwrite").parquet(self._folder("history", epoch))
        alerts.select(*[f.split()[0] for f in ALERTS.split(", ")]).write.mode("overwrite").json(self._folder("alerts", epoch))
        n = scored.count(), self._read("alerts", ALERTS, [epoch]).count()
        self.spark.createDataFrame([(upto, *n)], "upto long, results long, alerts long").coalesce(1).write.mode("overwrite").parquet(
            self._folder("commits", epoch))

    def scan(self, rows: DataFrame, score_fn, epoch: int) -> bool:
        """One scan; whether it was committed.  A raising score function is recorded, storage errors are not swallowed."""
        try:
            scored = cut_lineage(score_fn(rows).select(*[f.split()[0] for f in HISTORY.split(", ")]))
        except Exception as ex:  # noqa: BLE001 (whatever a score function raises ends this scan alone)
            log.error("scan %s failed: %s", epoch, str(ex)[:300])
            rows.write.mode("overwrite").parquet(self._folder("failed", epoch))
            self.spark.createDataFrame([(str(ex)[:2000],)], "error string").coalesce(1).write.mode("overwrite").parquet(
                self._folder("errors", epoch))
            return False
        self._write(scored, epoch)
        return True

    def retry_failed(self, score_fn) -> list[int]:
        """Scans again what failed, each under its own number; the numbers that succeeded."""
        done = []
        for epoch in sorted(r["epoch"] for r in self.failed().select("epoch").collect()):
            if self.scan(self.spark.read.parquet(self._folder("failed", epoch)), score_fn, epoch):
                done.append(epoch)
                self._delete(self._folder("failed", epoch))
                self._delete(self._folder("errors", epoch))
        return done

    def compact(self) -> int | None:
        """Folds the committed scans before the oldest failed one into one
        folder, commits that, then deletes theirs; the newest number folded."""
        waiting = self.failed().agg(F.min("epoch")).first()[0]
        epochs = [e for e in self._epochs() if waiting is None or e < waiting]
        scans = [e for e in epochs if e >= 0]
        if len(epochs) < 2 or not scans:
            return None
        newest = max(scans)
        folded = cut_lineage(self._read("history", HISTORY, epochs).drop("epoch"))
        self._write(folded, -2 - newest, newest)
        for e in epochs:
            for kind in ("commits", "history", "alerts"):
                self._delete(self._folder(kind, e))
        return newest


def start_scans(snapshots: DataFrame, watch_list: DataFrame, score_fn, root: str, checkpoint: str, trigger: dict | None = None):
    """ST01: stream of profile snapshots -> inner join with the watch list ->
    one scan per micro-batch.  `trigger` defaults to a processing-time interval."""
    spark = snapshots.sparkSession
    scans = ScanLog(spark, root)

    def sink(batch: DataFrame, epoch: int) -> None:
        scans.scan(batch.join(watch_list, "username"), score_fn, epoch)

    return (snapshots.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "60 minutes"})).start())
