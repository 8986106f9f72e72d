"""H01-H03, ST01-ST05, S11: scan history, alert routing, latest-alert upsert,
running report, and the Structured Streaming monitor.

The reference's polling thread becomes a streaming query with a trigger;
alerts are upserted idempotently (dynamic partition overwrite keyed by level
and day), so a replayed micro-batch after an executor or driver failure writes
the same files again instead of duplicating rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


ALERT_LEVELS = ("CRITICAL", "HIGH", "MEDIUM")
HISTORY_KEEP = 50
REPORT_LAST = 10


# --- H01-H03 ------------------------------------------------------------------------

def scan_entries(results: DataFrame) -> DataFrame:
    """One history entry per scan: (scan_id, scan_ts, mode, count)."""
    return results.groupBy("scan_id", "mode").agg(F.min("scan_ts").alias("scan_ts"),
                                                  F.count(F.lit(1)).alias("count"))


def last_scans(entries: DataFrame, n: int = HISTORY_KEEP) -> DataFrame:
    """Keep the last n scans, newest first (top-n: each task keeps n rows)."""
    return entries.orderBy(F.col("scan_ts").desc(), F.col("scan_id").desc()).limit(n)


def report_summary(results: DataFrame) -> DataFrame:
    """H03 head: scans, accounts scanned, fakes detected."""
    return results.agg(F.count_distinct("scan_id").alias("total_scans"),
                       F.count(F.lit(1)).alias("accounts_scanned"),
                       F.count_if(F.col("label") == "FAKE").alias("fake_detected"))


def report_detail(results: DataFrame, n: int = REPORT_LAST) -> DataFrame:
    """H03 detail: the results of the last n scans, with the line text."""
    last = last_scans(scan_entries(results), n).select("scan_id")
    r = results.join(F.broadcast(last), "scan_id")        # n rows: bounded
    line = F.format_string("  @%s → %s (%s%%) [%s]", F.col("username"), F.col("label"),
                           F.format_string("%.1f", F.bround(F.col("probability") * 100, 1)), F.col("risk_band"))
    return r.select("scan_id", "scan_ts", "mode", "username", "label", "probability", "risk_band", line.alias("line"))


# --- ST02-ST03, S11 --------------------------------------------------------------------

def route_alerts(results: DataFrame) -> DataFrame:
    """ST02: CRITICAL/HIGH/MEDIUM are stored as alerts, LOW is dropped."""
    return results.where(F.col("risk_band").isin(*ALERT_LEVELS)) \
                  .withColumn("alert_level", F.col("risk_band")) \
                  .withColumn("alert_date", F.to_date("scan_ts"))


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """ST03: one alert per (level, username, day); the later alert wins.
    Partial aggregation (max_by) absorbs a hot user before the shuffle."""
    cols = [c for c in alerts.columns if c not in ("alert_level", "username", "alert_date")]
    best = F.max_by(F.struct(*cols), F.struct("scan_ts", "scan_id"))
    keys = ["alert_level", "username", "alert_date"]
    if alerts.isStreaming:          # the day as an event-time window: state older than the watermark is dropped
        keys.append(F.window("scan_ts", "1 day"))
    return alerts.groupBy(*keys).agg(best.alias("a")).select(
        "alert_level", "username", "alert_date", "a.*")


def write_alerts(alerts: DataFrame, path: str, epoch: int = 0) -> None:
    """JSON alert files partitioned by level and day, in one folder per
    batch (`epoch`).  A retried batch rewrites its own folder only, so replay
    adds nothing and no batch touches what others wrote."""
    alerts.write.mode("overwrite").partitionBy("alert_level", "alert_date").json(f"{path}/epoch={int(epoch)}")


def read_alerts(spark, path: str, schema: str) -> DataFrame:
    """The alert table: per (level, user, day) the row of the latest batch.
    `schema` names the columns of the files with alert_level and alert_date."""
    rows = spark.read.schema(f"{schema}, epoch long").json(path)
    keys = ["alert_level", "username", "alert_date"]
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    best = F.max_by(F.struct(*rest), "epoch").alias("a")
    return rows.groupBy(*keys).agg(best).select(*[f"a.{c}" if c in rest else c for c in rows.columns if c != "epoch"])


# --- ST05 --------------------------------------------------------------------------------

def running_report(results: DataFrame, window: str = "1 day", watermark: str | None = None) -> DataFrame:
    """ST05: counts per mode and event-time window (batch or stream)."""
    r = results.withWatermark("scan_ts", watermark) if watermark else results
    return r.groupBy("mode", F.window("scan_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n_results"), F.count_if(F.col("label") == "FAKE").alias("n_fake")) \
        .select("mode", F.col("w.start").alias("window_start"), "n_results", "n_fake")


# --- ST01: streaming monitor --------------------------------------------------------

def start_monitor(snapshots: DataFrame, watch_list: DataFrame, score_fn, alert_path: str, history_path: str,
                  checkpoint: str, trigger: dict | None = None, watermark: str = "1 day"):
    """ST01: stream of profile snapshots -> stream-static inner join with the
    watch list -> score -> latest alert per (level, user, day) as an update-mode
    aggregate -> foreachBatch upsert of alert partitions + history append.
    `trigger` defaults to a processing-time interval; tests use availableNow."""
    scored = score_fn(snapshots.join(watch_list, "username"))
    alerts = route_alerts(scored).withWatermark("scan_ts", watermark)
    latest = latest_alerts(alerts)

    def sink(batch: DataFrame, epoch: int):
        batch.persist()
        try:
            write_alerts(batch, alert_path, epoch)
        finally:
            batch.unpersist()

    q = (latest.writeStream.outputMode("update").foreachBatch(sink)
         .option("checkpointLocation", checkpoint + "/alerts"))
    q = q.trigger(**(trigger or {"processingTime": "60 minutes"}))
    hist = (scored.select("scan_id", "scan_ts", "mode", "username", "label", "probability", "risk_band")
            .writeStream.outputMode("append").format("parquet").option("path", history_path)
            .option("checkpointLocation", checkpoint + "/history").trigger(**(trigger or {"processingTime": "60 minutes"})))
    return q.start(), hist.start()


def one_shot_scan(profiles: DataFrame, score_fn, mode: str, scan_ts) -> tuple[DataFrame, DataFrame]:
    """ST04 + H01: score a batch of profiles once and build its history entry
    (scan_ts is an explicit as-of value, not now())."""
    res = score_fn(profiles).withColumn("mode", F.lit(mode)).withColumn("scan_ts", F.lit(scan_ts).cast("timestamp"))
    entry = res.agg(F.lit(mode).alias("mode"), F.min("scan_ts").alias("scan_ts"), F.count(F.lit(1)).alias("count"),
                    F.count_if(F.col("label") == "FAKE").alias("n_fake"))
    return res, entry


def fetch_and_score(names: DataFrame, profiles: DataFrame, score_fn, key: str = "username") -> DataFrame:
    """One result per resolvable name (inner join, duplicates collapsed);
    unresolvable names are skipped; an empty list gives an empty result."""
    return score_fn(profiles.join(names.select(key).distinct(), key, "left_semi"))
