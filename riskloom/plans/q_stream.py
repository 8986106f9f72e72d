"""Queries for history, alerts and the streaming monitor (H01-H03, ST01-ST05, S11).

Scan results are derived from `events`: one result per event, the scan is
(mode = event type, hour of the event), probability = min(value / 500, 0.99)."""

import uuid

from pyspark.sql import functions as F

from ..operators.output import label_text, risk_band
from ..session import scratch_path
from ..sources.tables import Tables
from ..streaming import monitor as MON
from ..streaming import scans as SCANS
from .common import round_doubles
from .registry import query

SCAN_FILES = 4

RESULTS_SQL = """res AS (SELECT CAST(ts AS TIMESTAMP) AS scan_ts, event_type AS mode,
    event_type || '@' || strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') AS scan_id,
    'user_' || CAST(user_id AS VARCHAR) AS username, least(value / 500, 0.99) AS probability,
    CASE WHEN least(value / 500, 0.99) >= 0.5 THEN 'FAKE' ELSE 'GENUINE' END AS label,
    CASE WHEN least(value / 500, 0.99) >= 0.85 THEN 'CRITICAL' WHEN least(value / 500, 0.99) >= 0.6 THEN 'HIGH'
         WHEN least(value / 500, 0.99) >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_band
  FROM events)"""


def score_events(ev):
    p = F.least(F.col("value") / 500, F.lit(0.99))
    ts = F.col("ts").cast("timestamp")
    return ev.select(ts.alias("scan_ts"), F.col("event_type").alias("mode"),
                     F.concat(F.col("event_type"), F.lit("@"),
                              F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd HH:00:00")).alias("scan_id"),
                     F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
                     p.alias("probability"), label_text((p >= 0.5).cast("int")).alias("label"),
                     risk_band(p).alias("risk_band"))


def results(spark, sf_dir):
    return score_events(Tables(spark, sf_dir).events)


@query("h01_scan_history", f"WITH {RESULTS_SQL} SELECT scan_id, mode, min(scan_ts) AS scan_ts, count(*) AS count "
                           "FROM res GROUP BY scan_id, mode")
def h01_scan_history(spark, sf_dir):
    return MON.scan_entries(results(spark, sf_dir))


@query("h02_last_50_scans", f"WITH {RESULTS_SQL} SELECT * FROM (SELECT scan_id, mode, min(scan_ts) AS scan_ts, "
                            "count(*) AS count FROM res GROUP BY scan_id, mode) ORDER BY scan_ts DESC, scan_id DESC "
                            "LIMIT 50")
def h02_last_50_scans(spark, sf_dir):
    return MON.last_scans(MON.scan_entries(results(spark, sf_dir)))


@query("h03_report_summary", f"WITH {RESULTS_SQL} SELECT count(DISTINCT scan_id) AS total_scans, "
                             "count(*) AS accounts_scanned, count(*) FILTER (WHERE label = 'FAKE') AS fake_detected FROM res")
def h03_report_summary(spark, sf_dir):
    return MON.report_summary(results(spark, sf_dir))


@query("h03_report_detail", f"""WITH {RESULTS_SQL},
last AS (SELECT scan_id FROM (SELECT scan_id, min(scan_ts) AS t FROM res GROUP BY scan_id, mode)
         ORDER BY t DESC, scan_id DESC LIMIT 10)
SELECT scan_id, scan_ts, mode, username, label, round(probability, 6) AS probability, risk_band,
       '  @' || username || ' → ' || label || ' (' || printf('%.1f', round_even(probability * 100, 1)) || '%) ['
       || risk_band || ']' AS line
FROM res WHERE scan_id IN (SELECT scan_id FROM last)""")
def h03_report_detail(spark, sf_dir):
    return round_doubles(MON.report_detail(results(spark, sf_dir)))


@query("st02_route_alerts", f"WITH {RESULTS_SQL} SELECT scan_id, username, risk_band AS alert_level, "
                            "CAST(scan_ts AS DATE) AS alert_date, round(probability, 6) AS probability FROM res "
                            "WHERE risk_band <> 'LOW'")
def st02_route_alerts(spark, sf_dir):
    a = MON.route_alerts(results(spark, sf_dir))
    return round_doubles(a.select("scan_id", "username", "alert_level", "alert_date", "probability"))


LATEST_SQL = f"""WITH {RESULTS_SQL}
SELECT alert_level, username, alert_date, scan_id, round(probability, 6) AS probability FROM (
  SELECT *, risk_band AS alert_level, CAST(scan_ts AS DATE) AS alert_date,
         row_number() OVER (PARTITION BY risk_band, username, CAST(scan_ts AS DATE)
                            ORDER BY scan_ts DESC, scan_id DESC) AS rn
  FROM res WHERE risk_band <> 'LOW') WHERE rn = 1"""


@query("st03_latest_alert", LATEST_SQL)
def st03_latest_alert(spark, sf_dir):
    la = MON.latest_alerts(MON.route_alerts(results(spark, sf_dir)))
    return round_doubles(la.select("alert_level", "username", "alert_date", "scan_id", "probability"))


@query("s11_alert_sink", LATEST_SQL)
def s11_alert_sink(spark, sf_dir):
    """Write the alerts of one day in two different batches, one of them twice, and read the table back."""
    path = scratch_path(spark, f"alerts-{uuid.uuid4().hex}")
    la = MON.latest_alerts(MON.route_alerts(results(spark, sf_dir)))
    la = la.select("alert_level", "username", "alert_date", "scan_id", "probability")
    for epoch in (0, 1, 0):                                                                     # 0 is replayed
        MON.write_alerts(la.where(F.pmod(F.xxhash64("username"), F.lit(2)) == epoch), path, epoch)
    back = MON.read_alerts(spark, path, "username string, scan_id string, probability double, "
                                        "alert_level string, alert_date date")
    return round_doubles(back.select("alert_level", "username", "alert_date", "scan_id", "probability"))


@query("st05_running_report", f"""WITH {RESULTS_SQL}
SELECT mode, date_trunc('day', scan_ts) AS window_start, count(*) AS n_results,
       count(*) FILTER (WHERE label = 'FAKE') AS n_fake FROM res GROUP BY ALL""")
def st05_running_report(spark, sf_dir):
    return MON.running_report(results(spark, sf_dir))


@query("st01_stream_monitor", LATEST_SQL)
def st01_stream_monitor(spark, sf_dir):
    """The events table replayed as a stream of several files, one scan each, and
    compacted; the alerts must equal the batch ST03 result."""
    root = scratch_path(spark, f"monitor-{uuid.uuid4().hex}")
    events = Tables(spark, sf_dir).events
    events.repartitionByRange(SCAN_FILES, "ts").write.parquet(root + "/in")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    snaps = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(root + "/in")
             .withColumn("username", name))
    SCANS.start_scans(snaps, events.select(name.alias("username")).distinct(), lambda d: score_events(d.drop("username")),
                      root + "/out", root + "/ckpt", {"availableNow": True}).awaitTermination()
    log = SCANS.ScanLog(spark, root + "/out")
    log.compact()
    back = log.alerts()
    return round_doubles(back.select("alert_level", "username", "alert_date", "scan_id", "probability"))
