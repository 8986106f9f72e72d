"""ST01: scans that fail alone, are retried, replayed and compacted."""

import pytest
from pyspark.sql import functions as F

from riskloom.plans.q_stream import results, score_events
from riskloom.streaming import monitor as MON
from riskloom.streaming.scans import ScanLog, start_scans

from .conftest import SF_SMALL

KEYS = ["alert_level", "username", "alert_date", "scan_id"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet").cache()


def test_a_raising_score_function_ends_its_own_scan_only(spark, events, tmp_path):
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    for i in range(4):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(4)) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    snaps = (spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
             .withColumn("username", name))
    watch = events.select(name.alias("username")).distinct()
    root, ckpt, calls = str(tmp_path / "out"), str(tmp_path / "ckpt"), []

    def broken(df):
        calls.append(1)
        if len(calls) == 2:
            raise ValueError("no model")
        scored = score_events(df.drop("username"))
        if len(calls) == 3:                                      # fails in the tasks, not when it is planned
            return scored.withColumn("probability", F.raise_error(F.lit("bad row")).cast("double"))
        return scored

    start_scans(snaps, watch, broken, root, ckpt, {"availableNow": True}).awaitTermination()
    log = ScanLog(spark, root)
    assert len(calls) == 4
    assert [(r.epoch, "no model" in r.error, "bad row" in r.error) for r in log.failed().orderBy("epoch").collect()] == [
        (1, True, False), (2, False, True)]
    assert sorted(r.epoch for r in log.commits().collect()) == [0, 3]
    assert log.compact() is None                                 # nothing behind the failed scans but one
    good = lambda d: score_events(d.drop("username"))
    assert log.retry_failed(good) == [1, 2] and log.failed().count() == 0 and log.retry_failed(good) == []
    want = results(spark, SF_SMALL)
    alerts = rows(MON.latest_alerts(MON.route_alerts(want)), *KEYS)
    cols = ["scan_id", "scan_ts", "mode", "username", "label", "probability", "risk_band"]
    assert rows(log.alerts(), *KEYS) == alerts and rows(log.history(), *cols) == rows(want, *cols)
    # a restart finds nothing new, a replayed scan adds nothing, compaction changes nothing
    start_scans(snaps, watch, good, root, ckpt, {"availableNow": True}).awaitTermination()
    again = spark.read.parquet(str(tmp_path / "in")).withColumn("username", name)
    part = again.where(F.input_file_name().contains("part-"))
    assert part.count() == events.count()
    assert log.compact() == 3 and log.compact() is None
    assert [(r.epoch, r.upto) for r in log.commits().collect()] == [(-5, 3)]
    assert rows(log.alerts(), *KEYS) == alerts and rows(log.history(), *cols) == rows(want, *cols)
    more = again.limit(5)
    assert log.scan(more, good, 4) and log.scan(more, good, 4)   # replayed
    assert log.history().count() == want.count() + more.count()
    assert log.compact() == 4 and log.history().count() == want.count() + more.count()


def test_an_empty_log_reads_as_empty(spark, tmp_path):
    log = ScanLog(spark, str(tmp_path / "none"))
    assert log.commits().count() == log.history().count() == log.alerts().count() == log.failed().count() == 0
    assert log.compact() is None and log.retry_failed(None) == []
    assert log.scan(spark.createDataFrame([], "scan_ts timestamp"), lambda d: results(spark, SF_SMALL).limit(0), 0)
    assert log.history().count() == 0 and log.commits().count() == 1
