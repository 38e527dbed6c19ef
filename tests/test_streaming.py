"""Streams over several micro-batches against the batch result or a plain loop."""

import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.operators.alerts import alert_matches
from tickloom.streaming import run, windows

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def event_dir(spark, tmp_path_factory):
    """600 events in three files, in time order; one user sends two thirds of them."""
    base = str(tmp_path_factory.mktemp("events"))
    rows = [
        (i, START + datetime.timedelta(minutes=11 * i, seconds=i % 3), 1 if i % 3 else 2 + i % 4, ["view", "error"][(i * 7 // 5) % 2], float((i * 53) % 97))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    for part in range(3):
        df.where((F.col("event_id") >= part * 200) & (F.col("event_id") < part * 200 + 200)).coalesce(1).write.mode("append").parquet(base)
    return base, df


def stream(spark, event_dir):
    base, df = event_dir
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(base)


def test_bars_match_the_batch_up_to_the_watermark(spark, event_dir):
    got = run.drain(windows.tick_bars(windows.ticks(stream(spark, event_dir)))).collect()
    want = {(r["ticker"], r["start"]): r for r in windows.tick_bars(windows.ticks(event_dir[1])).collect()}
    assert got and all(r == want[r["ticker"], r["start"]] for r in got)
    last = max(r["start"] for r in want.values())
    assert {k for k in want if k[1] < last - datetime.timedelta(days=1)} <= {(r["ticker"], r["start"]) for r in got}


def test_late_ticks_are_dropped(spark, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    day = datetime.timedelta(days=1)
    # A watermark filters late ticks from the second batch after the one that raised it.
    for i, ts in enumerate([START, START + 3 * day, START + 4 * day, START + day / 24, START + 9 * day]):
        spark.createDataFrame([(i, ts, 1, "view", 10.0 * i)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    first = run.drain(windows.tick_bars(windows.ticks(source))).orderBy("start").first()
    assert first["volume"] == 1 and first["close"] == 100.0


def test_alerts_on_a_stream_equal_the_batch(spark, tmp_path):
    d = datetime.date
    rows = [("A", d(2024, 1, i), 90.0 + i, 50.0, 1, 1, 0.0) for i in range(1, 25)]
    bars = spark.createDataFrame(rows, "ticker string, dt date, close double, rsi14 double, regime int, prev_regime int, drawdown double")
    bars.write.parquet(str(tmp_path / "bars"))
    rules = spark.createDataFrame([("r", "u", "A", "PRICE_ABOVE", 100.0, "ACTIVE")], "rule_id string, user_id string, ticker string, condition_type string, threshold double, status string")
    live = spark.readStream.schema(bars.schema).parquet(str(tmp_path / "bars"))
    assert sorted(run.drain(alert_matches(live, rules)).collect()) == sorted(alert_matches(bars, rules).collect())
