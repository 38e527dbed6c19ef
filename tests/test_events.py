import datetime
import math

import pytest
from pyspark.sql import functions as F

from tickloom.constants import BREAKER_WINDOW
from tickloom.functions.blocks import trailing_count, with_ordinal
from tickloom.operators import alerts, sentiment, telemetry
from tickloom.sources.sinks import as_json, sanitise, write_result

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    """3,000 calls, nine tenths of them by one key, several at the same instant."""
    rows = []
    for i in range(3000):
        key = "hot" if i % 10 else f"k{i % 7}"
        rows.append((i, key, START + datetime.timedelta(seconds=(i * 37) % 9000), "a" if i % 3 else "b", (i * 7919 % 1000) / 250.0, (i * 31) % 5 > 1, i % 4 == 0))
    return spark.createDataFrame(rows, "event_id long, key string, ts timestamp_ntz, label string, latency_s double, ok boolean, from_cache boolean").persist()


def by_key(log):
    out = {}
    for r in sorted(log.collect(), key=lambda r: (r["ts"], r["event_id"])):
        out.setdefault(r["key"], []).append(r)
    return out


@pytest.mark.parametrize("newest", [False, True])
def test_ordinal_matches_a_sort(log, newest):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    got = {r["event_id"]: r["seq"] for r in with_ordinal(log, "key", micros, "event_id", newest_first=newest).collect()}
    for rows in by_key(log).values():
        for i, r in enumerate(reversed(rows) if newest else rows):
            assert got[r["event_id"]] == i


def test_failure_rate_does_not_depend_on_the_block(log):
    rows = by_key(log)
    want = {}
    for key, calls in rows.items():
        for i, r in enumerate(calls):
            last = calls[max(0, i - BREAKER_WINDOW + 1) : i + 1]
            want[r["event_id"]] = (len(last), sum(not c["ok"] for c in last) / len(last))
    for block in (32, 4096):
        got = telemetry.sliding_failure_rate(log, block=block).collect()
        assert len(got) == 3000
        for r in got:
            n, rate = want[r["event_id"]]
            assert r["outcomes"] == n and r["failure_rate"] == pytest.approx(rate)
            assert r["tripped"] == (n == 20 and rate >= 0.5)


def test_trailing_calls(log):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    span = 60_000_000
    out = trailing_count(log, "key", micros, span, "event_id", "calls").collect()
    assert len(out) == 3000
    times = {k: [r["ts"] for r in v] for k, v in by_key(log).items()}
    for r in out[::11]:
        low = r["ts"] - datetime.timedelta(seconds=60)
        assert r["calls"] == sum(low <= t <= r["ts"] for t in times[r["key"]])


def test_most_of_a_log_in_one_second(spark):
    rows = [(i, "hot", START + datetime.timedelta(microseconds=(i * 7919) % 1_000_000 if i % 10 else i * 1_000_000)) for i in range(2000)]
    busy = spark.createDataFrame(rows, "event_id long, key string, ts timestamp_ntz")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    got = {r["event_id"]: r["seq"] for r in with_ordinal(busy, "key", micros, "event_id").collect()}
    assert [got[r[0]] for r in order] == list(range(2000))
    calls = {r["event_id"]: r["calls"] for r in trailing_count(busy, "key", micros, 500_000, "event_id", "calls").collect()}
    for i, _, t in rows[::37]:
        assert calls[i] == sum(t - datetime.timedelta(microseconds=500_000) <= u <= t for _, _, u in rows)


def test_nearest_rank(log):
    got = {r["key"]: r for r in telemetry.nearest_rank(log, "key", "latency_s", (0.5, 0.95, 0.99)).collect()}
    for key, rows in by_key(log).items():
        v = sorted(r["latency_s"] for r in rows)
        for p in (0.5, 0.95, 0.99):
            assert got[key][f"p{int(p * 100)}"] == v[max(0, math.ceil(p * len(v)) - 1)]


def test_histogram_is_cumulative(log):
    hist = log.groupBy("label").agg(*telemetry.histogram_columns("latency_s"))
    rows = telemetry.histogram_buckets(hist, ["label"]).where("label = 'a'").orderBy("le").collect()
    counts = [r["cumulative"] for r in rows]
    assert counts == sorted(counts) and counts[-1] == rows[0]["count"] and len(counts) == 13
    pct = telemetry.bucket_percentile(hist, ["label"]).where("label = 'a'").first()
    assert pct["p50"] in [r["le"] for r in rows]


def test_versions_best_and_stale(spark):
    d = datetime.date
    runs = spark.createDataFrame(
        [("A", 1, "ready", 2.0, d(2024, 1, 1)), ("A", 2, "failed", 0.1, d(2024, 1, 2)), ("A", 3, "ready", 1.0, d(2024, 3, 1)), ("A", 4, "ready", 1.0, d(2024, 3, 5)), ("A", 5, "ready", 9.0, None)],
        "ticker string, run_id long, status string, rmse double, trained_at date",
    )
    v = telemetry.with_version(runs.where("trained_at is not null"))
    assert telemetry.next_version(v).first()["next_version"] == "v5"
    best = telemetry.best_latest_model(v).first()
    assert (best["best"], best["latest"]) == ("v3", "v4")
    assert [r["run_id"] for r in telemetry.stale_models(runs, "2024-03-09").collect()] == [1, 3]


HEADLINES = [
    (5, "g", "Bullish rally: shares surge after upgrade"),
    (4, "g", "Recession fears, layoffs and a downgrade"),
    (3, "g", "Quarterly report published on Tuesday"),
    (2, "g", ""),
    (1, "h", "Fraud investigation leads to bankruptcy"),
]


def test_finance_headlines(spark):
    df = spark.createDataFrame(HEADLINES, "text_id long, grp string, text string")
    scores = sentiment.score_texts(df, sentiment.finance_lexicon(spark), ["text_id", "grp"]).persist()
    got = {r["text_id"]: r for r in scores.collect()}
    s = 3.0 + 2.5 + 2.5 + 2.5
    assert got[5]["compound"] == round(s / math.sqrt(s * s + 15), 4) and got[5]["label"] == "Bullish"
    assert got[4]["label"] == got[1]["label"] == "Bearish"
    assert got[3]["label"] == "Neutral" and got[3]["neutral"] == 1.0
    assert (got[2]["compound"], got[2]["neutral"], got[2]["confidence"]) == (0.0, 1.0, 0.0)
    agg = {r["grp"]: r for r in sentiment.recency_sentiment(scores, "grp", "text_id").collect()}
    w = [math.exp(-0.3 * i) for i in range(4)]
    want = sum(got[i]["compound"] * x for i, x in zip((5, 4, 3, 2), w)) / sum(w)
    assert agg["g"]["compound"] == pytest.approx(want)
    split = sentiment.bull_bear_split(sentiment.recency_sentiment(scores, "grp", "text_id")).where("grp = 'h'").first()
    assert split["bullish_pct"] == int((agg["h"]["compound"] + 1) / 2 * 100) and split["bullish_pct"] + split["bearish_pct"] == 100


def test_alert_conditions(spark):
    d = datetime.date
    bars = spark.createDataFrame(
        [("A", d(2024, 1, 1), 100.0, 50.0, 1, None, 0.0), ("A", d(2024, 1, 2), 120.0, 71.0, 1, 1, 0.0), ("A", d(2024, 1, 3), 90.0, 29.0, 4, 1, 25.0)],
        "ticker string, dt date, close double, rsi14 double, regime int, prev_regime int, drawdown double",
    )
    levels = [110.0, 95.0, 70.0, 30.0, 0.0, 20.0]
    rules = [(k, "u", "A", k, v, "ACTIVE") for k, v in zip(alerts.CONDITIONS, levels)] + [("off", "u", "A", "PRICE_ABOVE", 1.0, "PAUSED")]
    rules = spark.createDataFrame(rules, "rule_id string, user_id string, ticker string, condition_type string, threshold double, status string")
    got = sorted((r["rule_id"], r["dt"].day) for r in alerts.alert_matches(bars, rules).collect())
    assert got == [("DRAWDOWN_EXCEEDS", 3), ("PRICE_ABOVE", 2), ("PRICE_BELOW", 3), ("REGIME_CHANGE", 3), ("RSI_ABOVE", 2), ("RSI_BELOW", 3)]


def test_sink_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("A", 1.23456, float("nan")), ("B", float("inf"), 2.0)], "ticker string, x double, y double")
    rows = {r["ticker"]: r for r in sanitise(df).collect()}
    assert rows["A"]["x"] == 1.2346 and rows["A"]["y"] is None and rows["B"]["x"] is None
    assert as_json(sanitise(df), "ticker").where("ticker = 'B'").first()["record"] == '{"y":2.0}'
    for fmt in ("parquet", "json"):
        write_result(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).load(str(tmp_path / fmt)).count() == 2
