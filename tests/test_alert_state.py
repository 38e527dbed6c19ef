"""State of alert rules on a stream against the batch windows, over several micro-batches."""

import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.operators import regimes
from tickloom.operators.alerts import CONDITIONS, alert_matches
from tickloom.operators.indicators import indicator_columns, regime_features
from tickloom.streaming import alert_state, run, windows

DAY = datetime.date(2020, 1, 1)
TRADES = "ticker string, dt date, ts timestamp, px double, qty double, ord decimal(38,0)"


def bars_at(series, gaps):
    """(ticker, day, close): a series starts anew where ``gaps`` puts days between two bars."""
    rows = []
    for ticker, closes in series.items():
        day = DAY
        for i, c in enumerate(closes):
            day += datetime.timedelta(days=gaps.get((ticker, i), 1))
            rows.append((ticker, day, c))
    return rows


def frames(spark, rows, tmp_path, files):
    """The bars as a table, and as a stream of trades: two a day, of which the later one closes the bar."""
    bars = spark.createDataFrame(rows, "ticker string, dt date, close double")
    late = bars.select("ticker", "dt", F.col("dt").cast("timestamp").alias("ts"), F.col("close").alias("px"), F.lit(1.0).alias("qty"), F.lit(2).cast("decimal(38,0)").alias("ord"))
    early = late.withColumns({"px": F.col("px") * 2, "ord": F.lit(1).cast("decimal(38,0)")})
    trades, days = late.unionByName(early), sorted({d for _, d, _ in rows})
    step = -(-len(days) // files)
    for k in range(files):
        part = days[k * step : (k + 1) * step]
        trades.where(F.col("dt").between(part[0], part[-1])).coalesce(1).write.mode("append").parquet(str(tmp_path))
    return bars, spark.readStream.schema(TRADES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))


def same(got, want):
    key = lambda r: (r["ticker"], r["dt"])
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [key(r) for r in got] == [key(r) for r in want]
    for g, w in zip(got, want, strict=True):
        assert (g["regime"], g["prev_regime"], g["close"]) == (w["regime"], w["prev_regime"], w["close"]), key(g)
        for c in ("rsi14", "drawdown"):
            assert g[c] == w[c] or abs(g[c] - w[c]) < 1e-6, (key(g), c)


@pytest.fixture(scope="module")
def models(spark, bars_of, walk):
    bars = bars_of({"A": walk(150, 3), "B": walk(150, 11)})
    return regimes.fit_models(regime_features(indicator_columns(bars), "drop"), starts=4).cache()


def test_six_conditions_equal_the_batch(spark, walk, models, tmp_path):
    rows = bars_at({"A": walk(110, 5), "B": walk(70, 7), "no model": walk(20, 9)}, {})
    bars, trades = frames(spark, rows, tmp_path, 6)
    got = run.drain(alert_state.stream_inputs(windows.trade_bars(trades), models))
    last = max(d for _, d, _ in rows) - datetime.timedelta(days=1)  # an hour of lateness keeps that day open
    closed = bars.where(F.col("dt") < last)
    want = alert_state.batch_inputs(closed, models).collect()
    same(got.collect(), want)
    assert {r["regime"] for r in want if r["ticker"] == "A"} - {None} and all(r["regime"] is None for r in want if r["ticker"] == "no model")
    levels = dict(zip(CONDITIONS, [101.0, 99.0, 52.0, 48.0, 0.0, 2.0], strict=True))
    kinds = "rule_id string, user_id string, ticker string, condition_type string, threshold double, status string"
    rules = spark.createDataFrame([(k, "u", t, k, v, "ACTIVE") for k, v in levels.items() for t in "AB"], kinds)
    hits = sorted(tuple(r)[:5] for r in alert_matches(got, rules).collect())
    assert hits == sorted(tuple(r)[:5] for r in alert_matches(alert_state.batch_inputs(closed, models), rules).collect())
    assert {h[0] for h in hits} == set(CONDITIONS)


def test_a_silent_series_starts_anew(spark, walk, models, tmp_path):
    rows = bars_at({"A": walk(60, 5), "B": walk(130, 7)}, {("A", 40): 60})
    bars, trades = frames(spark, rows, tmp_path, 5)
    got = run.drain(alert_state.stream_inputs(windows.trade_bars(trades), models, idle_days=30)).collect()
    last = max(d for _, d, _ in rows) - datetime.timedelta(days=1)  # an hour of lateness keeps that day open
    want = alert_state.batch_inputs(bars.where(F.col("dt") < last), models, idle_days=30).collect()
    same(got, want)
    again = [r for r in got if r["ticker"] == "A" and r["dt"] > DAY + datetime.timedelta(days=90)]
    assert again and all(r["rsi14"] is None for r in sorted(again, key=lambda r: r["dt"])[:14])


def test_stored_models_give_the_labels_of_the_fit(spark, bars_of, walk):
    features = regime_features(indicator_columns(bars_of({"A": walk(200, 3), "B": walk(90, 5)})), "drop")
    model = regimes.fit_models(features, starts=3)
    fitted = {(r["ticker"], r["dt"]): r["regime"] for r in regimes.classify_regimes(features, starts=3).collect()}
    applied = features.join(model, "ticker").withColumn("regime", alert_state.stored_regime([F.col(c) for c in regimes.REGIME_FEATURES]))
    assert {(r["ticker"], r["dt"]): r["regime"] for r in applied.collect()} == fitted


def test_restarts_never_lose_to_one_start(spark, bars_of, walk):
    import numpy as np

    features = regime_features(indicator_columns(bars_of({t: walk(n, s) for t, n, s in (("A", 300, 3), ("B", 120, 5), ("C", 36, 7))})), "drop")
    one = {r["ticker"]: r["inertia"] for r in regimes.fit_models(features, starts=1).collect()}
    many = {r["ticker"]: r for r in regimes.fit_models(features, starts=20).collect()}
    assert all(many[t]["inertia"] <= one[t] + 1e-9 for t in one) and any(many[t]["start"] > 0 for t in one)
    twice = {r["ticker"]: (r["start"], r["inertia"]) for r in regimes.fit_models(features.repartition(7), starts=20).collect()}
    assert twice == {t: (r["start"], r["inertia"]) for t, r in many.items()}
    z = np.zeros((9, 5))
    labels, centers, start, inertia = regimes._best_of_starts(z, np.arange(9), 5)
    assert inertia == 0 and start == 0 and centers.shape == (6, 5) and set(labels) == {0}
