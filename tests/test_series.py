import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.functions.series import fill_both_ways, full_window, ema_groups, midrank, with_ema, with_position
from tickloom.operators import cleaning
from tickloom.operators.indicators import (
    drawdown_pct, engineer_features, equity_curve, regime_features, with_macd, with_rsi,
)


def column(df, name):
    return [r[name] for r in df.orderBy("ticker", "dt").collect()]


@pytest.mark.parametrize("span", [1, 2, 3, 9, 26, 200, 500])
def test_ema_crosses_blocks(bars_of, walk, span):
    closes = walk(6000)
    df = with_ema(with_position(bars_of({"A": closes, "B": closes[:5]})), {"e": ("close", span)})
    want, alpha = [closes[0]], 2.0 / (span + 1)
    for c in closes[1:]:
        want.append(want[-1] + alpha * (c - want[-1]))
    got = column(df.where("ticker = 'A'"), "e")
    assert got == pytest.approx(want, rel=1e-12)
    assert column(df.where("ticker = 'B'"), "e") == pytest.approx(want[:5], rel=1e-12)


def test_averages_of_far_spans_together(bars_of, walk):
    closes = walk(6000)
    specs = {f"e{s}": ("close", s) for s in (1, 2, 12, 26, 500)}
    assert len(ema_groups({n: s for n, s in specs.items() if s[1] > 1})) > 1
    df = with_ema(with_position(bars_of({"A": closes})), specs)
    assert df.columns[-5:] == list(specs)
    for name, (_, span) in specs.items():
        e, alpha = closes[0], 2.0 / (span + 1)
        for c in closes[1:]:
            e += alpha * (c - e)
        assert column(df, name)[-1] == pytest.approx(e, rel=1e-12)


def test_rsi_starts_after_fourteen_changes_and_is_a_simple_mean(bars_of):
    closes = [100 + (i % 3) for i in range(20)]
    got = column(with_rsi(bars_of({"A": closes})), "rsi14")
    assert got[:14] == [None] * 14 and got[14] is not None
    delta = [closes[i] - closes[i - 1] for i in range(1, 15)]
    gain, loss = sum(max(d, 0) for d in delta) / 14, sum(max(-d, 0) for d in delta) / 14
    assert got[14] == pytest.approx(100 - 100 / (1 + gain / (loss + 1e-9)))


def test_rsi_limits(bars_of):
    up, down = list(range(1, 40)), list(range(40, 1, -1))
    df = with_rsi(bars_of({"D": down, "U": up}))
    assert column(df.where("ticker = 'U'"), "rsi14")[-1] > 99
    assert column(df.where("ticker = 'D'"), "rsi14")[-1] < 1


def test_macd_histogram_is_difference(bars_of, walk):
    for r in with_macd(with_position(bars_of({"A": walk(80)}))).collect():
        assert r["macd_hist"] == pytest.approx(r["macd"] - r["macd_signal"])


def test_window_needs_all_rows(bars_of):
    df = bars_of({"A": [1, 2, 3, 4]}).withColumn("m", full_window(F.col("close"), F.avg, 3))
    assert column(df, "m") == [None, None, 2.0, 3.0]


def test_fill_forward_then_back(bars_of):
    df = bars_of({"A": [None, 5, None, 7, None], "B": [None, None]})
    df = df.withColumn("f", fill_both_ways(F.col("close")))
    assert column(df, "f") == [5, 5, 5, 7, 7, None, None]


def test_midrank_of_ties(bars_of):
    df = bars_of({"A": [3, 1, 3, 2]}).withColumn("r", midrank("close", ["ticker"]))
    assert column(df, "r") == [3.5, 1.0, 3.5, 2.0]


def test_features_have_no_nulls_and_monday_is_zero(bars_of, walk):
    rows = engineer_features(bars_of({"A": walk(60)})).collect()
    assert len(rows) == 46 and all(v is not None for r in rows for v in r)
    assert all(r["day_of_week"] == r["dt"].weekday() for r in rows)
    assert min(r["seq"] for r in rows) == 0


def test_regime_features_warm_up(bars_of, walk):
    feats = engineer_features(bars_of({"A": walk(60)}))
    filled = column(regime_features(feats, "bfill"), "vol20")
    assert len(filled) == 46 and len(set(filled[:20])) == 1
    assert regime_features(feats, "drop").count() == 46 - 19


def test_equity_and_drawdown(bars_of):
    df = bars_of({"A": [0.0, 0.1, -0.5, 0.2]}).withColumn("eq", equity_curve("close"))
    df = df.withColumn("dd", drawdown_pct("eq"))
    assert column(df, "eq") == pytest.approx([10000, 11000, 5500, 6600])
    assert column(df, "dd") == pytest.approx([0, 0, -50, -40])


def test_outlier_is_dropped_and_tails_clipped(bars_of, walk):
    closes = walk(100)
    closes[50] *= 10
    kept = cleaning.drop_outliers(bars_of({"A": closes}))
    assert kept.where(F.col("close") > 500).count() == 0
    clipped = cleaning.winsorize(kept)
    assert column(clipped.agg(F.max("close").alias("close"), F.lit("A").alias("ticker"), F.lit(datetime.date(2020, 1, 1)).alias("dt")), "close")[0] < kept.agg(F.max("close")).first()[0]


def test_first_copy_wins_whatever_the_number_of_copies(spark, bars_of):
    df = bars_of({"A": [1, 2]})
    copies = df.withColumn("ingest_seq", F.explode(F.sequence(F.lit(1), F.lit(500))))
    copies = copies.withColumn("close", F.col("close") * F.col("ingest_seq"))
    assert sorted(column(cleaning.keep_first_copy(copies), "close")) == [1, 2]
