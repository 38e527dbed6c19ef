import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.operators import backtest, compare, forecast, portfolio, research
from tickloom.functions.series import with_position


def preds(bars_of, actual, pred):
    a = bars_of({"A": actual}).select("ticker", "dt", F.col("close").alias("actual"))
    p = bars_of({"A": pred}).select("ticker", "dt", F.col("close").alias("pred"))
    return a.join(p, ["ticker", "dt"])


def test_equity_has_a_point_per_bar_and_starts_at_capital(bars_of, walk):
    rows = backtest.signal_backtest(preds(bars_of, walk(50), walk(50, 9))).orderBy("dt").collect()
    assert len(rows) == 50 and rows[0]["equity"] == 10000 and rows[0]["signal"] == 0


def test_flat_prediction_earns_no_more_than_cash(bars_of, walk):
    out = backtest.signal_metrics(backtest.signal_backtest(preds(bars_of, walk(30), [5] * 30))).first()
    assert out["sharpe"] <= 0 and out["buys"] == out["sells"] == 0


def test_perfect_prediction(bars_of, walk):
    wide = preds(bars_of, walk(30), walk(30)).withColumnRenamed("pred", "m")
    out = backtest.forecast_metrics(forecast.long_predictions(wide, ["m"]), ["ticker", "model"]).where("model = 'm'").first()
    assert out["rmse"] == 0 and out["r2"] == pytest.approx(1) and out["directional_accuracy"] == 100


def test_first_day_is_uncommitted_and_free(bars_of):
    df = bars_of({"A": [100, 110, 121, 121]}).withColumn("regime", F.when(F.col("close") == 121, 4).otherwise(0))
    df = df.withColumn("ret", F.lit(0.1))
    rows = backtest.with_strategy_returns(df, "ret").orderBy("dt").collect()
    assert [r["strat_ret"] for r in rows] == pytest.approx([0.0, 0.1, 0.099, 0.0])
    assert [r["cost"] for r in rows] == pytest.approx([0, 0, 0.001, 0])


def test_rolling_ic_against_brute_force(bars_of, walk):
    closes = walk(90, 5)
    df = bars_of({"A": closes}).withColumn("log_return", F.col("close") / 100 - 1)
    df = df.withColumn("weight", (F.floor(F.col("close") * 7) % 3) / 2.0)
    rows = df.orderBy("dt").collect()

    def ranks(v):
        return [sum(x < y for x in v) + (sum(x == y for x in v) + 1) / 2 for y in v]

    def spearman(x, y):
        a, b = ranks(x), ranks(y)
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        cov = sum((i - ma) * (j - mb) for i, j in zip(a, b))
        return cov / (sum((i - ma) ** 2 for i in a) * sum((j - mb) ** 2 for j in b)) ** 0.5

    got = research.rolling_ic(df).orderBy("dt").collect()
    assert len(got) == 90 - 1 - 60
    for k, r in enumerate(got):
        i = 60 + k
        w = [rows[j]["weight"] for j in range(i - 60, i)]
        f = [rows[j + 1]["log_return"] for j in range(i - 60, i)]
        assert r["ic"] == pytest.approx(spearman(w, f))


def test_constant_weight_has_zero_ic(bars_of, walk):
    df = bars_of({"A": walk(80)}).withColumn("log_return", F.col("close")).withColumn("weight", F.lit(0.5))
    assert {r["ic"] for r in research.rolling_ic(df).collect()} == {0.0}


@pytest.mark.parametrize("t, dof, p", [(2.0, 10, 0.0733880), (1.0, 1, 0.5), (0.0, 5, 1.0), (12.706205, 1, 0.05), (-2.570582, 5, 0.05)])
def test_student_tail(t, dof, p):
    assert research._two_sided_p(t, dof) == pytest.approx(p, abs=1e-6)


def test_split_is_chronological(bars_of, walk):
    df = with_position(bars_of({"A": walk(101)}), count="n")
    counts = {r["split"]: r["count"] for r in forecast.with_split(df).groupBy("split").count().collect()}
    assert counts == {"train": 70, "val": 15, "test": 16}


def test_scaler_sees_train_rows_only(bars_of):
    df = forecast.with_split(with_position(bars_of({"A": range(100)}), count="n"))
    out = forecast.minmax_train_only(df, ["close"]).agg(F.max("close_scaled")).first()[0]
    assert out > 1.0


def test_sequences_reach_back_and_have_full_length(bars_of):
    df = forecast.with_split(with_position(bars_of({"A": range(100)}), count="n")).withColumn("target", F.col("close"))
    out = forecast.make_sequences(df, ["close"], 10).orderBy("dt").collect()
    # 90 anchors less none for train/val; the test block starts 10 rows into val.
    assert [int(r["target"]) for r in out] == list(range(10, 100))
    assert all([int(x[0]) for x in r["x"]] == list(range(int(r["target"]) - 10, int(r["target"]))) for r in out)


def test_correlation_is_symmetric_with_unit_diagonal(bars_of, walk):
    df = bars_of({"A": walk(60), "B": walk(60, 7)}).withColumn("log_return", F.log("close"))
    m = {(r["ticker_a"], r["ticker_b"]): r["correlation"] for r in compare.return_correlation(df).collect()}
    assert m["A", "A"] == m["B", "B"] == 1.0 and m["A", "B"] == m["B", "A"] and abs(m["A", "B"]) <= 1


def test_request_is_trimmed_upper_and_whole():
    assert compare.normalise_request([" aapl ", "", "spy"]) == ["AAPL", "SPY"]
    assert len(compare.normalise_request([f"t{i}" for i in range(30)])) == 30
    with pytest.raises(ValueError):
        compare.normalise_request(["  "])


def test_prices_start_at_hundred_and_first_return_is_zero(bars_of, walk):
    df = bars_of({"A": walk(10), "B": walk(12, 4)})
    aligned = compare.align_panel(df)
    assert aligned.count() == 20
    first = compare.normalised_prices(aligned).orderBy("dt").first()
    assert first["value"] == 100.0
    assert compare.daily_returns_pct(aligned).orderBy("dt").first()["return_pct"] == 0.0


def test_portfolio_weights_and_ordering(bars_of, walk):
    df = bars_of({t: walk(200, i + 2) for i, t in enumerate("ABC")})
    df = df.withColumn("log_return", F.col("close") / 100 - 1)
    cand = portfolio.candidate_portfolios(df, 200)
    rows = cand.collect()
    assert len(rows) == 200 and all(sum(r["weights"]) == pytest.approx(1) for r in rows)
    best = {r["portfolio"]: r for r in portfolio.best_portfolios(cand, df).collect()}
    assert best["max_sharpe"]["sharpe_ratio"] == pytest.approx(max(r["sharpe"] for r in rows), abs=1e-4)
    assert best["min_volatility"]["volatility"] == pytest.approx(min(r["vol"] for r in rows), abs=1e-4)
    vols = [r["volatility"] for r in portfolio.efficient_frontier(cand, 20).collect()]
    assert vols == sorted(set(vols)) and len(vols) <= 20


def test_comparison_reports_what_is_missing(bars_of, walk):
    from tickloom.operators.indicators import engineer_features

    feats = engineer_features(bars_of({"AA": walk(80), "BB": walk(80, 3), "CC": walk(20, 4)}))
    out = compare.comparison(feats, ["aa ", "bb", "cc", "zz"])
    assert {r["ticker"] for r in out["errors"].collect()} == {"CC", "ZZ"}
    assert out["correlation"].count() == 4 and out["summary"].count() == 2
    assert out["date_range"].first()["trading_days"] == 66
    with pytest.raises(ValueError):
        compare.comparison(feats, ["zz"])
    with pytest.raises(ValueError):
        compare.comparison(feats, ["cc"])


def test_missing_columns_take_defaults(spark, bars_of):
    from tickloom.sources.bars import normalise_bars

    raw = bars_of({"A": [1, None, 3]}).select("ticker", "dt", F.col("close").alias("Adj Close"))
    rows = normalise_bars(raw).orderBy("dt").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rows] == [(1, 1, 1, 1, 0), (3, 3, 3, 3, 0)]


def test_single_value_scales(spark):
    df = spark.createDataFrame([(4.0, 2.0, 8.0, 3.0, 2.0)], "v double, c_min double, c_range double, c_mean double, c_scale double")
    row = df.select(forecast.scale_single(F.col("v"), "c").alias("a"), forecast.scale_single(F.col("v"), "c", "standard").alias("b")).first()
    assert row["a"] == 0.25 and row["b"] == pytest.approx(0.5)


def test_series_without_spread_keep_their_row(spark):
    day = lambda i: datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
    rows = [("flat", day(i), 0.25) for i in range(10)] + [("two", day(i), 0.1 * i) for i in range(2)]
    rows += [("moving", day(i), 0.1 * (i % 4) - 0.1) for i in range(10)]
    ics = spark.createDataFrame(rows, "ticker string, dt date, ic double")
    got = {r["ticker"]: r for r in research.with_p_value(research.ic_summary(ics)).collect()}
    assert (got["flat"]["t_stat"], got["flat"]["p_value"]) == (0.0, 1.0) and got["two"]["p_value"] == 1.0
    assert not got["flat"]["significant"] and got["moving"]["t_stat"] > 0


def test_matrix_of_many_tickers_equals_numpy(bars_of, walk, monkeypatch):
    import numpy as np

    monkeypatch.setattr(compare, "TILE", 4)
    series = {f"T{i:02}": walk(40, i + 2) for i in range(15)} | {"FLAT": [5.0] * 40}
    df = bars_of(series).withColumn("log_return", F.col("close") / 100 - 1)
    names = sorted(series)
    x = np.array([series[t] for t in names]) / 100 - 1
    cov = {(r["ticker_a"], r["ticker_b"]): r["cov"] for r in compare.pairwise(df, "log_return", "covariance", "cov").collect()}
    assert len(cov) == 256
    want = np.cov(x)
    assert all(cov[a, b] == pytest.approx(want[i, j], abs=1e-12) for i, a in enumerate(names) for j, b in enumerate(names))
    corr = {(r["ticker_a"], r["ticker_b"]): r["correlation"] for r in compare.return_correlation(df).collect()}
    assert corr["FLAT", "T00"] is None and corr["T00", "T00"] == 1.0
