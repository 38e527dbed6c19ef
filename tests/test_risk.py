"""Portfolio risk against plain numpy."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import portfolio, risk


@pytest.fixture(scope="module")
def panel(spark, bars_of, walk):
    names = ["A", "B", "C", "D"]
    bars = bars_of({t: walk(150, 3 + 2 * i) for i, t in enumerate(names)})
    rows = bars.select("ticker", "dt", "close")
    w = F.log("close") - F.lag(F.log("close")).over(portfolio_window())
    closes = np.array([walk(150, 3 + 2 * i) for i in range(4)]).T
    return names, closes, rows, rows.withColumn("log_return", w).where(F.col("log_return").isNotNull()).cache()


def portfolio_window():
    from tickloom.functions.series import by_ticker

    return by_ticker()


def test_drift_restarts_every_month(spark, panel):
    names, closes, rows, _ = panel
    share = [0.4, 0.3, 0.2, 0.1]
    targets = spark.createDataFrame([("p", t, s) for t, s in zip(names, share, strict=True)], "portfolio string, ticker string, target double")
    drift = risk.rebalance_drift(rows, targets)
    got = {(r["dt"], r["ticker"]): r for r in drift.collect()}
    held = np.array(share)
    for i in range(150):
        day = datetime.date(2020, 1, 1) + datetime.timedelta(days=i)
        if i:
            held = held * closes[i] / closes[i - 1]
            held = held / held.sum()
        fresh = i == 0 or day.day == 1
        for t, h, s in zip(names, held, share, strict=True):
            assert abs(got[day, t]["weight"] - h) < 1e-12 and abs(got[day, t]["drift"] - (h - s)) < 1e-12 and got[day, t]["rebalanced"] == fresh
        if fresh:
            held = np.array(share)
    trades = risk.rebalance_turnover(drift).collect()
    assert len(trades) == 5 and min(r["turnover"] for r in trades) < 1e-15 and all(r["largest_drift"] <= 2 * r["turnover"] + 1e-12 for r in trades)


@pytest.mark.parametrize(("portfolios", "dates"), [(128, 512), (2, 7)])
def test_returns_and_tails(spark, panel, monkeypatch, portfolios, dates):
    monkeypatch.setattr(portfolio, "TILE_PORTFOLIOS", portfolios)
    monkeypatch.setattr(portfolio, "TILE_DATES", dates)
    names, closes, _, returns = panel
    draw = np.random.default_rng(3)
    w = draw.dirichlet(np.ones(4), 5)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "portfolio long, weights array<double>")
    r = np.diff(np.log(closes), axis=0) @ w.T
    got = {(x["portfolio"], x["dt"]): x["ret"] for x in portfolio.portfolio_returns(vectors, returns).collect()}
    assert len(got) == r.size
    for i in range(149):
        day = datetime.date(2020, 1, 2) + datetime.timedelta(days=i)
        assert np.allclose([got[p, day] for p in range(5)], r[i])
    scores = spark.createDataFrame([(t, float(i)) for i, t in enumerate(names)], "ticker string, risk_score double")
    for row in risk.tail_risk(vectors, returns, scores).collect():
        mine = r[:, row["portfolio"]]
        q = np.quantile(mine, 0.05)
        assert np.allclose([row["value_at_risk"], row["expected_shortfall"], row["risk_score"]], [-q, -mine[mine <= q].mean(), w[row["portfolio"]] @ np.arange(4)])


def test_shock_is_the_conditional_expectation(spark, panel):
    names, closes, _, returns = panel
    cov = np.cov(np.diff(np.log(closes), axis=0).T)
    long = portfolio.mean_cov_annual(returns).select("ticker_a", "ticker_b", "cov")
    shocks = spark.createDataFrame([("B", -0.2), ("D", 0.1)], "ticker string, shock double")
    got = {r["ticker"]: r["expected_move"] for r in risk.shock_scenario(long, shocks).collect()}
    s = [1, 3]
    want = cov[:, s] @ np.linalg.solve(cov[np.ix_(s, s)], [-0.2, 0.1])
    assert np.allclose([got[t] for t in names], want) and got["B"] == -0.2


def test_rolling_beta(spark, panel):
    _, closes, _, returns = panel
    bench = returns.where("ticker = 'A'").select("dt", F.col("log_return").alias("bench_ret"))
    out = risk.rolling_beta(returns.join(bench, "dt"), [2, 20, 149, 400]).where("ticker = 'C'").orderBy("dt").collect()
    r = np.diff(np.log(closes), axis=0)
    for i, row in enumerate(out):
        for n in (2, 20, 149):
            if i + 1 < n:
                assert row[f"beta{n}"] is None
            else:
                x, y = r[i + 1 - n : i + 1, 0], r[i + 1 - n : i + 1, 2]
                assert abs(row[f"beta{n}"] - np.cov(x, y, ddof=0)[0, 1] / x.var()) < 1e-6
        assert row["beta400"] is None


def test_deflated_sharpe(spark, panel):
    _, _, _, returns = panel
    rows = returns.withColumn("regime", (F.dayofyear("dt") % 6).cast("int"))
    lucky = rows.where("ticker = 'A'").withColumns({"ticker": F.lit("up"), "regime": F.lit(0), "log_return": F.col("log_return") * 0.05 + 0.01})
    flat = rows.where("ticker = 'A'").withColumns({"ticker": F.lit("flat"), "log_return": F.lit(0.0)})
    got = {r["ticker"]: r for r in risk.deflated_sharpe(rows.unionByName(lucky).unionByName(flat)).collect()}
    assert got["up"]["deflated_sharpe"] > 0.99 and all(0 <= got[t]["deflated_sharpe"] <= 1 for t in "ABCD")
    assert got["flat"]["sharpe_daily"] == 0 or got["flat"]["deflated_sharpe"] is None
    assert risk.expected_maximum(1) == 0 and risk.expected_maximum(10) < risk.expected_maximum(100)
