"""Portfolio risk: drift between rebalancing dates, historical tail losses, shocks, rolling beta, deflated Sharpe."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.constants import RISK_FREE_DAILY, WALK_FORWARD_GRID
from tickloom.functions.series import by_ticker, running
from tickloom.operators.backtest import regime_weight
from tickloom.operators.portfolio import portfolio_returns

#: Instruments that may be shocked at once: their covariances meet in one task.
MOST_SHOCKED = 2_000
EULER = 0.5772156649015329


def rebalance_drift(prices: DataFrame, targets: DataFrame) -> DataFrame:
    """Weights as prices carry them away from their targets, set back at the first date of every month.

    ``prices``: ticker, dt, close on dates that all tickers share; ``targets``: portfolio, ticker, target (sums to 1).
    Gives portfolio, ticker, dt, weight before the day's trades, drift from the target, and whether the day rebalances.
    Since the last rebalancing an instrument has grown by close over the close of that date, so the weight is a segmented
    scan over each series and one sum per portfolio and date.
    """
    fresh = F.coalesce(F.trunc("dt", "month") != F.trunc(F.lag("dt").over(by_ticker()), "month"), F.lit(True))
    df = prices.select("ticker", "dt", "close").withColumn("rebalanced", fresh)
    earlier = by_ticker().rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(F.col("rebalanced"), F.col("close")), ignorenulls=True).over(earlier)
    df = df.withColumn("_growth", F.coalesce(F.try_divide(F.col("close"), base), F.lit(1.0)))
    held = df.join(targets, "ticker").withColumn("_value", F.col("target") * F.col("_growth"))
    totals = held.groupBy("portfolio", "dt").agg(F.sum("_value").alias("_total"))
    held = held.join(totals, ["portfolio", "dt"]).withColumn("weight", F.try_divide(F.col("_value"), F.col("_total")))
    return held.select("portfolio", "ticker", "dt", "weight", (F.col("weight") - F.col("target")).alias("drift"), "rebalanced")


def rebalance_turnover(drift: DataFrame) -> DataFrame:
    """What each rebalancing trades: half the sum of absolute drifts per portfolio and date."""
    days = drift.where("rebalanced").groupBy("portfolio", "dt")
    return days.agg((F.sum(F.abs("drift")) / 2).alias("turnover"), F.max(F.abs("drift")).alias("largest_drift"))


def tail_risk(vectors: DataFrame, returns: DataFrame, scores: DataFrame, level: float = 0.05) -> DataFrame:
    """Historical value at risk, expected shortfall and weighted risk score of every portfolio.

    ``vectors`` and ``returns`` as in ``portfolio_returns``; ``scores``: ticker, risk_score of the same instruments.  The
    quantile is exact, by linear interpolation; the shortfall is the mean of the returns up to it.  A portfolio has at
    most one return per calendar day, so its sorted returns are one bounded array.
    """
    series = portfolio_returns(vectors, returns).groupBy("portfolio").agg(F.array_sort(F.collect_list("ret")).alias("r"))
    n = F.size("r")
    at = F.lit(level) * (n - 1)
    low = F.floor(at).cast("int")
    under, over = F.get("r", low), F.coalesce(F.get("r", low + 1), F.get("r", low))
    quantile = under + (over - under) * (at - low)
    out = series.withColumn("q", quantile).withColumns(
        {"tail": F.filter("r", lambda x: x <= F.col("q")), "days": n.cast("long")}
    )
    mean = F.aggregate("tail", F.lit(0.0), lambda a, x: a + x) / F.size("tail")
    cells = F.array_sort(F.collect_list(F.struct("ticker", "risk_score")))
    one = scores.agg(F.transform(cells, lambda c: c["risk_score"]).alias("s"))  # one row
    weighted = F.aggregate(F.zip_with("weights", "s", lambda w, s: w * s), F.lit(0.0), lambda a, x: a + x)
    risk = vectors.join(F.broadcast(one)).select("portfolio", weighted.alias("risk_score"))
    return out.join(risk, "portfolio").select(
        "portfolio", "days", (-F.col("q")).alias("value_at_risk"), (-mean).alias("expected_shortfall"), "risk_score"
    )


def shock_scenario(covariances: DataFrame, shocks: DataFrame) -> DataFrame:
    """What shocks to some instruments mean for all: ticker, shock given (null: none), expected move.

    ``covariances``: ticker_a, ticker_b, cov; ``shocks``: ticker, shock.  The expectation of the others given the shocked
    ones is cov(u, S) cov(S, S)^-1 shock.  The small system over S is solved once, by a Cholesky factor; each instrument
    then sums over its row of covariances.  Shocked instruments move by their shock.
    """
    inside = covariances.join(shocks.select(F.col("ticker").alias("ticker_a"), F.col("shock").alias("_shock")), "ticker_a")
    inside = inside.join(shocks.select(F.col("ticker").alias("ticker_b")), "ticker_b", "left_semi")
    count = shocks.count()
    if count > MOST_SHOCKED:
        raise ValueError(f"{count} instruments are shocked, at most {MOST_SHOCKED} can be")

    def solve(rows: pa.Table) -> pa.Table:
        names = sorted(set(rows["ticker_a"].to_pylist()))
        place = {t: i for i, t in enumerate(names)}
        a, b = ([place[t] for t in rows[c].to_pylist()] for c in ("ticker_a", "ticker_b"))
        matrix, move = np.zeros((len(names), len(names))), np.zeros(len(names))
        matrix[a, b] = rows["cov"].to_numpy()
        move[a] = rows["_shock"].to_numpy()
        factor = np.linalg.cholesky(matrix)
        y = np.linalg.solve(factor.T, np.linalg.solve(factor, move))
        return pa.table({"ticker_b": pa.array(names, pa.string()), "_y": pa.array(y)})

    solved = inside.groupBy(F.lit(1).alias("_all")).applyInArrow(solve, "ticker_b string, _y double")
    moved = covariances.join(solved, "ticker_b").groupBy("ticker_a").agg(F.sum(F.col("cov") * F.col("_y")).alias("expected_move"))
    out = moved.withColumnRenamed("ticker_a", "ticker").join(shocks.select("ticker", "shock"), "ticker", "left")
    return out.select("ticker", "shock", F.coalesce("shock", "expected_move").alias("expected_move"))


def rolling_beta(df: DataFrame, windows: list[int], value: str = "log_return", benchmark: str = "bench_ret") -> DataFrame:
    """Beta of a series to its benchmark over several trailing windows: ``beta<n>``, null until a window is full.

    Four running sums per series serve all windows: a window's moments are a difference of two of their values, so a
    window of a thousand rows costs what one of ten does.
    """
    x, y = F.col(benchmark), F.col(value)
    parts = {"_x": x, "_y": y, "_xx": x * x, "_xy": x * y}
    df = df.withColumns({f"{n}_sum": F.sum(c).over(running()) for n, c in parts.items()} | {"_rows": F.count(F.lit(1)).over(running())})
    out = {}
    for n in windows:
        inside = {p: F.col(f"{p}_sum") - F.coalesce(F.lag(f"{p}_sum", n).over(by_ticker()), F.lit(0.0)) for p in parts}
        cov, var = inside["_xy"] - inside["_x"] * inside["_y"] / n, inside["_xx"] - inside["_x"] * inside["_x"] / n
        out[f"beta{n}"] = F.when(F.col("_rows") >= n, F.try_divide(cov, var))
    return df.withColumns(out).drop("_rows", *[f"{p}_sum" for p in parts])


def expected_maximum(trials: int) -> float:
    """Expected maximum of that many standard normal trials (extreme value approximation)."""
    if trials < 2:
        return 0.0
    inverse = NormalDist().inv_cdf
    return (1 - EULER) * inverse(1 - 1 / trials) + EULER * inverse(1 - 1 / (trials * math.e))


def _normal_cdf() -> Column:
    @F.pandas_udf("double")
    def phi(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if v != v else NormalDist().cdf(v))

    return phi


def deflated_sharpe(df: DataFrame, grid: list[tuple[float, float]] = WALK_FORWARD_GRID) -> DataFrame:
    """The probability that the best of several tried strategies has skill at all, per ticker.

    Every (bull, neutral) weight pair of ``grid`` is a trial over the whole series (``regime``, ``log_return``).  The
    best Sharpe (per day; the first pair on ties) is held against the maximum that as many trials of no skill would
    show, given their spread, and against its own skewness and kurtosis.  One aggregate per ticker and one row a ticker.
    """
    tries = range(len(grid))
    returns = {f"_r{i}": F.coalesce(F.lag(regime_weight(F.col("regime"), *grid[i])).over(by_ticker()), F.lit(0.0)) * F.col("log_return") - RISK_FREE_DAILY for i in tries}
    df = df.select("ticker", "dt", "regime", "log_return").withColumns(returns)
    out = df.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("days"),
        *[F.coalesce(F.try_divide(F.avg(f"_r{i}"), F.stddev_pop(f"_r{i}")), F.lit(0.0)).alias(f"_s{i}") for i in tries],
        *[F.skewness(f"_r{i}").alias(f"_g{i}") for i in tries], *[F.kurtosis(f"_r{i}").alias(f"_k{i}") for i in tries],
    )
    keys = [F.struct(F.round(f"_s{i}", 12).alias("s"), F.lit(-i).alias("i")) for i in tries]
    out = out.withColumn("_best", -F.greatest(*keys)["i"] if len(grid) > 1 else F.lit(0))
    pick = lambda p: F.element_at(F.array(*[F.col(f"_{p}{i}") for i in tries]), F.col("_best") + 1)
    mean = sum((F.col(f"_s{i}") for i in tries), F.lit(0.0)) / len(grid)
    spread = F.sqrt(sum((F.pow(F.col(f"_s{i}") - mean, 2) for i in tries), F.lit(0.0)) / max(len(grid) - 1, 1))
    out = out.select(
        "ticker", "days", F.lit(len(grid)).cast("long").alias("trials"), F.col("_best").alias("best"), pick("s").alias("sharpe_daily"),
        (spread * expected_maximum(len(grid))).alias("expected_max"), pick("g").alias("skewness"), pick("k").alias("excess_kurtosis"),
    )
    s = F.col("sharpe_daily")
    width = F.sqrt(1 - F.col("skewness") * s + (F.col("excess_kurtosis") + 2) / 4 * s * s)
    z = F.try_divide((s - F.col("expected_max")) * F.sqrt(F.col("days") - 1), width)
    return out.withColumn("deflated_sharpe", _normal_cdf()(z))
