"""Strategy returns, back-tests and performance ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.constants import INITIAL_CAPITAL, RISK_FREE_ANNUAL, RISK_FREE_DAILY, TRADING_DAYS, TRANSACTION_COST
from tickloom.functions.series import by_ticker, downsample, running, sharpe
from tickloom.functions.stats import slope


def regime_weight(regime: Column, bull: float = 1.0, neutral: float = 0.5) -> Column:
    """Equity share per regime: full in 0 and 3, partial in 1 and 2, none in 4 and 5."""
    return F.when(regime.isin(0, 3), F.lit(bull)).when(regime.isin(1, 2), F.lit(neutral)).otherwise(F.lit(0.0))


def with_strategy_returns(df: DataFrame, returns: str, cost: float = TRANSACTION_COST) -> DataFrame:
    """Add weight, its change, the cost and the strategy return.

    ``returns`` names the daily return column: simple returns in the service
    back-test, log returns (compounded as they are) in the report.
    """
    df = df.withColumn("weight", regime_weight(F.col("regime")))
    df = df.withColumn("prev_weight", F.lag("weight").over(by_ticker()))
    df = df.withColumn("weight_change", F.coalesce(F.abs(F.col("weight") - F.col("prev_weight")), F.lit(0.0)))
    df = df.withColumn("cost", F.col("weight_change") * cost)
    strat = F.coalesce(F.col("prev_weight"), F.lit(0.0)) * F.col(returns) - F.col("cost")
    return df.withColumn("strat_ret", strat)


def with_equity(df: DataFrame, columns: dict[str, str], capital: float = INITIAL_CAPITAL) -> DataFrame:
    """Add equity curves ``{name: returns column}`` and their drawdowns ``<name>_dd`` as fractions."""
    df = df.withColumns(
        {name: F.lit(capital) * F.product(1.0 + F.col(ret)).over(running()) for name, ret in columns.items()}
    )
    out = {}
    for name in columns:
        peak = F.max(name).over(running())
        out[f"{name}_dd"] = F.try_divide(F.col(name) - peak, peak)
    return df.withColumns(out)


def regime_backtest_frame(df: DataFrame) -> DataFrame:
    """Daily returns and equity of regime allocation and of buy and hold; needs ``close`` and ``regime``."""
    ret = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1, F.lit(0.0))
    df = with_strategy_returns(df.select("ticker", "dt", "close", "regime").withColumn("ret", ret), "ret")
    return with_equity(df, {"bh_equity": "ret", "strat_equity": "strat_ret"})


def regime_backtest_curves(df: DataFrame, points: int = 200) -> DataFrame:
    return downsample(regime_backtest_frame(df), points).select(
        "ticker", "dt", F.round("bh_equity", 2).alias("benchmark_equity"), F.round("strat_equity", 2).alias("strategy_equity")
    )


def regime_backtest_metrics(df: DataFrame) -> DataFrame:
    """Regime allocation against buy and hold, one row per ticker."""
    df = regime_backtest_frame(df)
    active = F.col("prev_weight") > 0
    won = F.avg(F.when(active, F.when(F.col("strat_ret") > 0, 1.0).otherwise(0.0))) * 100.0
    return df.groupBy("ticker").agg(
        F.round((F.max_by("bh_equity", "dt") / INITIAL_CAPITAL - 1) * 100, 2).alias("benchmark_total_return"),
        F.round((F.max_by("strat_equity", "dt") / INITIAL_CAPITAL - 1) * 100, 2).alias("strategy_total_return"),
        F.round(F.min("bh_equity_dd") * 100.0, 2).alias("benchmark_max_drawdown"),
        F.round(F.min("strat_equity_dd") * 100.0, 2).alias("strategy_max_drawdown"),
        F.round(sharpe(F.col("ret"), "sample0"), 2).alias("benchmark_sharpe"),
        F.round(sharpe(F.col("strat_ret"), "sample0"), 2).alias("strategy_sharpe"),
        F.round(F.coalesce(won, F.lit(0.0)), 1).alias("strategy_win_rate"),
        F.round(F.sum("cost") * 100, 4).alias("total_transaction_cost_pct"),
        F.count_if(F.col("weight_change") > 0).alias("n_trades"),
        F.lit(RISK_FREE_ANNUAL).alias("risk_free_rate_annual"),
    )


def signal_backtest(preds: DataFrame) -> DataFrame:
    """Trade the sign of the change of ``pred`` on ``actual``; one row per bar."""
    signal = F.coalesce(F.signum(F.col("pred") - F.lag("pred").over(by_ticker())), F.lit(0.0))
    before = F.lag("actual").over(by_ticker())
    ret = F.coalesce((F.col("actual") - before) / (before + 1e-9), F.lit(0.0))
    df = preds.select("ticker", "dt", "actual", "pred").withColumns({"signal": signal, "ret": ret})
    df = df.withColumn("strat_ret", F.col("ret") * F.col("signal"))
    return df.withColumns(
        {
            "equity": F.lit(INITIAL_CAPITAL) * F.product(1.0 + F.col("strat_ret")).over(running()),
            "buy": F.when(F.col("signal") > 0, F.col("actual")),
            "sell": F.when(F.col("signal") < 0, F.col("actual")),
        }
    )


def signal_metrics(traded: DataFrame) -> DataFrame:
    grow = lambda c: (F.try_divide(F.max_by(c, "dt"), F.min_by(c, "dt")) - 1) * 100
    return traded.groupBy("ticker").agg(
        sharpe(F.col("strat_ret"), "pop9").alias("sharpe"),
        grow("equity").alias("total_return_pct"),
        grow("actual").alias("buy_hold_return_pct"),
        F.count("buy").alias("buys"),
        F.count("sell").alias("sells"),
    )


def forecast_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """RMSE, MAE, MAPE, R2 and directional accuracy per group of ``keys``.

    Needs ``actual``, ``pred`` and their changes ``d_actual`` and ``d_pred``.
    """
    err = F.col("actual") - F.col("pred")
    total = F.var_pop("actual") * F.count("actual") + 1e-9
    same = F.signum("d_actual") == F.signum("d_pred")
    return preds.groupBy(*keys).agg(
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.avg(F.abs(err / (F.col("actual") + 1e-9))) * 100).alias("mape"),
        (1 - F.sum(err * err) / total).alias("r2"),
        (F.avg(F.when(same, 1.0).when(~same, 0.0)) * 100).alias("directional_accuracy"),
    )


# ---------------------------------------------------------------------------
# Report metrics
# ---------------------------------------------------------------------------

def strategy_frame(regimes: DataFrame) -> DataFrame:
    """Report rows with strategy returns on log returns and both equity curves."""
    df = with_strategy_returns(regimes, "log_return")
    df = with_equity(df, {"equity": "strat_ret", "bh_equity": "log_return"})
    guarded = {}
    for name in ("equity", "bh_equity"):
        peak = F.max(name).over(running())
        guarded[f"{name}_dd"] = (F.col(name) - peak) / (peak + 1e-12)
    return df.withColumns(guarded)


def _sortino(returns: str) -> Column:
    value = F.col(returns)
    down = F.when(value < 0, value)
    spread = F.when(F.count(down) > 1, F.stddev_pop(down)).otherwise(F.lit(1e-9))
    return F.avg(value - RISK_FREE_DAILY) / (spread + 1e-12) * F.sqrt(F.lit(float(TRADING_DAYS)))


def _cagr(equity: str) -> Column:
    growth = F.try_divide(F.max_by(equity, "dt"), F.min_by(equity, "dt"))
    return (F.pow(growth, F.lit(float(TRADING_DAYS)) / F.count(equity)) - 1) * 100


def alpha_beta() -> dict[str, Column]:
    beta = slope(F.col("strat_ret"), F.col("bench_ret"))
    excess = F.avg("strat_ret") - RISK_FREE_DAILY - beta * (F.avg("bench_ret") - RISK_FREE_DAILY)
    return {"beta": beta, "alpha": excess * TRADING_DAYS * 100}


def performance(df: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """All scalar report metrics of a strategy frame in one aggregate per ticker."""
    columns = {
        "n_trading_days": F.count(F.lit(1)),
        "sharpe_ratio": sharpe(F.col("strat_ret"), "pop"),
        "sortino_ratio": _sortino("strat_ret"),
        "max_drawdown": F.min("equity_dd") * 100,
        "cagr": _cagr("equity"),
        **alpha_beta(),
        "sharpe_bh": sharpe(F.col("log_return"), "pop"),
        "mdd_bh": F.min("bh_equity_dd") * 100,
        "cagr_bh": _cagr("bh_equity"),
        **(extra or {}),
    }
    out = df.groupBy("ticker").agg(*[c.alias(n) for n, c in columns.items()])
    calmar = F.when(F.col("max_drawdown") != 0, F.col("cagr") / F.abs("max_drawdown")).otherwise(F.lit(0.0))
    return out.withColumn("calmar_ratio", calmar)
