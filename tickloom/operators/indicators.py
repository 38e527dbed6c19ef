"""Technical indicators over bar series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.constants import INITIAL_CAPITAL, REGIME_FEATURES, TRADING_DAYS
from tickloom.functions.series import (
    by_ticker, fill_both_ways, finite_or_null, full_window, running, sharpe, with_ema, with_position,
)


def pct_return(n: int = 1, value: str = "close") -> Column:
    return F.try_divide(F.col(value), F.lag(value, n).over(by_ticker())) - 1


def log_return(value: str = "close") -> Column:
    return F.log(value) - F.lag(F.log(value)).over(by_ticker())


def day_of_week() -> Column:
    """Monday is 0."""
    return F.weekday("dt")


def with_rsi(df: DataFrame, window: int = 14, name: str = "rsi14") -> DataFrame:
    """Relative strength from simple means of the last ``window`` gains and losses."""
    delta = F.col("close") - F.lag("close").over(by_ticker())
    df = df.withColumn("_delta", delta)
    gain = full_window(F.greatest(F.col("_delta"), F.when(F.col("_delta").isNotNull(), F.lit(0.0))), F.avg, window)
    loss = full_window(F.greatest(-F.col("_delta"), F.when(F.col("_delta").isNotNull(), F.lit(0.0))), F.avg, window)
    return df.withColumn(name, 100.0 - 100.0 / (1.0 + gain / (loss + 1e-9))).drop("_delta")


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD line, signal and histogram; needs ``seq``."""
    df = with_ema(df, {"_fast": ("close", fast), "_slow": ("close", slow)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = with_ema(df, {"macd_signal": ("macd", signal)})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def indicator_columns(bars: DataFrame) -> DataFrame:
    """Every indicator on every row, warm-up rows included (null there)."""
    df = with_position(bars).withColumns({"ret": pct_return(), "log_return": log_return()})
    df = with_rsi(df)
    df = with_ema(df, {"ema20": ("close", 20), "_fast": ("close", 12), "_slow": ("close", 26)})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = with_ema(df, {"macd_signal": ("macd", 9)})
    return df.withColumns({"macd_hist": F.col("macd") - F.col("macd_signal"), "day_of_week": day_of_week()})


def engineer_features(bars: DataFrame) -> DataFrame:
    """Indicators without warm-up rows; ``seq`` restarts at the first complete row."""
    complete = indicator_columns(bars).dropna(subset=["ret", "log_return", "rsi14"])
    return with_position(complete.drop("seq"))


def _slope_base() -> Column:
    before = F.lag("ema20", 10).over(by_ticker())
    return F.when(before == 0, F.lit(1.0)).otherwise(before)


def regime_feature_columns(df: DataFrame) -> DataFrame:
    """The five regime features over the given rows, null where a window is not full."""
    sma20 = full_window(F.col("close"), F.avg, 20)
    sma20 = F.when(sma20 == 0, F.lit(1.0)).otherwise(sma20)
    slope = (F.col("ema20") - F.lag("ema20", 10).over(by_ticker())) / (_slope_base() + 1e-9) * 100.0
    return df.withColumns(
        {
            "vol20": full_window(F.col("log_return"), F.stddev_samp, 20),
            "rsi_dev": F.col("rsi14") - 50.0,
            "macd_hist_norm": F.col("macd_hist") / (sma20 * 0.01 + 1e-9),
            "ema_slope": slope,
            "ret10": pct_return(10) * 100.0,
        }
    )


def regime_features(df: DataFrame, fill: str = "bfill") -> DataFrame:
    """Complete regime features.

    ``bfill`` (the service variant, over trimmed rows) fills warm-up rows from the
    first full window; ``drop`` (the report variant, over all rows) drops them.
    """
    df = regime_feature_columns(df)
    if fill == "drop":
        return df.dropna(subset=["log_return", *REGIME_FEATURES])
    df = df.withColumns({c: finite_or_null(F.col(c)) for c in REGIME_FEATURES})
    return df.withColumns({c: fill_both_ways(F.col(c)) for c in REGIME_FEATURES}).dropna(subset=REGIME_FEATURES)


def rolling_volatility(value: str = "log_return", n: int = 30) -> Column:
    """Annualised rolling deviation in percent."""
    return full_window(F.col(value), F.stddev_samp, n) * math.sqrt(TRADING_DAYS) * 100


def rolling_sharpe(value: str, n: int = 60) -> Column:
    frame = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, sharpe(F.col(value), "pop", frame))


def equity_curve(returns: str, capital: float = INITIAL_CAPITAL) -> Column:
    return F.lit(capital) * F.product(1.0 + F.col(returns)).over(running())


def drawdown_pct(equity: str, guard: float = 1e-12) -> Column:
    peak = F.max(equity).over(running())
    return (F.col(equity) - peak) / (peak + guard) * 100
