"""Alert rules against bars; the same join serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import by_ticker, running

# Rule conditions.
CONDITIONS = ["PRICE_ABOVE", "PRICE_BELOW", "RSI_ABOVE", "RSI_BELOW", "REGIME_CHANGE", "DRAWDOWN_EXCEEDS"]


def alert_inputs(frame: DataFrame) -> DataFrame:
    """Columns the conditions read: close, RSI, regime and its predecessor, drawdown from the peak close."""
    peak = F.max("close").over(running())
    return frame.select(
        "ticker", "dt", "close", "rsi14", "regime",
        F.lag("regime").over(by_ticker()).alias("prev_regime"),
        (F.try_divide(peak - F.col("close"), peak) * 100).alias("drawdown"),
    )


def stream_inputs(bars: DataFrame) -> DataFrame:
    """Streamed bars for rules on prices alone, without state: what needs earlier bars stays null and matches nothing.

    ``streaming.alert_state`` keeps the state that all six conditions need.
    """
    none = F.lit(None)
    return bars.select(
        "ticker", F.col("start").cast("date").alias("dt"), "close", none.cast("double").alias("rsi14"),
        none.cast("int").alias("regime"), none.cast("int").alias("prev_regime"), none.cast("double").alias("drawdown"),
    )


def alert_matches(bars: DataFrame, rules: DataFrame) -> DataFrame:
    """Bars that fulfil an active rule of their ticker.

    No size is assumed for the rules; on a stream they are the static side.
    """
    active = rules.where(F.col("status") == "ACTIVE").drop("status")
    joined = bars.join(active, "ticker")
    kind, level = F.col("condition_type"), F.col("threshold")
    value = (
        F.when(kind.startswith("PRICE"), F.col("close"))
        .when(kind.startswith("RSI"), F.col("rsi14"))
        .when(kind == "REGIME_CHANGE", F.col("regime").cast("double"))
        .otherwise(F.col("drawdown"))
    )
    joined = joined.withColumn("value", value)
    hit = (
        F.when(kind.isin("PRICE_ABOVE", "RSI_ABOVE", "DRAWDOWN_EXCEEDS"), F.col("value") > level)
        .when(kind.isin("PRICE_BELOW", "RSI_BELOW"), F.col("value") < level)
        .when(kind == "REGIME_CHANGE", F.col("regime") != F.col("prev_regime"))
    )
    return joined.where(hit).select("rule_id", "user_id", "ticker", "dt", "condition_type", "threshold", "value")
