"""Quotes, heat maps and text summaries of the latest bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.constants import (
    BRIEF_HEADLINE, BRIEF_MOMENTUM, BRIEF_SUMMARY, BRIEF_TAIL, BRIEF_TAKEAWAYS, DRIVERS, SECTOR_REGIME_TAGS,
)
from tickloom.functions.series import by_ticker


def last_two_closes(bars: DataFrame) -> DataFrame:
    prev = bars.withColumn("prev", F.lag("close").over(by_ticker()))
    return prev.groupBy("ticker").agg(F.max_by(F.struct("dt", "close", "prev"), "dt").alias("r")).select("ticker", "r.*")


def _change_pct() -> Column:
    change = F.round((F.col("close") - F.col("prev")) / F.nullif(F.col("prev"), F.lit(0.0)) * 100, 2)
    return F.coalesce(change, F.lit(0.0))


def price_direction_quotes(bars: DataFrame) -> DataFrame:
    df = last_two_closes(bars).withColumn("change_pct", F.when(F.col("close").isNotNull(), _change_pct()))
    direction = F.when(F.col("close").isNull(), "flat").when(F.col("change_pct") >= 0, "up").otherwise("down")
    return df.select("ticker", F.round("close", 2).alias("price"), "change_pct", direction.alias("direction"))


def sector_heatmap(bars: DataFrame) -> DataFrame:
    df = last_two_closes(bars).withColumn("change_pct", _change_pct())
    mood = F.when(F.col("change_pct") > 0.3, "Bullish").when(F.col("change_pct") < -0.3, "Bearish").otherwise("Neutral")
    tags = F.create_map(*[F.lit(x) for pair in SECTOR_REGIME_TAGS.items() for x in pair])
    return df.withColumn("sentiment", mood).select(
        F.col("ticker").alias("sector"), "change_pct", "sentiment", F.element_at(tags, F.col("sentiment")).alias("regime")
    )


def latest_metrics(features: DataFrame) -> DataFrame:
    """Price, one-month return, annualised 20-day volatility, RSI, direction and confidence per ticker."""
    month = (F.try_divide(F.col("close"), F.lag("close", 21).over(by_ticker())) - 1) * 100
    df = features.withColumn("return_1m", month).groupBy("ticker").agg(
        F.max_by(F.struct("close", "return_1m", "vol20", "rsi14", "regime"), "dt").alias("r")
    ).select("ticker", "r.*")
    direction = F.when(F.col("return_1m") > 0.5, "UP").when(F.col("return_1m") < -0.5, "DOWN").otherwise("FLAT")
    return df.select(
        "ticker", F.col("close").alias("last_price"), "return_1m",
        (F.col("vol20") * F.sqrt(F.lit(252.0)) * 100).alias("volatility_20d"), F.col("rsi14").alias("rsi"),
        "regime", direction.alias("signal_dir"),
        F.least(F.lit(0.95), 0.5 + F.abs("return_1m") / 100).alias("confidence"),
    )


def attribution_weights(metrics: DataFrame) -> DataFrame:
    """Five driver weights per ticker with the sign of their influence."""
    rsi, vol, ret, conf = (F.col(c) for c in ("rsi", "volatility_20d", "return_1m", "confidence"))

    def driver(name: str, weight: Column, positive: Column) -> Column:
        return F.struct(
            F.lit(name).alias("feature"), F.round(weight, 4).alias("weight"),
            F.when(positive, "Positive").otherwise("Negative").alias("impact"),
        )

    drivers = F.array(
        driver(DRIVERS[0], (rsi - 50.0) / 100.0, rsi > 50),
        driver(DRIVERS[1], -0.02 * (vol - 15.0), vol <= 20),
        driver(DRIVERS[2], ret / 50.0, ret > 0),
        driver(DRIVERS[3], conf * 0.25, F.lit(True)),
        driver(DRIVERS[4], (rsi - 50.0) * ret / 10000.0, (rsi > 50) & (ret > 0)),
    )
    return metrics.select("ticker", F.inline(drivers))


def narrative_columns(metrics: DataFrame) -> DataFrame:
    """Headline, summary and takeaways; ``regime_name`` comes with the metrics."""
    bias = F.when(F.col("signal_dir") == "UP", "Bullish").when(F.col("signal_dir") == "DOWN", "Bearish").otherwise("Neutral")
    df = metrics.withColumn("sentiment_bias", bias)
    win_rate = F.greatest(F.lit(45), F.least(F.lit(85), F.floor(F.col("confidence") * 100 + 5).cast("int")))
    momentum = F.when(F.col("rsi") > 70, BRIEF_MOMENTUM[0]).when(F.col("rsi") < 30, BRIEF_MOMENTUM[1]).otherwise(BRIEF_MOMENTUM[2])
    tail = F.when(F.col("volatility_20d") > 25, BRIEF_TAIL[0]).otherwise(BRIEF_TAIL[1])
    arguments = [
        ("regime_name", win_rate), ("rsi", momentum), ("volatility_20d", tail), ("signal_dir", F.col("last_price") * 0.95),
    ]
    return df.select(
        "ticker", "sentiment_bias", F.round("confidence", 4).alias("confidence_score"),
        F.format_string(BRIEF_HEADLINE, "ticker", "sentiment_bias", "regime_name", F.col("confidence") * 100).alias("headline"),
        F.format_string(
            BRIEF_SUMMARY, "ticker", "last_price", "return_1m", "volatility_20d", "regime_name", "rsi", "signal_dir"
        ).alias("executive_summary"),
        F.array(*[F.format_string(text, *args) for text, args in zip(BRIEF_TAKEAWAYS, arguments)]).alias("key_takeaways"),
    )
