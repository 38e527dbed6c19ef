"""Event-time windows: each function takes a stream or a table and gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.telemetry import histogram_columns
from tickloom.sources.bars import packed_order


def ticks(events: DataFrame) -> DataFrame:
    """Ticks per user from the event table, with what orders them: time, then event, as one number."""
    ticks = events.select(
        F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id"), (F.lit(100.0) + F.col("value") / 10.0).alias("px"),
    )
    return ticks.withColumn("_us", F.unix_micros("ts")).withColumn("ord", packed_order(("_us", 18), ("event_id", 19))).drop("_us")


def tick_bars(stream: DataFrame, width: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """OHLC bars per ticker and tumbling window; ticks behind the watermark are dropped.

    The state of a window is one mergeable row, however many ticks it takes in.
    """
    # A decimal keeps the aggregate hash based; a struct would sort the raw ticks.
    order = F.col("ord")
    bars = (
        stream.withWatermark("ts", lateness)
        .groupBy("ticker", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("px", order).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", order).alias("close"), F.count(F.lit(1)).alias("volume"),
        )
    )
    return bars.select("ticker", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")


def trade_bars(trades: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Daily bars of a stream of trades (``sources.bars.as_trades``), once their day is behind the watermark.

    ``at`` is the event time of a bar, which operators with state after this one go by.
    """
    bars = (
        trades.withWatermark("ts", lateness)
        .groupBy("ticker", F.window("ts", "1 day").alias("w"))
        .agg(
            F.min_by("px", "ord").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.max_by("px", "ord").alias("close"), F.sum("qty").alias("volume"),
        )
    )
    day = F.col("w.start").cast("date").alias("dt")
    return bars.select("ticker", day, F.window_time("w").alias("at"), "open", "high", "low", "close", "volume")


def latency_histogram(log: DataFrame, width: str = "1 day", slide: str = "12 hours", lateness: str = "1 hour") -> DataFrame:
    """Cumulative latency buckets per label and sliding window."""
    hist = (
        log.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", lateness)
        .groupBy("label", F.window("ts", width, slide).alias("w"))
        .agg(*histogram_columns("latency_s"))
    )
    return hist.withColumn("start", F.col("w.start")).drop("w")
