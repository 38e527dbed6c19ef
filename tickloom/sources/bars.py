"""Daily OHLCV bars, built from trades.

Trades per ticker and day are unbounded (one hot instrument may hold a third of
all rows), so bars come from mergeable aggregates: every task reduces its trades
to one row per (ticker, day) before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.series import with_position
from tickloom.sources.tables import table

PRICE_COLS = ["open", "high", "low", "close"]
BAR_COLS = ["ticker", "dt", *PRICE_COLS, "volume"]

# Universe name -> column that names the instrument.
UNIVERSES = {"type": "p_type", "brand": "p_brand", "supplier": "l_suppkey"}


def trades(
    spark: SparkSession,
    sf_dir: str,
    universe: str = "brand",
    start: str | None = None,
    end: str | None = None,
    spiky: bool = False,
) -> DataFrame:
    """Trades of a universe in [start, end), with the columns that order them."""
    return as_trades(table(spark, sf_dir, "lineitem"), spark, sf_dir, universe, start, end, spiky)


def as_trades(
    lines: DataFrame,
    spark: SparkSession,
    sf_dir: str,
    universe: str = "brand",
    start: str | None = None,
    end: str | None = None,
    spiky: bool = False,
) -> DataFrame:
    """Trades from order lines, a table or a stream."""
    if start:
        lines = lines.where(F.col("l_shipdate") >= F.lit(start).cast("timestamp_ntz"))
    if end:
        lines = lines.where(F.col("l_shipdate") < F.lit(end).cast("timestamp_ntz"))
    key = UNIVERSES[universe]
    if key.startswith("p_"):
        parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), key)
        lines = lines.join(parts, "l_partkey")
    price = (
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity"))
        if spiky
        else F.lit(100.0) + F.col("l_extendedprice") / 10000.0
    )
    # First and last trade of a day by order, line, part, supplier and quantity; what remains tied has one price.
    # One decimal instead of a struct keeps the aggregate hash based, so raw trades are never sorted.
    order = packed_order(("l_orderkey", 12), ("l_linenumber", 2), ("l_partkey", 11), ("l_suppkey", 10), ("l_quantity", 3))
    return lines.select(
        F.col(key).cast("string").alias("ticker"),
        F.col("l_shipdate").cast("date").alias("dt"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        price.alias("px"),
        F.col("l_quantity").alias("qty"),
        order.alias("ord"),
    )


def packed_order(*parts: tuple[str, int]) -> Column:
    """Non-negative whole numbers as one decimal of 38 digits that sorts like their tuple; ``parts``: (column, digits).

    A number with more digits than given is an error, not a wrong order.
    """
    if sum(n for _, n in parts) > 38:
        raise ValueError("more than 38 digits")
    text = F.concat(*[F.lpad(F.col(c).cast(f"decimal({n},0)").cast("string"), n, "0") for c, n in parts])
    return text.cast("decimal(38,0)")


def daily_bars(ticks: DataFrame) -> DataFrame:
    """One bar per (ticker, dt): first, highest, lowest, last price and total quantity."""
    return ticks.groupBy("ticker", "dt").agg(
        F.min_by("px", "ord").alias("open"),
        F.max("px").alias("high"),
        F.min("px").alias("low"),
        F.max_by("px", "ord").alias("close"),
        F.sum("qty").alias("volume"),
    )


def normalise_bars(df: DataFrame) -> DataFrame:
    """Lower-case names, fall back to the adjusted close, default what is missing, drop nulls."""
    df = df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])
    if "close" not in df.columns and "adj_close" in df.columns:
        df = df.withColumnRenamed("adj_close", "close")
    for name in PRICE_COLS:
        if name not in df.columns:
            df = df.withColumn(name, F.col("close"))
    if "volume" not in df.columns:
        df = df.withColumn("volume", F.lit(0.0))
    return df.select(*BAR_COLS).dropna(subset=[*PRICE_COLS, "volume"])


def load_bars(
    spark: SparkSession,
    sf_dir: str,
    universe: str = "brand",
    start: str | None = None,
    end: str | None = None,
    spiky: bool = False,
) -> DataFrame:
    return normalise_bars(daily_bars(trades(spark, sf_dir, universe, start, end, spiky)))


def _every(df: DataFrame, n: int, offset: int = 0) -> Column:
    return F.col("seq") % n == offset


def gappy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is missing on every 17th row of a series, the first included."""
    df = with_position(load_bars(spark, sf_dir, "brand"))
    return df.withColumn("close", F.when(~_every(df, 17), F.col("close"))).drop("seq")


def infinite_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars whose close is infinite on every 23rd row of a series."""
    df = with_position(load_bars(spark, sf_dir, "brand"))
    broken = F.when(_every(df, 23, 5), F.lit(float("inf"))).otherwise(F.col("close"))
    return df.withColumn("close", broken).drop("seq")


def duplicated_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a later, different copy of every 50th row of a series."""
    df = with_position(load_bars(spark, sf_dir, "brand"))
    late = df.where(_every(df, 50)).withColumn("close", F.col("close") + 1.0)
    return (
        df.withColumn("ingest_seq", F.lit(1))
        .unionByName(late.withColumn("ingest_seq", F.lit(2)))
        .drop("seq")
    )


def messy_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heavy-tailed bars with gaps and late copies, for the quality report."""
    df = with_position(load_bars(spark, sf_dir, "brand", spiky=True))
    late = df.where(_every(df, 50)).withColumn("close", F.col("close") + 1.0)
    gappy = df.withColumn("close", F.when(~_every(df, 17), F.col("close")))
    return (
        gappy.withColumn("ingest_seq", F.lit(1))
        .unionByName(late.withColumn("ingest_seq", F.lit(2)))
        .drop("seq")
    )
