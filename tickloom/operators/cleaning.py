"""Cleaning of bar series: duplicates, gaps, outlier returns, tails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.series import by_ticker, fill_both_ways, finite_or_null, whole_ticker
from tickloom.sources.bars import BAR_COLS

VALUE_COLS = BAR_COLS[2:]


def keep_first_copy(df: DataFrame) -> DataFrame:
    """One row per (ticker, dt), the earliest ingested; ``ingest_seq`` tells copies apart.

    A mergeable aggregate: a group of copies shrinks to one row per task before
    the shuffle, whatever its size.
    """
    return df.groupBy("ticker", "dt").agg(*[F.min_by(c, "ingest_seq").alias(c) for c in VALUE_COLS])


def null_non_finite(df: DataFrame) -> DataFrame:
    return df.withColumns({c: finite_or_null(F.col(c)) for c in VALUE_COLS})


def fill_gaps(df: DataFrame) -> DataFrame:
    """Forward fill, then backward fill, then drop series that hold no value at all."""
    return df.withColumns({c: fill_both_ways(F.col(c)) for c in VALUE_COLS}).dropna(subset=VALUE_COLS)


def _percentile(value: Column, p: float) -> Column:
    return F.percentile(value, F.lit(p)).over(whole_ticker())


def flag_outliers(df: DataFrame) -> DataFrame:
    """Add ``outlier``: the one-day return lies outside three interquartile ranges."""
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1
    df = df.withColumn("_ret", ret)
    df = df.withColumns({"_q1": _percentile(F.col("_ret"), 0.25), "_q3": _percentile(F.col("_ret"), 0.75)})
    reach = 3.0 * (F.col("_q3") - F.col("_q1"))
    inside = F.col("_ret").between(F.col("_q1") - reach, F.col("_q3") + reach)
    return df.withColumn("outlier", ~(inside | F.col("_ret").isNull())).drop("_ret", "_q1", "_q3")


def drop_outliers(df: DataFrame) -> DataFrame:
    return flag_outliers(df).where(~F.col("outlier")).drop("outlier")


def winsorize(df: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Clip every value column to its per-ticker percentiles."""
    return df.withColumns(
        {c: F.least(F.greatest(F.col(c), _percentile(F.col(c), low)), _percentile(F.col(c), high)) for c in VALUE_COLS}
    )


def preprocess(df: DataFrame) -> DataFrame:
    """All cleaning steps over bars that are already unique per (ticker, dt)."""
    return winsorize(drop_outliers(fill_gaps(null_non_finite(df))))


def data_quality_report(raw: DataFrame) -> DataFrame:
    """Rows before and after cleaning, gaps filled and outliers removed, per ticker.

    ``raw`` may hold copies (``ingest_seq``); cleaning never fills a series partly,
    so one flagged pass gives every count.
    """
    counts = raw.groupBy("ticker").agg(F.count(F.lit(1)).alias("raw_rows"))
    unique = null_non_finite(keep_first_copy(raw))
    gap = F.greatest(*[F.col(c).isNull().cast("int") for c in VALUE_COLS])
    flagged = flag_outliers(fill_gaps(unique.withColumn("_gap", gap)))
    cleaned = flagged.groupBy("ticker").agg(
        F.sum(F.when(~F.col("outlier"), 1).otherwise(0)).alias("clean_rows"),
        F.sum(F.col("outlier").cast("int")).alias("outliers_removed"),
        F.sum("_gap").cast("bigint").alias("gaps_filled"),
    )
    dropped = (F.col("raw_rows") - F.col("clean_rows")) / F.greatest(F.col("raw_rows"), F.lit(1)) * 100
    return counts.join(cleaned, "ticker").select(
        "ticker", "raw_rows", "clean_rows", "outliers_removed", "gaps_filled",
        F.round(dropped, 1).alias("rows_dropped_pct"),
    )


def split_min_rows(df: DataFrame, required: int) -> tuple[DataFrame, DataFrame]:
    """Rows of tickers with ``required`` rows or more, and one row (ticker, available, required) for each other."""
    gate = min_rows_gate(df, required)
    ok = df.join(gate.where("status = 'ok'").select("ticker"), "ticker", "left_semi")
    return ok, gate.where("status <> 'ok'").drop("status")


def min_rows_gate(df: DataFrame, required: int) -> DataFrame:
    """Rows per ticker against a minimum: ``ok`` or ``insufficient``."""
    status = F.when(F.col("available") >= required, "ok").otherwise("insufficient")
    return (
        df.groupBy("ticker")
        .agg(F.count(F.lit(1)).alias("available"))
        .select("ticker", "available", F.lit(required).cast("bigint").alias("required"), status.alias("status"))
    )
