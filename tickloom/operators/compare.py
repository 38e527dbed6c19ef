"""Comparison of several instruments on their shared dates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.constants import MIN_ROWS
from tickloom.functions.series import by_ticker, running, sharpe
from tickloom.session import materialise


def normalise_request(tickers: list[str]) -> list[str]:
    """Trimmed upper-case tickers without blanks, each once, in the order of the request."""
    wanted = list(dict.fromkeys(t.strip().upper() for t in tickers if t.strip()))
    if not wanted:
        raise ValueError("No valid tickers provided.")
    return wanted


def common_dates(df: DataFrame) -> DataFrame:
    """Dates on which every ticker has its (one) row."""
    tickers = df.agg(F.count_distinct("ticker").alias("_all"))
    per_day = df.groupBy("dt").agg(F.count(F.lit(1)).alias("_n"))
    # One aggregate row on the right.
    return per_day.join(F.broadcast(tickers), F.col("_n") == F.col("_all")).select("dt")


def common_dates_of_two(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("dt").intersect(right.select("dt"))


def align_panel(df: DataFrame) -> DataFrame:
    return df.join(common_dates(df), "dt", "left_semi")


def benchmark_align(df: DataFrame, benchmark: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add benchmark columns on shared dates.

    The benchmark is one series, at most one row per calendar day, so it always
    fits a broadcast.
    """
    side = benchmark.select("dt", *[F.col(a).alias(b) for a, b in columns.items()])
    return df.join(F.broadcast(side), "dt")


def fetch_errors(requested: DataFrame, available: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """Requested tickers without usable data, with the reason."""
    wanted = requested.select(F.upper(F.trim("ticker")).alias("ticker")).where(F.col("ticker") != "").distinct()
    rows = available.groupBy(F.upper("ticker").alias("ticker")).agg(F.count(F.lit(1)).alias("rows"))
    joined = wanted.join(rows, "ticker", "left")
    reason = F.when(F.col("rows").isNull(), F.concat(F.lit("No data returned for "), F.col("ticker"))).when(
        F.col("rows") < min_rows,
        F.concat(F.lit(f"Need {min_rows} rows, got "), F.col("rows").cast("string")),
    )
    return joined.withColumn("error", reason).where(F.col("error").isNotNull()).select("ticker", "error")


def normalised_prices(aligned: DataFrame, base: float = 100.0) -> DataFrame:
    first = F.first("close").over(running())
    return aligned.select("ticker", "dt", F.round(F.try_divide(F.col("close"), first) * base, 2).alias("value"))


def daily_returns_pct(aligned: DataFrame) -> DataFrame:
    ret = F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1
    return aligned.select("ticker", "dt", F.round(F.coalesce(ret, F.lit(0.0)) * 100.0, 4).alias("return_pct"))


def complete_dates(df: DataFrame, value: str) -> DataFrame:
    """Rows with a value on dates where every ticker has one."""
    rows = df.select("ticker", "dt", value).where(F.col(value).isNotNull())
    everyone = df.agg(F.count_distinct("ticker").alias("_all"))
    per_day = rows.groupBy("dt").agg(F.count_distinct("ticker").alias("_n"))
    days = per_day.join(F.broadcast(everyone), F.col("_n") == F.col("_all")).select("dt")  # one row on the right
    return rows.join(days, "dt", "left_semi")


#: Tickers whose series meet in one tile of a matrix.
TILE = 64


def pairwise(df: DataFrame, value: str, kind: str, name: str) -> DataFrame:
    """Symmetric matrix of all tickers in long form: ``correlation`` or sample ``covariance`` over complete dates.

    A ticker is one vector, bounded by the calendar.  Vectors are dealt into blocks of about TILE, every pair of
    blocks is a tile, and a tile is one product of two small matrices; no date emits its pairs and the plan does not
    grow with the number of tickers.  Correlation is null where a side is constant.
    """
    # Dates, tickers and values are read several times below; whatever makes them runs once.
    df = materialise(df.select("ticker", "dt", value), "values")
    cells = F.array_sort(F.collect_list(F.struct("dt", F.col(value).alias("v"))))
    vectors = complete_dates(df, value).groupBy("ticker").agg(F.transform(cells, lambda c: c["v"]).alias("x"))
    blocks = df.agg(F.ceil(F.count_distinct("ticker") / TILE).cast("int").alias("_blocks"))
    dealt = vectors.join(F.broadcast(blocks)).withColumn("_own", F.pmod(F.xxhash64("ticker"), F.col("_blocks")).cast("int"))
    tiles = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).select(
        "ticker", "x", "_own", F.least("_own", "_with").alias("_low"), F.greatest("_own", "_with").alias("_high")
    )

    def tile(rows: pa.Table) -> pa.Table:
        names, own = np.array(rows["ticker"].to_pylist(), dtype=object), rows["_own"].to_numpy()
        x = np.array(rows["x"].to_pylist(), dtype=float)
        x = x - x.mean(axis=1, keepdims=True)
        low, high = rows["_low"][0].as_py(), rows["_high"][0].as_py()
        a, b = np.flatnonzero(own == low), np.flatnonzero(own == high)
        m = x[a] @ x[b].T
        if kind == "correlation":
            scale = np.sqrt((x[a] ** 2).sum(axis=1))[:, None] * np.sqrt((x[b] ** 2).sum(axis=1))[None, :]
            m = np.where(scale > 0, m / np.where(scale > 0, scale, 1.0), np.nan)
        else:
            m = m / (x.shape[1] - 1) if x.shape[1] > 1 else np.full(m.shape, np.nan)
        left, right, values = np.repeat(names[a], len(b)), np.tile(names[b], len(a)), m.ravel()
        if low != high:
            left, right, values = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([values, values])
        return pa.table(
            {
                "ticker_a": pa.array(left, pa.string()), "ticker_b": pa.array(right, pa.string()),
                name: pa.array(values, pa.float64(), mask=np.isnan(values)),
            }
        )

    return tiles.groupBy("_low", "_high").applyInArrow(tile, f"ticker_a string, ticker_b string, {name} double")


def return_correlation(aligned: DataFrame) -> DataFrame:
    matrix = pairwise(aligned, "log_return", "correlation", "correlation")
    return matrix.withColumn("correlation", F.round("correlation", 4))


def ticker_summary(aligned: DataFrame) -> DataFrame:
    df = aligned.withColumn("_eq", F.product(1.0 + F.col("log_return")).over(running()))
    peak = F.max("_eq").over(running())
    df = df.withColumn("_dd", F.try_divide(F.col("_eq") - peak, peak))
    return df.groupBy("ticker").agg(
        F.round((F.try_divide(F.max_by("close", "dt"), F.min_by("close", "dt")) - 1.0) * 100.0, 2).alias("total_return_pct"),
        F.round(F.avg("log_return") * 252 * 100.0, 2).alias("annualised_return_pct"),
        F.round(F.stddev_samp("log_return") * F.sqrt(F.lit(252.0)) * 100.0, 2).alias("annualised_volatility_pct"),
        F.round(sharpe(F.col("log_return"), "sample9"), 4).alias("sharpe_ratio"),
        F.round(F.min("_dd") * 100.0, 2).alias("max_drawdown_pct"),
        F.round(F.max_by("rsi14", "dt"), 1).alias("latest_rsi"),
        F.round(F.max_by("close", "dt"), 2).alias("latest_close"),
        F.round(F.min_by("close", "dt"), 2).alias("start_close"),
    )


def compare_date_range(aligned: DataFrame) -> DataFrame:
    return aligned.agg(
        F.min("dt").alias("start"), F.max("dt").alias("end"), F.count_distinct("dt").alias("trading_days")
    )


def comparison(features: DataFrame, tickers: list[str]) -> dict[str, DataFrame]:
    """Every part of a comparison of the requested tickers, as lazy frames.

    Tickers without usable rows are reported under ``errors`` and left out; the
    comparison fails only when none is usable or they share too few dates.
    """
    spark = features.sparkSession
    wanted = normalise_request(tickers)
    own = features.where(F.upper("ticker").isin(wanted))
    sizes = {r["ticker"]: r["count"] for r in own.groupBy("ticker").count().collect()}
    usable = [t for t, n in sizes.items() if n >= MIN_ROWS]
    if not usable:
        raise ValueError("All tickers failed to fetch.")
    aligned = align_panel(own.where(F.col("ticker").isin(usable)))
    days = aligned.select("dt").distinct().count()
    if days < MIN_ROWS:
        raise ValueError(f"Need {MIN_ROWS} shared dates, got {days}.")
    requested = spark.createDataFrame([(t,) for t in wanted], "ticker string")
    return {
        "errors": fetch_errors(requested, own),
        "normalised_prices": normalised_prices(aligned),
        "returns": daily_returns_pct(aligned),
        "correlation": return_correlation(aligned),
        "summary": ticker_summary(aligned),
        "date_range": compare_date_range(aligned),
    }
