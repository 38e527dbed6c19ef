"""Model-run tables and request telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.constants import (
    BREAKER_THRESHOLD, BREAKER_WINDOW, CALL_WINDOW_SECONDS, CALLS_PER_WINDOW, LATENCY_BOUNDS,
)
from tickloom.functions.blocks import rolling_rows, running_sum, trailing_count, with_ordinal

# ---------------------------------------------------------------------------
# Model runs
# ---------------------------------------------------------------------------

def with_version(runs: DataFrame) -> DataFrame:
    """Version ``v1, v2, ...`` by training date and run, per ticker."""
    runs = with_ordinal(runs, "ticker", F.unix_date("trained_at").cast("bigint"), "run_id")
    return runs.withColumn("version", F.concat(F.lit("v"), (F.col("seq") + 1).cast("string")))


def next_version(runs: DataFrame) -> DataFrame:
    number = F.substring("version", 2, 2**31 - 1).try_cast("decimal(38,0)")
    return runs.groupBy("ticker").agg(F.concat(F.lit("v"), (F.coalesce(F.max(number), F.lit(0)) + 1).cast("decimal(38,0)").cast("string")).alias("next_version"))


def best_latest_model(runs: DataFrame) -> DataFrame:
    """Ready run of lowest error (the earlier on ties) and the last ready run."""
    ready = runs.where(F.col("status") == "ready")
    row = F.struct("version", "rmse")
    picked = ready.groupBy("ticker").agg(
        F.min_by(row, F.struct("rmse", "seq")).alias("b"), F.max_by(row, "seq").alias("l")
    )
    return picked.select(
        "ticker", F.col("b.version").alias("best"), F.col("b.rmse").alias("best_rmse"),
        F.col("l.version").alias("latest"), F.col("l.rmse").alias("latest_rmse"),
    )


def stale_models(runs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    cutoff = F.date_sub(F.lit(as_of).cast("date"), days)
    return runs.where((F.col("status") == "ready") & (F.col("trained_at") < cutoff))


def registry_stats(runs: DataFrame) -> DataFrame:
    """Counts of all runs, of the three usual states, and of any other state (null included)."""
    usual = ("ready", "training", "failed")
    other = ~F.coalesce(F.col("status").isin(*usual), F.lit(False))
    return runs.groupBy().agg(
        F.count_distinct("ticker").alias("total_tickers"), F.count(F.lit(1)).alias("total_versions"),
        *[F.count_if(F.col("status") == s).alias(s) for s in usual], F.count_if(other).alias("other"),
    )


# ---------------------------------------------------------------------------
# Counters and histograms
# ---------------------------------------------------------------------------

def label_counters(log: DataFrame, labels: list[str]) -> DataFrame:
    return log.groupBy(*labels).agg(F.count(F.lit(1)).alias("count"))


def _bounds():
    return [*LATENCY_BOUNDS, float("inf")]


def histogram_columns(value: str) -> list:
    """Cumulative ``le`` counts, sum and count: mergeable, usable in batch and stream."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_le{i}") for i, b in enumerate(_bounds())]
    return [*counts, F.sum(value).alias("sum"), F.count(value).alias("count")]


def histogram_buckets(hist: DataFrame, keys: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_le{i}").alias("cumulative")) for i, b in enumerate(_bounds())])
    mean = F.try_divide("sum", "count")
    return hist.select(*keys, F.round("sum", 6).alias("sum"), "count", F.round(mean, 6).alias("mean"), F.inline(cells))


def bucket_percentile(hist: DataFrame, keys: list[str], ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Smallest bound whose cumulative count reaches p of all, infinity included."""
    out = []
    for p in ps:
        pick = None
        for i, b in enumerate(_bounds()):
            reached = F.col(f"_le{i}") >= F.lit(p) * F.col("count")
            pick = F.when(reached, F.lit(b)) if pick is None else pick.when(reached, F.lit(b))
        out.append(pick.otherwise(F.lit(LATENCY_BOUNDS[-1])).alias(f"p{int(p * 100)}"))
    return hist.select(*keys, *out)


def nearest_rank(df: DataFrame, key: str, value: str, ps: tuple[float, ...]) -> DataFrame:
    """Nearest-rank percentiles (the ceil(p n)-th value) per key, exactly.

    Equal values merge into counts, the counts are summed along the values in
    ranges cut by row counts, and the least value that reaches a rank is it; a key
    of any size, with any values, never meets in one place.
    """
    counts = df.groupBy(key, F.col(value).alias("_v0")).agg(F.count(F.lit(1)).alias("_c"))
    summed = running_sum(counts, key, [F.col("_v0")], F.col("_c"), "_upto")
    totals = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("_c").alias("_n"))
    reached = summed.join(totals, summed[key].eqNullSafe(totals["_key"]))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_n")))
    columns = [F.min(F.when(F.col("_upto") >= rank(p), F.col("_v0"))).alias(f"p{int(p * 100)}") for p in ps]
    return reached.groupBy(key).agg(*columns)


def latency_percentiles(log: DataFrame) -> DataFrame:
    """Load summary per label: rates, throughput and nearest-rank latency in milliseconds."""
    ms = lambda c: F.round(F.col(c) * 1000, 2).alias(f"{c}_ms")
    elapsed = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6
    totals = log.groupBy("label").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.round(F.try_divide(F.count(F.lit(1)), elapsed), 6).alias("throughput_rps"),
        F.round(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)), 4).alias("error_rate"),
        F.round(F.avg(F.when(F.col("from_cache"), 1.0).otherwise(0.0)), 4).alias("cache_hit_rate"),
        F.min("latency_s").alias("min"), F.max("latency_s").alias("max"), F.avg("latency_s").alias("mean"),
    )
    ranks = nearest_rank(log, "label", "latency_s", (0.5, 0.95, 0.99))
    return totals.join(ranks, "label").select(
        "label", "total_requests", "throughput_rps", "error_rate", "cache_hit_rate",
        *[ms(c) for c in ("min", "p50", "p95", "p99", "max", "mean")],
    )


def sliding_failure_rate(
    log: DataFrame, window: int = BREAKER_WINDOW, threshold: float = BREAKER_THRESHOLD, block: int = 4096
) -> DataFrame:
    """Failure share of the last ``window`` outcomes per key; trips when full and at the threshold."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    numbered = with_ordinal(log, "key", micros, "event_id")
    failed = F.when(F.col("ok"), 0.0).otherwise(1.0)
    out = rolling_rows(
        numbered, "key", "seq", window - 1, block,
        lambda w: {"failure_rate": F.avg(failed).over(w), "outcomes": F.count("ok").over(w)},
    )
    return out.withColumn("tripped", (F.col("outcomes") == window) & (F.col("failure_rate") >= threshold))


def rolling_call_count(log: DataFrame, limit: int = CALLS_PER_WINDOW, seconds: float = CALL_WINDOW_SECONDS) -> DataFrame:
    """Calls of the key in the trailing window, this one included, against the limit."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    out = trailing_count(log, "key", micros, int(seconds * 1_000_000), "event_id", "calls")
    return out.withColumn("over_limit", F.col("calls") > limit)
