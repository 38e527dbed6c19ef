"""Queries over bars: sources, cleaning, indicators, comparison, regimes."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.constants import BENCHMARK, REGIME_FEATURES
from tickloom.functions.series import by_ticker, full_window, with_position
from tickloom.operators import cleaning, compare, indicators, market, regimes
from tickloom.plans.panels import (
    compare_panel, engineered, rounded, service_features, service_regimes,
)
from tickloom.session import shared_path
from tickloom.sources import bars as src
from tickloom.sources import sinks
from tickloom.sources.tables import table

VALUES = cleaning.VALUE_COLS


def load_bars(spark, sf):
    return src.load_bars(spark, sf, "brand", start="1990-01-01", end="2030-01-01")


def clean_sort_dedup(spark, sf):
    return cleaning.keep_first_copy(src.duplicated_bars(spark, sf))


def clean_inf_to_null(spark, sf):
    return cleaning.null_non_finite(src.infinite_bars(spark, sf)).select("ticker", "dt", "close")


def clean_fill_gaps(spark, sf):
    return cleaning.fill_gaps(src.gappy_bars(spark, sf))


def clean_iqr_outliers(spark, sf):
    return cleaning.drop_outliers(src.load_bars(spark, sf, "brand", spiky=True))


def clean_winsorize(spark, sf):
    kept = cleaning.drop_outliers(src.load_bars(spark, sf, "brand", spiky=True))
    return rounded(cleaning.winsorize(kept), {c: 9 for c in VALUES})


def data_quality_report(spark, sf):
    return cleaning.data_quality_report(src.messy_bars(spark, sf))


def min_rows_gate(spark, sf):
    # 2 * sequence length + 10 with a sequence of 700 rows separates the brands.
    return cleaning.min_rows_gate(engineered(spark, sf), 2 * 700 + 10)


def write_result(spark, sf):
    """The scoreboard as one JSON document per ticker, written and read back."""
    board = regime_scoreboard(spark, sf)
    path = shared_path(spark, "result")
    sinks.write_result(sinks.as_json(sinks.sanitise(board, None), "ticker"), path, "json")
    record = T.StructType([f for f in board.schema.fields if f.name != "ticker"])
    back = spark.read.schema("ticker string, record string").json(path)
    return back.select("ticker", F.from_json("record", record).alias("r")).select("ticker", "r.*").select(board.columns)


def min_rows_split(spark, sf):
    """Rows per ticker that passes the gate and the shortfall of those that do not, side by side."""
    ok, short = cleaning.split_min_rows(engineered(spark, sf), 2 * 700 + 10)
    passed = ok.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows")).withColumn("missing", F.lit(0).cast("bigint"))
    return passed.unionByName(short.select("ticker", F.col("available").alias("rows"), (F.col("required") - F.col("available")).alias("missing")))


def pct_return(spark, sf):
    df = src.load_bars(spark, sf).withColumns({"ret1": indicators.pct_return(1), "ret10": indicators.pct_return(10)})
    return rounded(df.select("ticker", "dt", "ret1", "ret10"), {"ret1": 8, "ret10": 8})


def log_return(spark, sf):
    return src.load_bars(spark, sf).select("ticker", "dt", F.round(indicators.log_return(), 8).alias("log_return"))


def day_of_week(spark, sf):
    return src.load_bars(spark, sf).select("ticker", "dt", indicators.day_of_week().cast("bigint").alias("day_of_week"))


def next_return_target(spark, sf):
    df = engineered(spark, sf).withColumn("target", F.lead("log_return").over(by_ticker()))
    return df.where(F.col("target").isNotNull()).select("ticker", "dt", F.round("target", 8).alias("target"))


def price_direction_quotes(spark, sf):
    return market.price_direction_quotes(src.load_bars(spark, sf))


def sector_heatmap(spark, sf):
    return market.sector_heatmap(src.load_bars(spark, sf, "type"))


def condition_alert(spark, sf):
    return regimes.with_alert(_risk(spark, sf)).select("ticker", "dt", "regime", "alert", "alert_label")


def attribution_weights(spark, sf):
    return market.attribution_weights(market.latest_metrics(service_regimes(spark, sf)))


def narrative_columns(spark, sf):
    metrics = regimes.with_profile(market.latest_metrics(service_regimes(spark, sf)))
    return market.narrative_columns(metrics)


def regime_profile_join(spark, sf):
    df = regimes.with_profile(service_regimes(spark, sf).select("ticker", "dt", "regime"))
    return df.select("ticker", "dt", "regime", "regime_name", "regime_color", "regime_description")


def downsample_every_k(spark, sf):
    df = src.load_bars(spark, sf).select("ticker", "dt", "close")
    plain = regimes.downsample(df, 200).withColumn("variant", F.lit("points_200"))
    timeline = regimes.downsample(df, 500, keep_last=True).withColumn("variant", F.lit("timeline_500"))
    return plain.unionByName(timeline)


def latest_indicators(spark, sf):
    cols = ["rsi14", "ema20", "macd", "macd_hist", "close", "log_return"]
    latest = engineered(spark, sf).groupBy("ticker").agg(F.max_by(F.struct("dt", *cols), "dt").alias("r"))
    return rounded(latest.select("ticker", "r.*"), {c: 4 for c in cols} | {"close": 6})


def rsi14(spark, sf):
    return indicators.with_rsi(src.load_bars(spark, sf)).select("ticker", "dt", F.round("rsi14", 4).alias("rsi14"))


def ema20(spark, sf):
    from tickloom.functions.series import with_ema

    df = with_ema(with_position(src.load_bars(spark, sf)), {"ema20": ("close", 20)})
    return df.select("ticker", "dt", F.round("ema20", 4).alias("ema20"))


def macd(spark, sf):
    df = indicators.with_macd(with_position(src.load_bars(spark, sf)))
    cols = ["macd", "macd_signal", "macd_hist"]
    return rounded(df.select("ticker", "dt", *cols), {c: 4 for c in cols})


def engineer_features(spark, sf):
    cols = ["rsi14", "ema20", "macd", "macd_signal", "macd_hist"]
    df = indicators.engineer_features(src.load_bars(spark, sf)).withColumn("day_of_week", F.col("day_of_week").cast("bigint"))
    df = rounded(df, {**{c: 4 for c in cols}, "ret": 8, "log_return": 8})
    return df.select("ticker", "dt", *VALUES, "seq", "ret", "log_return", *cols, "day_of_week")


def rolling_vol(spark, sf):
    df = src.load_bars(spark, sf).withColumn("log_return", indicators.log_return())
    return df.select(
        "ticker", "dt",
        F.round(full_window(F.col("log_return"), F.stddev_samp, 20), 8).alias("vol20"),
        F.round(full_window(F.col("log_return"), F.stddev_samp, 90), 8).alias("vol90"),
        F.round(indicators.rolling_volatility(), 4).alias("vol30_annual_pct"),
    )


def regime_features(spark, sf):
    return rounded(service_features(spark, sf).select("ticker", "dt", *REGIME_FEATURES), {c: 4 for c in REGIME_FEATURES} | {"vol20": 8})


def regime_features_drop(spark, sf):
    df = indicators.regime_features(indicators.indicator_columns(src.load_bars(spark, sf)), "drop")
    return rounded(df.select("ticker", "dt", *REGIME_FEATURES), {c: 4 for c in REGIME_FEATURES} | {"vol20": 8})


def rolling_sharpe60(spark, sf):
    df = src.load_bars(spark, sf).withColumn("log_return", indicators.log_return())
    return df.select("ticker", "dt", F.round(indicators.rolling_sharpe("log_return"), 6).alias("sharpe60"))


def equity_curve(spark, sf):
    df = src.load_bars(spark, sf).withColumn("ret", F.coalesce(indicators.pct_return(), F.lit(0.0)))
    return df.select("ticker", "dt", F.round(indicators.equity_curve("ret"), 4).alias("equity"))


def drawdown_series(spark, sf):
    df = src.load_bars(spark, sf).withColumn("ret", F.coalesce(indicators.pct_return(), F.lit(0.0)))
    df = df.withColumn("equity", indicators.equity_curve("ret"))
    return df.select("ticker", "dt", F.round(indicators.drawdown_pct("equity"), 6).alias("drawdown_pct"))


def common_dates(spark, sf):
    return compare.common_dates(src.load_bars(spark, sf, "type"))


def common_dates_two(spark, sf):
    b = src.load_bars(spark, sf, "type")
    return compare.common_dates_of_two(b.where(F.col("ticker") == BENCHMARK), b.where(F.col("ticker") != BENCHMARK))


def align_panel(spark, sf):
    return compare.align_panel(src.load_bars(spark, sf, "type")).select("ticker", "dt", "close")


def benchmark_align(spark, sf):
    b = src.load_bars(spark, sf, "brand").select("ticker", "dt", "close")
    m = src.load_bars(spark, sf, "type").where(F.col("ticker") == BENCHMARK)
    return compare.benchmark_align(b, m, {"close": "bench_close"})


def label_align(spark, sf):
    b = src.load_bars(spark, sf, "brand").select("ticker", "dt", "close")
    index_days = src.load_bars(spark, sf, "type").where(F.col("ticker") == BENCHMARK).select("dt")
    labels = b.withColumn("label", (F.weekday("dt") % 6).cast("int")).join(F.broadcast(index_days), "dt", "left_semi")
    return regimes.align_labels(b, labels)


def fetch_errors(spark, sf):
    part = table(spark, sf, "part")
    wanted = part.select(F.concat(F.lit(" "), F.lower("p_brand")).alias("ticker")).union(part.select("p_type"))
    return compare.fetch_errors(wanted, src.load_bars(spark, sf, "brand"))


def normalised_prices(spark, sf):
    return compare.normalised_prices(compare_panel(spark, sf))


def daily_returns_pct(spark, sf):
    return compare.daily_returns_pct(compare_panel(spark, sf))


def return_correlation(spark, sf):
    return compare.return_correlation(compare_panel(spark, sf))


def ticker_summary(spark, sf):
    return compare.ticker_summary(compare_panel(spark, sf))


def compare_date_range(spark, sf):
    return compare.compare_date_range(compare_panel(spark, sf))


def standard_scale(spark, sf):
    df = regimes.standard_scale(service_features(spark, sf))
    return rounded(df.select("ticker", "dt", *regimes.Z_COLS), {z: 6 for z in regimes.Z_COLS})


def regime_kmeans(spark, sf):
    return service_regimes(spark, sf).select("ticker", "dt", "cluster")


def regime_kmeans_restarts(spark, sf):
    """The best of ten starts per series."""
    return service_regimes(spark, sf, "type", starts=10).select("ticker", "dt", "start", "cluster", "regime")


def regime_kmeans_pooled(spark, sf):
    scaled = regimes.standard_scale(service_features(spark, sf)).select("ticker", "dt", *regimes.Z_COLS)
    return regimes.pooled_kmeans(scaled, seeds=list(range(42, 62))).select("ticker", "dt", "cluster")


def regime_semantic_order(spark, sf):
    return service_regimes(spark, sf).select("ticker", "dt", "cluster", "regime")


def _risk(spark, sf, universe="brand"):
    return regimes.with_risk_score(regimes.drop_centers(service_regimes(spark, sf, universe)))


def risk_score(spark, sf):
    return _risk(spark, sf).select("ticker", "dt", "regime", F.round("risk_score", 6).alias("risk_score"))


def regime_forward_stats(spark, sf):
    return rounded(regimes.forward_stats(service_regimes(spark, sf)), {"median": 4, "mean": 4, "pct_positive": 4})


def similar_scenarios(spark, sf):
    return regimes.similar_scenarios(service_regimes(spark, sf))


def regime_timeline(spark, sf):
    return rounded(regimes.regime_timeline(_risk(spark, sf)), {"risk_score": 6, "close": 6})


def transition_matrix(spark, sf):
    return regimes.transition_matrix(service_regimes(spark, sf))


def regime_confidence(spark, sf):
    return regimes.confidence_by_regime(service_regimes(spark, sf))


def feature_importance(spark, sf):
    return regimes.feature_importance(service_regimes(spark, sf))


def regime_scoreboard(spark, sf, universe="brand"):
    board = regimes.regime_scoreboard(_risk(spark, sf, universe))
    return rounded(board, {c: 4 for c in ["risk_score", "rsi14", "ema20", "macd", "macd_hist", "log_return"]} | {"close": 6})


QUERIES = {
    f.__name__: f
    for f in (
        load_bars, clean_sort_dedup, clean_inf_to_null, clean_fill_gaps, clean_iqr_outliers, clean_winsorize,
        data_quality_report, min_rows_gate, min_rows_split, write_result, pct_return, log_return, day_of_week, next_return_target,
        price_direction_quotes, sector_heatmap, condition_alert, attribution_weights, narrative_columns,
        regime_profile_join, downsample_every_k, latest_indicators, rsi14, ema20, macd, engineer_features, rolling_vol,
        regime_features, regime_features_drop, rolling_sharpe60, equity_curve, drawdown_series, common_dates,
        common_dates_two, align_panel, benchmark_align, label_align, fetch_errors, normalised_prices,
        daily_returns_pct, return_correlation, ticker_summary, compare_date_range, standard_scale, regime_kmeans, regime_kmeans_restarts,
        regime_kmeans_pooled, regime_semantic_order, risk_score, regime_forward_stats, similar_scenarios,
        regime_timeline, transition_matrix, regime_confidence, feature_importance, regime_scoreboard,
    )
}
