"""Shared upstream pipelines: from the given tables to feature and regime panels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.constants import BENCHMARK, REGIME_FEATURES
from tickloom.operators.cleaning import preprocess
from tickloom.operators.compare import align_panel, benchmark_align
from tickloom.operators.indicators import engineer_features, indicator_columns, regime_features
from tickloom.operators.regimes import classify_regimes
from tickloom.session import materialise
from tickloom.sources.bars import load_bars


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


def engineered(spark: SparkSession, sf: str, universe: str = "brand") -> DataFrame:
    return engineer_features(preprocess(load_bars(spark, sf, universe)))


def service_features(spark: SparkSession, sf: str, universe: str = "brand") -> DataFrame:
    """Regime features of the scoring service: cleaned bars, back-filled warm-up."""
    return regime_features(engineered(spark, sf, universe), "bfill")


def service_regimes(spark: SparkSession, sf: str, universe: str = "brand", starts: int = 1) -> DataFrame:
    cols = ["ticker", "dt", "close", "log_return", "rsi14", "ema20", "macd", "macd_hist", *REGIME_FEATURES]
    return classify_regimes(service_features(spark, sf, universe).select(*cols), starts)


def compare_panel(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned features of the six product types on the dates all of them share."""
    return align_panel(materialise(engineered(spark, sf, "type"), "panel"))


def benchmark_features(spark: SparkSession, sf: str) -> DataFrame:
    index = load_bars(spark, sf, "type").where(F.col("ticker") == BENCHMARK)
    return regime_features(indicator_columns(index), "drop")


def report_features(spark: SparkSession, sf: str, universe: str = "brand") -> DataFrame:
    """Features of the quant report: raw closes, shared dates, benchmark return beside them."""
    own = regime_features(indicator_columns(load_bars(spark, sf, universe)), "drop")
    return benchmark_align(own, benchmark_features(spark, sf), {"log_return": "bench_ret"})


def report_regimes(spark: SparkSession, sf: str, universe: str = "brand") -> DataFrame:
    cols = ["ticker", "dt", "close", "log_return", "bench_ret", *REGIME_FEATURES]
    return classify_regimes(report_features(spark, sf, universe).select(*cols))
