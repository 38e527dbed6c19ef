"""Factor diagnostics of a strategy: information coefficient, folds, fan chart."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.constants import WALK_FORWARD_GRID
from tickloom.functions.series import by_ticker, midrank, sharpe, with_position
from tickloom.functions.stats import correlation
from tickloom.operators.backtest import regime_weight

IC_WINDOW = 60


def _midranks(windows: np.ndarray) -> np.ndarray:
    """Average ranks along the last axis."""
    below = (windows[:, None, :] < windows[:, :, None]).sum(axis=2)
    equal = (windows[:, None, :] == windows[:, :, None]).sum(axis=2)
    return below + (equal + 1) / 2.0


def _rank_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Spearman per row of two matrices, 0 where one side is constant."""
    a, b = _midranks(x), _midranks(y)
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    scale = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.where(scale > 0, (a * b).sum(axis=1) / np.where(scale > 0, scale, 1.0), 0.0)


def rolling_ic(df: DataFrame, window: int = IC_WINDOW) -> DataFrame:
    """Spearman of weight and next return over the ``window`` rows before each row.

    Rows from ``window`` to the last but one have a value.  Ranking every window
    as rows would multiply the data by its length; here each series is sliced
    into windows inside its task instead.
    """

    def one_series(series: pa.Table) -> pa.Table:
        series = series.sort_by("dt")
        count = max(0, series.num_rows - 1 - window)
        rows = series.slice(window, count).select(["ticker", "dt"])
        if not count:
            return rows.append_column("ic", pa.array([], pa.float64()))
        weights = np.lib.stride_tricks.sliding_window_view(series["weight"].to_numpy(), window)
        nexts = np.lib.stride_tricks.sliding_window_view(series["log_return"].to_numpy()[1:], window)
        step = 256
        parts = [
            _rank_correlation(weights[i : min(i + step, count)], nexts[i : min(i + step, count)])
            for i in range(0, count, step)
        ]
        return rows.append_column("ic", pa.array(np.concatenate(parts)))

    columns = df.select("ticker", "dt", "weight", "log_return")
    return columns.groupBy("ticker").applyInArrow(one_series, "ticker string, dt date, ic double")


def ic_summary(ics: DataFrame) -> DataFrame:
    """Mean, population deviation, ratio and one-sample t statistic of the coefficients."""
    out = ics.groupBy("ticker").agg(
        F.count("ic").alias("n"), F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("ic_std"),
        F.stddev_samp("ic").alias("_sd"),
    )
    # Coefficients without spread have no t statistic: 0, as for too few of them.
    t = F.when(F.col("n") > 2, F.try_divide(F.col("ic_mean"), F.col("_sd") / F.sqrt("n")))
    return out.withColumns({"ic_ir": F.col("ic_mean") / (F.col("ic_std") + 1e-12), "t_stat": F.coalesce(t, F.lit(0.0))}).drop("_sd")


def _two_sided_p(t: float, dof: int) -> float:
    """Student-t tail from the continued fraction of the incomplete beta function."""
    if not math.isfinite(t) or dof <= 0:
        return 1.0 if not math.isinf(t) else 0.0
    a, b, x = dof / 2.0, 0.5, dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    swap = x > (a + 1.0) / (a + b + 2.0)
    if swap:
        a, b, x = b, a, 1.0 - x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 300):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    p = front * value
    return 1.0 - p if swap else p


def with_p_value(summary: DataFrame) -> DataFrame:
    """Two-sided p of ``t_stat`` and its 5 % verdict, on one row per ticker."""

    @F.pandas_udf("double")
    def p_value(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([_two_sided_p(a, int(b) - 1) if b > 2 else 1.0 for a, b in zip(t, n)])

    return summary.withColumn("p_value", p_value("t_stat", "n")).withColumn("significant", F.col("p_value") < 0.05)


def cv_ic(df: DataFrame, folds: int = 5) -> DataFrame:
    """Rank correlation of weight and next return in consecutive test folds."""
    df = with_position(df.select("ticker", "dt", "weight", "log_return"), count="n")
    df = df.withColumn("fwd", F.coalesce(F.lead("log_return").over(by_ticker()), F.lit(0.0)))
    size = F.floor(F.col("n") / (folds + 1))
    start = F.col("n") - folds * size
    df = df.where((size > 0) & (F.col("seq") >= start)).withColumn("fold", F.floor(F.try_divide(F.col("seq") - start, size)))
    key = ["ticker", "fold"]
    df = df.withColumns({"_rw": midrank("weight", key), "_rf": midrank("fwd", key)})
    rho = F.when(F.count("fwd") > 10, correlation("_rw", "_rf")).otherwise(F.lit(0.0))
    per_fold = df.groupBy(*key).agg(F.coalesce(rho, F.lit(0.0)).alias("ic"))
    return per_fold.groupBy("ticker").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("fold", "ic"))), lambda s: F.round(s["ic"], 4)).alias("fold_ics"),
        F.avg("ic").alias("ic_mean"),
        F.stddev_pop("ic").alias("ic_std"),
    )


def walk_forward_folds(df: DataFrame, folds: int = 5, min_rows: int = 20) -> DataFrame:
    """Best (bull, neutral) weights per fold by Sharpe; the first pair wins ties."""
    df = with_position(df.select("ticker", "dt", "regime", "log_return"), count="n")
    size = F.floor(F.col("n") / (folds + 1))
    df = df.withColumn("fold", F.floor(F.try_divide(F.col("seq"), size)))
    df = df.where((size >= min_rows) & (F.col("fold") >= 1) & (F.col("fold") <= folds))
    inside = Window.partitionBy("ticker", "fold").orderBy("dt")
    pairs = range(len(WALK_FORWARD_GRID))
    df = df.withColumns(
        {
            f"_r{i}": F.coalesce(F.lag(regime_weight(F.col("regime"), *WALK_FORWARD_GRID[i])).over(inside), F.lit(0.0))
            * F.col("log_return")
            for i in pairs
        }
    )
    out = df.groupBy("ticker", "fold").agg(
        F.min("dt").alias("test_start"), F.max("dt").alias("test_end"),
        *[F.round(sharpe(F.col(f"_r{i}"), "pop"), 9).alias(f"_s{i}") for i in pairs],
    )
    best = F.greatest(F.lit(-999.0), *[F.col(f"_s{i}") for i in pairs])
    out = out.withColumn("_best", best)

    def chosen(part: int) -> Column:
        pick = F.when(F.col("_best") == -999.0, F.lit(WALK_FORWARD_GRID[0][part]))
        for i in pairs:
            pick = pick.when(F.col(f"_s{i}") == F.col("_best"), F.lit(WALK_FORWARD_GRID[i][part]))
        return pick

    return out.select(
        "ticker", "fold", "test_start", "test_end", F.round("_best", 4).alias("best_sharpe"),
        chosen(0).alias("bull_thresh"), chosen(1).alias("neutral_thresh"),
    )


def walk_forward_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("ticker").agg(
        F.avg("best_sharpe").alias("wf_sharpe_mean"), F.stddev_pop("best_sharpe").alias("wf_sharpe_std")
    )


