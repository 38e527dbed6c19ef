"""Ridge regressions per series and fold, from sums that add up.

A row adds to the sums of its own block only; what a fold may learn from is the sum of the blocks before it, scaler
included (minima and maxima add up as well).  So all folds of all series are fitted from one aggregate over the rows,
and a fit is a small system of equations, solved for many series at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.constants import FEATURE_COLS, SEQUENCE_LENGTH
from tickloom.operators.backtest import forecast_metrics
from tickloom.operators.forecast import price_from_log_return

PENALTY = 1.0


def block_sums(df: DataFrame, keys: list[str], columns: list[str], target: str) -> DataFrame:
    """Per group: rows, minima and maxima of the columns, sums and products of columns and target (upper triangle)."""
    values = [F.col(c).cast("double") for c in (*columns, target)]
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.array(*[F.min(v) for v in values[:-1]]).alias("low"),
        F.array(*[F.max(v) for v in values[:-1]]).alias("high"),
        F.array(*[F.sum(v) for v in values]).alias("sums"),
        F.array(*[F.sum(values[i] * values[j]) for i, j in pairs]).alias("products"),
    )


def solve(rows: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, products: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients on raw columns and the constant, for many systems at once.

    Columns are scaled to 0..1 by their range (1 where there is none) and centred, the constant is not penalised; the
    matrix is positive definite for any penalty above 0, so dependent columns are no trouble.
    """
    p = low.shape[1]
    full = np.zeros((len(rows), p + 1, p + 1))
    upper = np.triu_indices(p + 1)
    full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = products
    mean = sums / rows[:, None]
    centred = full - rows[:, None, None] * mean[:, :, None] * mean[:, None, :]
    spread = np.where(high > low, high - low, 1.0)
    gram = centred[:, :p, :p] / (spread[:, :, None] * spread[:, None, :])
    moment = centred[:, :p, p] / spread
    root = np.linalg.cholesky(gram + penalty * np.eye(p))
    half = np.linalg.solve(root, moment[:, :, None])
    beta = np.linalg.solve(root.transpose(0, 2, 1), half)[:, :, 0] / spread
    return beta, mean[:, p] - (beta * mean[:, :p]).sum(axis=1)


def _fit_folds(folds: int, p: int, penalty: float):
    widths = {"low": p, "high": p, "sums": p + 1, "products": (p + 1) * (p + 2) // 2}
    start = {"low": np.inf, "high": -np.inf, "sums": 0.0, "products": 0.0}
    join = {"low": np.minimum, "high": np.maximum, "sums": np.add, "products": np.add}
    kind = pa.list_(pa.struct([("train_rows", pa.int64()), ("constant", pa.float64()), ("beta", pa.list_(pa.float64()))]))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.zeros((batch.num_rows, folds))
            cells = {c: np.full((batch.num_rows, folds, w), start[c]) for c, w in widths.items()}
            for i, blocks in enumerate(batch.column("blocks").to_pylist()):
                for b in blocks:
                    rows[i, b["block"]] = b["rows"]
                    for c in cells:
                        cells[c][i, b["block"]] = b[c]
            # What a fold learns from is all blocks up to the one before it.
            seen = np.cumsum(rows, axis=1)
            upto = {c: join[c].accumulate(v, axis=1) for c, v in cells.items()}
            at = np.argwhere(seen > 0)
            pick = [upto[c][at[:, 0], at[:, 1]] for c in widths]
            beta, constant = solve(seen[at[:, 0], at[:, 1]], *pick, penalty)
            fits = [[None] * folds for _ in range(batch.num_rows)]
            for (i, f), b, c in zip(at.tolist(), beta, constant, strict=True):
                fits[i][f] = {"train_rows": int(seen[i, f]), "constant": float(c), "beta": b.tolist()}
            yield pa.RecordBatch.from_arrays([batch.column("ticker"), pa.array(fits, kind)], names=["ticker", "fits"])

    return look


def expanding_fits(df: DataFrame, columns: list[str], folds: int, penalty: float = PENALTY) -> DataFrame:
    """ticker and ``fits``, one fit per fold 1..folds over all blocks before it; needs ``block`` (0..folds) and ``target``.

    Rows with a null in a column teach nothing; a fold without earlier rows has a null fit.
    """
    complete = df.where(F.col("block") < folds).dropna(subset=[*columns, "target"])
    blocks = block_sums(complete, ["ticker", "block"], columns, "target")
    # At most ``folds`` rows per ticker.
    gathered = blocks.groupBy("ticker").agg(
        F.array_sort(F.collect_list(F.struct("block", "rows", "low", "high", "sums", "products"))).alias("blocks")
    )
    kinds = "ticker string, fits array<struct<train_rows: long, constant: double, beta: array<double>>>"
    return gathered.mapInArrow(_fit_folds(folds, len(columns), penalty), kinds)


def predicted(fit: Column, columns: list[str]) -> Column:
    total = fit["constant"]
    for i, c in enumerate(columns):
        total = total + F.get(fit["beta"], F.lit(i)) * F.col(c).cast("double")
    return total


def walk_forward_features(
    df: DataFrame, columns: list[str] = FEATURE_COLS, folds: int = 5, length: int = SEQUENCE_LENGTH, penalty: float = PENALTY
) -> DataFrame:
    """Expanding-window evaluation over all features, scaled and fitted per fold on the rows before it.

    Needs ``seq``, ``n``, ``close`` and ``target`` (``forecast.with_target``).  One row per ticker and fold; a series too
    short for its folds gives one row without a fold, whose ``status`` says how many rows it lacks.
    """
    size = F.floor(F.col("n") / (folds + 1))
    df = df.withColumn("_size", size)
    long_enough = F.col("_size") >= length + 10
    usable = df.where(long_enough).withColumn("block", F.floor(F.col("seq") / F.col("_size")).cast("long")).where(F.col("block") <= folds)
    fits = expanding_fits(usable, columns, folds, penalty)
    tests = usable.where(F.col("block") >= 1).join(fits, "ticker").withColumn("_fit", F.get("fits", F.col("block").cast("int") - 1))
    tests = tests.withColumns({"d_pred": predicted(F.col("_fit"), columns), "d_actual": F.col("target")})
    scored = tests.select(
        "ticker", F.col("block").alias("fold"), F.col("_fit.train_rows").alias("train_rows"), "d_pred", "d_actual",
        price_from_log_return(F.col("close"), F.col("target")).alias("actual"), price_from_log_return(F.col("close"), F.col("d_pred")).alias("pred"),
    )
    metrics = forecast_metrics(scored, ["ticker", "fold", "train_rows"]).select(
        "ticker", "fold", F.lit("ok").alias("status"), "train_rows", "rmse", "mae", "r2", "directional_accuracy"
    )
    short = df.where(~long_enough).groupBy("ticker").agg(F.max("n").alias("n"))
    missing = F.concat(F.lit("insufficient: "), F.col("n").cast("string"), F.lit(f" rows, need {(length + 10) * (folds + 1)}"))
    none = lambda kind: F.lit(None).cast(kind)
    status = short.select(
        "ticker", none("long").alias("fold"), missing.alias("status"), none("long").alias("train_rows"),
        *[none("double").alias(c) for c in ("rmse", "mae", "r2", "directional_accuracy")],
    )
    return metrics.unionByName(status)
