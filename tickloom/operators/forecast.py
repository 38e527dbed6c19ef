"""Forecast data preparation, simple return models and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.constants import SEQUENCE_LENGTH, TRAIN_SPLIT, VAL_SPLIT
from tickloom.functions.series import by_ticker, full_window, whole_ticker, with_position
from tickloom.functions.stats import intercept, slope
from tickloom.operators.backtest import forecast_metrics


def with_target(features: DataFrame) -> DataFrame:
    """Next log return as ``target``; the last row has none and goes.  Renumbers ``seq``, adds ``n``."""
    df = features.withColumn("target", F.lead("log_return").over(by_ticker())).where(F.col("target").isNotNull())
    return with_position(df.drop("seq"), count="n")


def with_split(df: DataFrame, train: float = TRAIN_SPLIT, val: float = VAL_SPLIT) -> DataFrame:
    """Chronological train / val / test label by position."""
    n_train, n_val = F.floor(F.col("n") * train), F.floor(F.col("n") * val)
    split = F.when(F.col("seq") < n_train, "train").when(F.col("seq") < n_train + n_val, "val").otherwise("test")
    return df.withColumn("split", split)


def minmax_train_only(df: DataFrame, columns: list[str]) -> DataFrame:
    """Scale columns by the range of the train rows; keeps the bounds as ``<c>_min`` / ``<c>_range``."""
    bounds, scaled = {}, {}
    for c in columns:
        seen = F.when(F.col("split") == "train", F.col(c))
        low, high = F.min(seen).over(whole_ticker()), F.max(seen).over(whole_ticker())
        bounds[f"{c}_min"] = low
        bounds[f"{c}_range"] = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        scaled[f"{c}_scaled"] = (F.col(c) - F.col(f"{c}_min")) / F.col(f"{c}_range")
    return df.withColumns(bounds).withColumns(scaled)


def inverse_minmax(value: Column, column: str) -> Column:
    return value * F.col(f"{column}_range") + F.col(f"{column}_min")


def scale_single(value: Column, column: str, kind: str = "minmax") -> Column:
    """One raw value on a fitted scale; ``standard`` needs ``<c>_mean`` and ``<c>_scale``."""
    if kind == "standard":
        return (value - F.col(f"{column}_mean")) / (F.col(f"{column}_scale") + 1e-12)
    return (value - F.col(f"{column}_min")) * (1.0 / F.col(f"{column}_range"))


def make_sequences(df: DataFrame, columns: list[str], length: int = SEQUENCE_LENGTH) -> DataFrame:
    """``x``: the ``length`` rows before each row; ``target`` is that row's own.

    Validation and test windows reach back into the block before them.  A test
    window may use validation rows only, so it starts ``length`` rows into them.
    """
    frame = by_ticker().rowsBetween(-length, -1)
    df = df.withColumn("x", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(frame))
    n_train = F.floor(F.col("n") * TRAIN_SPLIT)
    first = F.when(F.col("split") == "test", n_train + length).otherwise(F.lit(length))
    return df.where((F.col("seq") >= first) & (F.size("x") == length))


def price_from_log_return(base: Column, log_return: Column) -> Column:
    return base * F.exp(log_return)


MODELS = ["naive", "sma5", "sma20"]


def baseline_predictions(bars: DataFrame) -> DataFrame:
    """Per bar: previous close and the mean of the previous 5 and 20 closes; complete rows only."""
    prev = F.lag("close").over(by_ticker())
    df = bars.select("ticker", "dt", F.col("close").alias("actual"), prev.alias("naive"))
    df = df.withColumns({"sma5": full_window(F.col("naive"), F.avg, 5), "sma20": full_window(F.col("naive"), F.avg, 20)})
    return df.dropna()


def long_predictions(wide: DataFrame, models: list[str] = MODELS) -> DataFrame:
    """One row per (bar, model), the mean of all models included as ``ensemble``."""
    wide = wide.withColumn("ensemble", sum((F.col(m) for m in models), F.lit(0.0)) / len(models))
    names = [*models, "ensemble"]
    before = {f"_{c}": F.lag(c).over(by_ticker()) for c in ["actual", *names]}
    wide = wide.withColumns(before)
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred"), (F.col(m) - F.col(f"_{m}")).alias("d_pred")) for m in names])
    return wide.select("ticker", "dt", "actual", (F.col("actual") - F.col("_actual")).alias("d_actual"), F.inline(cells))


def ensemble_band(preds: DataFrame) -> DataFrame:
    """Mean over models and the 1.96 population-deviation band around it."""
    out = preds.groupBy("ticker", "dt").agg(F.avg("pred").alias("ensemble"), F.stddev_pop("pred").alias("_sd"))
    return out.select(
        "ticker", "dt", "ensemble",
        (F.col("ensemble") - 1.96 * F.col("_sd")).alias("lower"), (F.col("ensemble") + 1.96 * F.col("_sd")).alias("upper"),
    )


def fit_ar1(df: DataFrame) -> DataFrame:
    """Next return on this return by least squares, on train rows, per ticker."""
    y = F.when(F.col("split") == "train", F.col("target"))
    return df.groupBy("ticker").agg(
        slope(y, F.col("log_return")).alias("slope"), intercept(y, F.col("log_return")).alias("intercept"),
        F.count(y).alias("train_rows"),
    )


def roll_forecast(features: DataFrame, steps: int = 5) -> DataFrame:
    """Recursive price forecast from the latest bar, one calendar day per step."""
    df = with_split(with_target(features))
    y = F.when(F.col("split") == "train", F.col("target"))
    fit = df.groupBy("ticker").agg(slope(y, F.col("log_return")).alias("b"), intercept(y, F.col("log_return")).alias("a"))
    last = features.groupBy("ticker").agg(F.max_by(F.struct("dt", "close", "log_return"), "dt").alias("r")).select("ticker", "r.*")
    out = fit.join(last, "ticker")
    start = F.struct(F.col("log_return").alias("r"), F.col("close").alias("p"), F.array().cast("array<double>").alias("path"))

    def advance(acc: Column, _: Column) -> Column:
        r = F.col("a") + F.col("b") * acc["r"]
        p = acc["p"] * F.exp(r)
        return F.struct(r.alias("r"), p.alias("p"), F.concat(acc["path"], F.array(p)).alias("path"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, advance)["path"]
    out = out.select("ticker", F.col("dt").alias("_last"), F.posexplode(path).alias("_i", "price"))
    return out.select("ticker", (F.col("_i") + 1).alias("step"), F.date_add("_last", F.col("_i") + 1).alias("dt"), "price")


def walk_forward_eval(df: DataFrame, folds: int = 5, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Expanding-window evaluation: the model of a fold sees only the rows before it.

    Each fold's fit is a conditional aggregate over the series, and a row is
    tested in exactly one fold, so rows are never copied per fold.
    """
    size = F.floor(F.col("n") / (folds + 1))
    df = df.withColumn("_size", size).withColumn("fold", F.floor(F.try_divide(F.col("seq"), F.col("_size"))))
    fits = {}
    for f in range(1, folds + 1):
        y = F.when(F.col("seq") < F.col("_size") * f, F.col("target"))
        fits[f"_b{f}"] = slope(y, F.col("log_return"), whole_ticker())
        fits[f"_a{f}"] = intercept(y, F.col("log_return"), whole_ticker())
    df = df.withColumns(fits).where((F.col("fold") >= 1) & (F.col("fold") <= folds) & (F.col("_size") >= length + 10))
    pick = lambda c: F.element_at(F.array(*[F.col(f"_{c}{f}") for f in range(1, folds + 1)]), F.col("fold").cast("int"))
    df = df.withColumn("lr_pred", pick("a") + pick("b") * F.col("log_return"))
    df = df.withColumns(
        {"actual": price_from_log_return(F.col("close"), F.col("target")), "pred": price_from_log_return(F.col("close"), F.col("lr_pred"))}
    )
    # The fold's direction is that of the return itself.
    scored = df.withColumns({"d_actual": F.col("target"), "d_pred": F.col("lr_pred")})
    return forecast_metrics(scored, ["ticker", "fold"]).select("ticker", "fold", "rmse", "mae", "directional_accuracy", "r2")


def walk_forward_eval_summary(folds: DataFrame) -> DataFrame:
    return folds.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.avg("directional_accuracy").alias("mean_directional_accuracy"),
        F.stddev_pop("directional_accuracy").alias("std_directional_accuracy"),
        F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"),
    )


LAGS = 5


def lag_features(df: DataFrame, lags: int = LAGS) -> DataFrame:
    return df.withColumns({f"lag{i}": F.lag("log_return", i).over(by_ticker()) for i in range(lags)}).dropna(
        subset=[f"lag{i}" for i in range(lags)]
    )


def return_forecaster(df: DataFrame) -> DataFrame:
    """Panel-wide MLlib regressions on lagged returns: fit on train rows, predict test prices."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression

    from tickloom.session import materialise

    columns = [f"lag{i}" for i in range(LAGS)]
    table = materialise(lag_features(df).select("ticker", "dt", "close", "split", "target", *columns))
    points = VectorAssembler(inputCols=columns, outputCol="x").transform(table)
    train, test = points.where("split = 'train'"), points.where("split = 'test'")
    linear = LinearRegression(featuresCol="x", labelCol="target", predictionCol="linear").fit(train)
    tree = DecisionTreeRegressor(featuresCol="x", labelCol="target", predictionCol="tree", maxDepth=4, seed=42).fit(train)
    out = tree.transform(linear.transform(test))
    return out.select(
        "ticker", "dt", price_from_log_return(F.col("close"), F.col("target")).alias("actual"),
        *[price_from_log_return(F.col("close"), F.col(m)).alias(m) for m in ("linear", "tree")],
    )


def batch_score(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Predicted next return of each row by its ticker's fitted coefficients (``fit_ar1``), one expression a row."""
    scored = rows.join(fit.select("ticker", "slope", "intercept"), "ticker")
    return scored.withColumn("score", F.col("intercept") + F.col("slope") * F.col("log_return"))


def forecast_record(features: DataFrame, steps: int = 5) -> DataFrame:
    """One record per ticker: the fit, its errors on test prices beside the naive ones, the band, the horizon.

    Each part is a per-ticker aggregate of at most one row (the horizon: ``steps`` rows gathered into an array).
    """
    df = with_split(with_target(features))
    fit = fit_ar1(df)
    test = batch_score(df.where("split = 'test'"), fit).withColumns(
        {
            "actual": price_from_log_return(F.col("close"), F.col("target")),
            "fitted": price_from_log_return(F.col("close"), F.col("score")),
        }
    )
    both = F.array(
        F.struct(F.lit("fitted").alias("model"), F.col("fitted").alias("pred"), F.col("score").alias("d_pred")),
        F.struct(F.lit("naive").alias("model"), F.col("close").alias("pred"), F.lit(0.0).alias("d_pred")),
    )
    long = test.select("ticker", "actual", F.col("target").alias("d_actual"), F.inline(both))
    metrics = forecast_metrics(long, ["ticker", "model"])
    errors = metrics.groupBy("ticker").agg(
        *[F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}") for m in ("fitted", "naive") for c in ("rmse", "mae")],
        F.max(F.when(F.col("model") == "fitted", F.col("directional_accuracy"))).alias("directional_accuracy"),
    )
    spread = test.groupBy("ticker").agg(F.stddev_pop(F.col("target") - F.col("score")).alias("residual_sd"))
    path = roll_forecast(features, steps)
    horizon = path.groupBy("ticker").agg(
        F.max(F.when(F.col("step") == 1, F.col("price"))).alias("next_price"),
        F.max(F.when(F.col("step") == steps, F.col("price"))).alias("horizon_price"),
    )
    out = fit.join(errors, "ticker").join(spread, "ticker").join(horizon, "ticker")
    sd = F.col("residual_sd") * 1.96
    return out.withColumns({"lower": F.col("next_price") * F.exp(-sd), "upper": F.col("next_price") * F.exp(sd)})
