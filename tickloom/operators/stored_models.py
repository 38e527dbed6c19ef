"""Return models fitted once, kept in the shared folder with their versions, and applied to later rows.

A version is a fitted pipeline (lags to vector, range scaler, regression) in its own folder, and one row of the run
table that ``telemetry`` reads: the best ready run is chosen there, loaded from its folder and applied to a table.
"""

from __future__ import annotations

import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.forecast import LAGS, ensemble_band, fit_ar1, lag_features, price_from_log_return
from tickloom.operators.telemetry import best_latest_model, with_version
from tickloom.session import materialise, shared_path

PANEL = "panel"


def lag_columns(lags: int) -> list[str]:
    return [f"lag{i}" for i in range(lags)]


def model_table(rows: DataFrame) -> DataFrame:
    """Rows with all lags, written once: several fits and the scoring read it."""
    return materialise(lag_features(rows).select("ticker", "dt", "close", "split", "target", "log_return", *lag_columns(LAGS)), "model-rows")


def pipeline(regression, lags: int) -> Pipeline:
    """Assemble and scale ``lags`` returns for a regression on the next one."""
    vector = VectorAssembler(inputCols=lag_columns(lags), outputCol="raw")
    scaler = MinMaxScaler(inputCol="raw", outputCol="scaled")
    return Pipeline(stages=[vector, scaler, regression.setFeaturesCol("scaled").setLabelCol("target").setPredictionCol("score")])


def fit_versions(table: DataFrame, lags: list[int], trained_at: datetime.date) -> tuple[DataFrame, dict[str, str]]:
    """Fit and store one version per entry of ``lags``: the run table, and the folder of each version.

    A run's error is that on the validation rows, which no fit has seen.
    """
    spark, train, val = table.sparkSession, table.where("split = 'train'"), table.where("split = 'val'")
    runs, folders = [], {}
    for k, n in enumerate(lags):
        model = pipeline(LinearRegression(), n).fit(train)
        path = shared_path(spark, f"model-v{k + 1}")
        model.save(path)
        miss = model.transform(val).agg(F.sqrt(F.avg(F.pow(F.col("score") - F.col("target"), 2)))).first()[0]
        runs.append((PANEL, k, "ready" if miss is not None else "failed", miss, trained_at + datetime.timedelta(days=k)))
        folders[f"v{k + 1}"] = path
    return spark.createDataFrame(runs, "ticker string, run_id long, status string, rmse double, trained_at date"), folders


def batch_score(rows: DataFrame, runs: DataFrame, folders: dict[str, str], which: str = "best") -> DataFrame:
    """Rows with the version used and its score; ``which``: the ``best`` ready version or the ``latest`` one."""
    if which not in ("best", "latest"):
        raise ValueError("which must be best or latest")
    chosen = best_latest_model(with_version(runs)).first()
    if chosen is None:
        raise ValueError("no ready model")
    version = chosen[which]
    scored = PipelineModel.load(folders[version]).transform(rows)
    return scored.drop("raw", "scaled").withColumn("version", F.lit(version))


def ensemble_members(table: DataFrame, trees: int = 10) -> DataFrame:
    """Test rows as (ticker, dt, model, pred), a price per member: linear, boosted trees, and the ticker's own AR(1)."""
    train, test = table.where("split = 'train'"), table.where("split = 'test'")
    linear = pipeline(LinearRegression(), LAGS).fit(train)
    boosted = pipeline(GBTRegressor(maxIter=trees, maxDepth=3, seed=42), LAGS).fit(train)
    scored = test
    for name, model in (("linear", linear), ("boosted", boosted)):
        scored = model.transform(scored).drop("raw", "scaled").withColumnRenamed("score", name)
    own = fit_ar1(table).select("ticker", "slope", "intercept")
    scored = scored.join(own, "ticker").withColumn("ar1", F.col("intercept") + F.col("slope") * F.col("log_return"))
    members = F.array(*[F.struct(F.lit(m).alias("model"), price_from_log_return(F.col("close"), F.col(m)).alias("pred")) for m in ("linear", "boosted", "ar1")])
    return scored.select("ticker", "dt", F.inline(members))


def ensemble_forecast(table: DataFrame, trees: int = 10) -> DataFrame:
    """Members and, as model ``ensemble``, their mean with its band, in one long table."""
    members = materialise(ensemble_members(table, trees), "members")
    band = ensemble_band(members).select("ticker", "dt", F.lit("ensemble").alias("model"), F.col("ensemble").alias("pred"), "lower", "upper")
    none = F.lit(None).cast("double")
    return members.select("ticker", "dt", "model", "pred", none.alias("lower"), none.alias("upper")).unionByName(band)
