"""Walk-forward ridge fits, stored models and the ensemble against plain numpy."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import forecast, ridge, stored_models
from tickloom.operators.indicators import engineer_features


@pytest.fixture(scope="module")
def rows(spark, bars_of, walk):
    return forecast.with_target(engineer_features(bars_of({"A": walk(260, 3), "B": walk(205, 5), "short": walk(60, 7)}))).cache()


def brute(series, columns, folds, penalty):
    n = len(series)
    size, out = n // (folds + 1), {}
    x = np.array([[float(r[c]) for c in columns] for r in series])
    y = np.array([r["target"] for r in series])
    for f in range(1, folds + 1):
        train, test = slice(0, size * f), slice(size * f, size * (f + 1))
        low, high = x[train].min(axis=0), x[train].max(axis=0)
        scaled = (x - low) / np.where(high > low, high - low, 1.0)
        mean, centre = scaled[train].mean(axis=0), y[train].mean()
        a = scaled[train] - mean
        beta = np.linalg.solve(a.T @ a + penalty * np.eye(len(columns)), a.T @ (y[train] - centre))
        guess = (scaled[test] - mean) @ beta + centre
        close = np.array([r["close"] for r in series])[test]
        miss = close * np.exp(y[test]) - close * np.exp(guess)
        out[f] = (size * f, np.sqrt((miss**2).mean()), np.abs(miss).mean(), 100 * (np.sign(guess) == np.sign(y[test])).mean())
    return out


@pytest.mark.parametrize(("folds", "penalty"), [(5, 1.0), (3, 0.01)])
def test_walk_forward_features(rows, folds, penalty):
    columns = ["close", "rsi14", "macd", "macd_signal", "macd_hist", "log_return"]
    got = ridge.walk_forward_features(rows, columns, folds, length=20, penalty=penalty).collect()
    series = {}
    for r in sorted(rows.collect(), key=lambda r: r["seq"]):
        series.setdefault(r["ticker"], []).append(r)
    for ticker in "AB":
        want = brute(series[ticker], columns, folds, penalty)
        mine = {r["fold"]: r for r in got if r["ticker"] == ticker}
        assert set(mine) == set(want)
        for f, (n, rmse, mae, direction) in want.items():
            assert mine[f]["status"] == "ok" and mine[f]["train_rows"] == n
            assert np.allclose([mine[f]["rmse"], mine[f]["mae"], mine[f]["directional_accuracy"]], [rmse, mae, direction], rtol=1e-7)
    (short,) = [r for r in got if r["ticker"] == "short"]
    assert short["fold"] is None and short["status"] == f"insufficient: {len(series['short'])} rows, need {30 * (folds + 1)}"


def test_a_fold_learns_from_rows_before_it_only(rows):
    one = rows.where("ticker = 'A'")
    changed = one.withColumn("close", F.when(F.col("seq") >= 160, F.col("close") * 3).otherwise(F.col("close")))
    columns = ["close", "log_return"]
    block = F.floor(F.col("seq") / 40).cast("long")
    fits = [ridge.expanding_fits(df.withColumn("block", block), columns, 5).first()["fits"] for df in (one, changed)]
    assert fits[0][:4] == fits[1][:4] and fits[0][4] != fits[1][4]
    gap = one.withColumn("block", block).withColumn("close", F.when(F.col("seq") >= 80, F.col("close")))
    assert [f and f["train_rows"] for f in ridge.expanding_fits(gap, columns, 5).first()["fits"]] == [None, None, 40, 80, 120]


def test_scores_after_reload_equal_scores_before(spark, rows):
    from pyspark.ml.regression import LinearRegression

    table = stored_models.model_table(forecast.with_split(rows))
    runs, folders = stored_models.fit_versions(table, [1, 4, 2], datetime.date(2020, 1, 1))
    test = table.where("split = 'test'")
    errors = {r["run_id"]: r["rmse"] for r in runs.collect()}
    best = min(errors, key=lambda k: (errors[k], k))
    model = stored_models.pipeline(LinearRegression(), [1, 4, 2][best]).fit(table.where("split = 'train'"))
    before = {(r["ticker"], r["dt"]): r["score"] for r in model.transform(test).collect()}
    after = stored_models.batch_score(test, runs, folders).collect()
    assert {r["version"] for r in after} == {f"v{best + 1}"}
    assert {(r["ticker"], r["dt"]): r["score"] for r in after} == before
    assert stored_models.batch_score(test, runs, folders, "latest").first()["version"] == "v3"
    with pytest.raises(ValueError):
        stored_models.batch_score(test, runs.where("status = 'gone'"), folders)


def test_ensemble_band_is_that_of_its_members(rows):
    out = stored_models.ensemble_forecast(stored_models.model_table(forecast.with_split(rows)), trees=2).collect()
    days = {}
    for r in out:
        days.setdefault((r["ticker"], r["dt"]), {})[r["model"]] = r
    assert days
    for members in days.values():
        assert set(members) == {"linear", "boosted", "ar1", "ensemble"}
        values = np.array([members[m]["pred"] for m in ("linear", "boosted", "ar1")])
        e = members["ensemble"]
        assert np.allclose([e["pred"], e["lower"], e["upper"]], [values.mean(), values.mean() - 1.96 * values.std(), values.mean() + 1.96 * values.std()])
        assert members["linear"]["lower"] is None
