import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.constants import REGIME_FEATURES
from tickloom.operators import regimes
from tickloom.operators.indicators import engineer_features, regime_features


@pytest.fixture(scope="module")
def labelled(bars_of, walk):
    feats = regime_features(engineer_features(bars_of({t: walk(260, i + 3) for i, t in enumerate("ABC")})))
    return regimes.classify_regimes(feats).persist()


def test_labels_cover_the_six_regimes(labelled):
    rows = labelled.collect()
    assert {r["regime"] for r in rows} == set(range(6))
    for t in "ABC":
        own = [r for r in rows if r["ticker"] == t]
        pairs = {(r["cluster"], r["regime"]) for r in own}
        assert len(pairs) == len({c for c, _ in pairs})


def test_order_follows_the_score_of_the_centres(labelled):
    for r in labelled.where("ticker = 'A'").select("regime", "cluster", "centers").distinct().collect():
        score = lambda k: 2 * r["centers"][5 * k + 4] + 1.5 * r["centers"][5 * k] - 3 * r["centers"][5 * k + 3]
        ahead = sum(score(k) > score(r["cluster"]) for k in range(6))
        assert ahead == r["regime"]


def test_centres_are_the_means_of_their_members(labelled):
    means = labelled.groupBy("ticker", "cluster").agg(
        F.array(*[F.avg(z) for z in regimes.Z_COLS]).alias("mean"), F.first("centers").alias("centers")
    )
    rows = means.collect()
    assert len(rows) == 18
    for r in rows:
        assert r["centers"][5 * r["cluster"] : 5 * r["cluster"] + 5] == pytest.approx(r["mean"], abs=1e-9)


def test_clustering_is_a_fixed_point_or_close(labelled):
    again = labelled.withColumn("near", F.least(*[regimes.squared_distance(k) for k in range(6)]))
    own = F.array(*[regimes.squared_distance(k) for k in range(6)])[F.col("cluster")]
    assert again.where(own > F.col("near") + 1e-8).count() == 0


def test_scale_has_unit_population_deviation(labelled):
    row = labelled.where("ticker = 'B'").agg(F.avg("z0"), F.stddev_pop("z0")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)


def test_risk_stays_missing_before_the_windows_fill(labelled):
    rows = regimes.with_risk_score(labelled).where("ticker = 'A'").orderBy("dt").collect()
    # 90 returns and 5 raw scores are needed; until then the default holds, even in regimes 4 and 5.
    assert all(r["risk_score"] == 5.0 for r in rows[:93])
    assert all(r["risk_score"] >= 7.5 for r in rows[93:] if r["regime"] in (4, 5))


def test_alert_tests_green_first(spark):
    df = spark.createDataFrame([(0, 4.4), (0, 4.5), (3, 7.0), (4, 1.0), (2, 6.9)], "regime int, risk_score double")
    got = [r["alert"] for r in regimes.with_alert(df).collect()]
    assert got == ["GREEN", "YELLOW", "RED", "RED", "YELLOW"]


def test_forward_stats_skip_the_last_twenty_rows(spark):
    rows = [("A", datetime.date(2020, 1, 1) + datetime.timedelta(days=i), 100.0 + i, 0) for i in range(25)]
    df = spark.createDataFrame(rows, "ticker string, dt date, close double, regime int")
    out = {(r["regime"], r["horizon"]): r for r in regimes.forward_stats(df).collect()}
    assert len(out) == 18
    assert out[0, 5]["count"] == 5 and out[0, 20]["count"] == 5 and out[1, 5]["count"] == 0
    assert out[0, 5]["samples"] == [5.0, 4.95, 4.9, 4.85, 4.81]
    assert out[1, 5]["median"] is None and out[1, 5]["samples"] == []


def test_similar_scenarios_exclude_the_last_rows(labelled):
    rows = regimes.similar_scenarios(labelled).collect()
    assert len(rows) == 15
    assert all(r["price_path"][0] == 100.0 and len(r["price_path"]) == 11 for r in rows)
    assert regimes.similar_scenarios(labelled.where("dt < date'2020-02-10'")).count() == 0


def test_transition_rows_sum_to_one_or_zero(labelled):
    sums = regimes.transition_matrix(labelled).groupBy("ticker", "from_regime").agg(F.sum("probability").alias("p"))
    assert all(r["p"] == pytest.approx(1, abs=0.01) or r["p"] == 0 for r in sums.collect())
    assert regimes.transition_matrix(labelled).count() == 3 * 36


def test_confidence_and_importance(labelled):
    conf = regimes.with_confidence(labelled).agg(F.min("confidence"), F.max("confidence")).first()
    assert 0 <= conf[0] <= conf[1] <= 1
    imp = regimes.feature_importance(labelled).where("ticker = 'A'").orderBy("rank").collect()
    assert [r["feature"] for r in imp] != [] and {r["feature"] for r in imp} == set(REGIME_FEATURES)
    assert all(a["importance"] >= b["importance"] for a, b in zip(imp, imp[1:]))


def test_downsample_keeps_the_last_row(bars_of):
    df = bars_of({"A": range(1, 12)})
    assert regimes.downsample(df, 5).count() == 6
    assert regimes.downsample(df, 4, keep_last=True).where("close = 11").count() == 1


def test_labels_align_forward_then_default(spark, bars_of):
    bars = bars_of({"A": [1, 2, 3, 4]})
    labels = bars.where("close = 2").withColumn("label", F.lit(1))
    got = [r["label"] for r in regimes.align_labels(bars, labels).orderBy("dt").collect()]
    assert got == [5, 1, 1, 1]


def test_pooled_model_is_the_best_of_its_seeds(spark, bars_of, walk):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from tickloom.operators.indicators import indicator_columns, regime_features
    from tickloom.operators.regimes import Z_COLS, pooled_kmeans, standard_scale

    points = standard_scale(regime_features(indicator_columns(bars_of({"A": walk(150, 3), "B": walk(90, 5)})), "drop")).select("ticker", "dt", *Z_COLS)
    labelled = pooled_kmeans(points, seeds=[1, 2, 3, 4], k=4)
    rows = labelled.collect()
    assert len(rows) == points.count() and {r["cluster"] for r in rows} == set(range(4))
    groups = {}
    for r in rows:
        groups.setdefault(r["cluster"], []).append([r[z] for z in Z_COLS])
    cost = sum(((np.array(g) - np.mean(g, axis=0)) ** 2).sum() for g in groups.values())
    vectors = VectorAssembler(inputCols=Z_COLS, outputCol="features").transform(points)
    costs = [KMeans(k=4, seed=s).fit(vectors).summary.trainingCost for s in (1, 2, 3, 4)]
    assert cost <= min(costs) * (1 + 1e-6)
