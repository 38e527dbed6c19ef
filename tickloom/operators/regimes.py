"""Market regimes: clustering, semantic order, risk score, statistics per regime."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tickloom.constants import (
    ALERT_LEVELS, REGIME_FEATURES, REGIME_PROFILES, REGIME_SHORT_NAMES,
)
from tickloom.functions.series import by_ticker, downsample, forward_fill, full_window, whole_ticker, with_position

K = 6
DIMS = len(REGIME_FEATURES)
Z_COLS = [f"z{i}" for i in range(DIMS)]


def standard_scale(df: DataFrame, columns: list[str] = REGIME_FEATURES) -> DataFrame:
    """Per-ticker z-scores with the population deviation (1 where there is no spread)."""
    out = {}
    for i, name in enumerate(columns):
        std = F.stddev_pop(name).over(whole_ticker())
        out[f"z{i}"] = (F.col(name) - F.avg(name).over(whole_ticker())) / F.when(std > 0, std).otherwise(1.0)
    return df.withColumns(out)


def _lloyd(z: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cluster ids and centres of one series, run until no label changes.

    Starts from six equal slices of ``order``.  Distances compare at nine digits
    and ties take the lower id; a cluster that empties keeps its centre.  Labels
    that come back (a cycle among ties) end the run as well.
    """

    def nearest(centers):
        dist = ((z[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2)
        return np.floor(dist * 1e9 + 0.5).argmin(axis=1)

    slices = np.array_split(order, min(K, len(z)))
    centers = np.array([z[rows].mean(axis=0) for rows in slices])
    seen = set()
    labels = nearest(centers)
    while labels.tobytes() not in seen:
        seen.add(labels.tobytes())
        for k in range(len(centers)):
            members = z[labels == k]
            if len(members):
                centers[k] = members.mean(axis=0)
        labels = nearest(centers)
    return labels, centers


def _score(z: np.ndarray) -> np.ndarray:
    return 2.0 * z[:, 4] + 1.5 * z[:, 0] - 3.0 * z[:, 3]


def _spread_seeds(z: np.ndarray, start: int, count: int) -> np.ndarray:
    """Rows of ``count`` first centres: each is drawn in proportion to the squared distance from those before it.

    Draws are hashes of (start, centre), so a refit gives the same seeds.  Rows that all coincide give the first ones.
    """
    from tickloom.functions.hashing import uniform_value

    rows = [min(int(uniform_value(f"{start}:0") * len(z)), len(z) - 1)]
    far = ((z - z[rows[0]]) ** 2).sum(axis=1)
    for j in range(1, count):
        total = np.cumsum(far)
        row = int(np.searchsorted(total, uniform_value(f"{start}:{j}") * total[-1])) if total[-1] > 0 else j
        rows.append(min(row, len(z) - 1))
        far = np.minimum(far, ((z - z[rows[-1]]) ** 2).sum(axis=1))
    return np.array(rows)


def _best_of_starts(z: np.ndarray, order: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Labels, centres, number and inertia of the best start; ``z`` in order of time.

    Start 0 is the one of ``_lloyd``, the others are seeded by distance.  All run side by side in one array until their
    labels come back.  Inertias compare at six digits and the lower start wins ties.
    """
    k, n = min(K, len(z)), len(z)
    first = np.array([z[rows].mean(axis=0) for rows in np.array_split(order, k)])
    centers = np.stack([first, *[z[_spread_seeds(z, s, k)] for s in range(1, starts)]])
    labels, seen = np.zeros((starts, n), np.int64), [set() for _ in range(starts)]

    def assign(live):
        for s in live:
            dist = ((z[:, None, :] - centers[s][None, :, :]) ** 2).sum(axis=2)
            labels[s] = np.floor(dist * 1e9 + 0.5).argmin(axis=1)

    live = list(range(starts))
    assign(live)
    while live:
        live = [s for s in live if labels[s].tobytes() not in seen[s]]
        for s in live:
            seen[s].add(labels[s].tobytes())
        if live:
            flat = (labels[live] + k * np.arange(len(live))[:, None]).ravel()
            size = np.bincount(flat, minlength=k * len(live)).reshape(-1, k)
            for d in range(z.shape[1]):
                sums = np.bincount(flat, weights=np.tile(z[:, d], len(live)), minlength=k * len(live)).reshape(-1, k)
                centers[live, :, d] = np.where(size > 0, sums / np.maximum(size, 1), centers[live, :, d])
            assign(live)
    inertia = np.array([((z - centers[s][labels[s]]) ** 2).sum() for s in range(starts)])
    best = int(np.floor(inertia * 1e6 + 0.5).argmin())
    return labels[best], centers[best], best, float(inertia[best])


def _ranks(centers: np.ndarray) -> np.ndarray:
    """Regime of each cluster: 0 for the most bullish centre."""
    rank = np.empty(len(centers), dtype=np.int32)
    rank[np.argsort(-np.round(_score(centers), 9), kind="stable")] = np.arange(len(centers), dtype=np.int32)
    return rank


def fit_models(features: DataFrame, starts: int = 20) -> DataFrame:
    """One model per ticker, to be stored and applied to later bars: ticker, means, stds, centers, ranks, start, inertia.

    Scale and centres come from the given rows alone.  A model is 46 numbers, whatever the length of the series.
    """
    rows = features.select("ticker", "dt", *[F.col(c).cast("double").alias(c) for c in REGIME_FEATURES])

    def fit(series: pa.Table) -> pa.Table:
        days = series["dt"].cast(pa.int32()).to_numpy()
        x = np.column_stack([series[c].to_numpy() for c in REGIME_FEATURES])[np.argsort(days, kind="stable")]
        means, stds = x.mean(axis=0), x.std(axis=0)
        stds = np.where(stds > 0, stds, 1.0)
        z = (x - means) / stds
        _, centers, start, inertia = _best_of_starts(z, np.lexsort((np.arange(len(z)), -_score(z))), starts)
        return pa.table(
            {
                "ticker": series["ticker"][:1].cast(pa.string()), "means": pa.array([means.tolist()]), "stds": pa.array([stds.tolist()]),
                "centers": pa.array([centers.ravel().tolist()]), "ranks": pa.array([_ranks(centers).tolist()], pa.list_(pa.int32())),
                "start": pa.array([start], pa.int32()), "inertia": pa.array([inertia]),
            }
        )

    kinds = "ticker string, means array<double>, stds array<double>, centers array<double>, ranks array<int>, start int, inertia double"
    return rows.groupBy("ticker").applyInArrow(fit, kinds)


def grouped_kmeans(df: DataFrame, starts: int = 1) -> DataFrame:
    """Fit and label every ticker; adds ``cluster``, ``regime`` and the flat ``centers``.

    Regimes rename the clusters by the score of their centre: 0 most bullish, 5
    most stressed.  A series is bounded by the calendar, so Spark spreads whole
    series over tasks and each fit is a few array operations; the bars are
    already partitioned by ticker and do not move for it.  With several
    ``starts`` the one of lowest inertia wins, and ``start`` and ``inertia`` are
    added.
    """
    schema = StructType(
        [f for f in df.schema.fields]
        + [
            StructField("cluster", IntegerType()),
            StructField("regime", IntegerType()),
            StructField("centers", ArrayType(DoubleType())),
        ]
        + ([StructField("start", IntegerType()), StructField("inertia", DoubleType())] if starts > 1 else [])
    )

    def fit(series: pa.Table) -> pa.Table:
        z = np.column_stack([series[c].to_numpy() for c in Z_COLS])
        days = series["dt"].cast(pa.int32()).to_numpy()
        if starts > 1:
            in_time = np.argsort(days, kind="stable")
            ordered, labels = z[in_time], np.empty(len(z), np.int64)
            found, centers, start, inertia = _best_of_starts(ordered, np.lexsort((days[in_time], -_score(ordered))), starts)
            labels[in_time] = found
        else:
            labels, centers = _lloyd(z, np.lexsort((days, -_score(z))))
        flat = np.tile(centers.ravel(), len(z))
        offsets = np.arange(len(z) + 1, dtype=np.int32) * centers.size
        out = (
            series.append_column("cluster", pa.array(labels.astype(np.int32)))
            .append_column("regime", pa.array(_ranks(centers)[labels]))
            .append_column("centers", pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
        )
        if starts > 1:
            out = out.append_column("start", pa.array(np.full(len(z), start, np.int32))).append_column("inertia", pa.array(np.full(len(z), inertia)))
        return out

    return df.groupBy("ticker").applyInArrow(fit, schema)


def _center(k: int, d: int) -> Column:
    return F.get("centers", k * DIMS + d)


def squared_distance(k: int, z: list[Column] | None = None) -> Column:
    z = z or [F.col(c) for c in Z_COLS]
    total = F.lit(0.0)
    for d in range(DIMS):
        total = total + F.pow(z[d] - _center(k, d), 2)
    return total


def classify_regimes(features: DataFrame, starts: int = 1) -> DataFrame:
    """Scale, cluster and order; keeps z-scores and centres for the diagnostics below."""
    return grouped_kmeans(standard_scale(features), starts)


def drop_centers(df: DataFrame) -> DataFrame:
    return df.drop("centers", "cluster", *Z_COLS)


def pooled_kmeans(features: DataFrame, seeds: list[int], k: int = K) -> DataFrame:
    """One model for the whole panel: the best of several MLlib fits."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    from tickloom.session import materialise

    points = VectorAssembler(inputCols=Z_COLS, outputCol="_features").transform(materialise(features))
    models = [KMeans(k=k, seed=s, featuresCol="_features", predictionCol="cluster").fit(points) for s in seeds]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(points).drop("_features")


# ---------------------------------------------------------------------------
# Risk
# ---------------------------------------------------------------------------

def with_risk_score(df: DataFrame) -> DataFrame:
    """Volatility stress, RSI extremity, trend and momentum, smoothed; 7.5 at least in regimes 4 and 5."""
    df = df.withColumns(
        {
            "_v20": full_window(F.col("log_return"), F.stddev_samp, 20),
            "_v90": full_window(F.col("log_return"), F.stddev_samp, 90),
        }
    )
    base = F.when(F.col("_v90") == 0, F.lit(1e-9)).otherwise(F.col("_v90"))
    ratio = F.col("_v20") / base
    stress = (F.least(F.greatest(ratio, F.lit(0.5)), F.lit(3.0)) - 0.5) / 2.5 * 3.0
    extremity = F.least(F.abs(F.col("rsi14") - 50.0) / 50.0 * 3.0, F.lit(3.0))
    trend = F.when(F.col("close") < F.col("ema20"), 2.0).otherwise(0.0)
    momentum = F.when(F.col("macd_hist") < 0, 2.0).otherwise(0.0)
    raw = F.least(F.greatest(stress + extremity + trend + momentum, F.lit(0.0)), F.lit(10.0))
    df = df.withColumn("_raw", F.when(ratio.isNotNull(), raw))
    df = df.withColumn("_smooth", full_window(F.col("_raw"), F.avg, 5))
    floor = F.when(F.col("regime").isin(4, 5), F.greatest(F.col("_smooth"), F.lit(7.5))).otherwise(F.col("_smooth"))
    # greatest() skips nulls, so a missing score must be kept missing by hand.
    score = F.when(F.col("_smooth").isNotNull(), F.least(F.greatest(floor, F.lit(0.0)), F.lit(10.0)))
    df = df.withColumn("_score", score)
    return df.withColumn("risk_score", F.coalesce(forward_fill(F.col("_score")), F.lit(5.0))).drop(
        "_v20", "_v90", "_raw", "_smooth", "_score"
    )


def alert_level(regime: Column, risk: Column) -> Column:
    return (
        F.when(regime.isin(0, 3) & (risk < 4.5), "GREEN")
        .when(regime.isin(4, 5) | (risk >= 7.0), "RED")
        .otherwise("YELLOW")
    )


def _choose(key: Column, table: dict, position: int) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v[position])]
    return F.element_at(F.create_map(*pairs), key)


def with_alert(df: DataFrame) -> DataFrame:
    df = df.withColumn("alert", alert_level(F.col("regime"), F.col("risk_score")))
    return df.withColumns(
        {
            "alert_label": _choose(F.col("alert"), ALERT_LEVELS, 0),
            "alert_color": _choose(F.col("alert"), ALERT_LEVELS, 1),
            "alert_description": _choose(F.col("alert"), ALERT_LEVELS, 2),
        }
    )


def with_profile(df: DataFrame, regime: str = "regime") -> DataFrame:
    """Name, colour and description of a regime, from a six-entry literal map."""
    key = F.col(regime).cast("int")
    return df.withColumns(
        {
            "regime_name": _choose(key, REGIME_PROFILES, 0),
            "regime_color": _choose(key, REGIME_PROFILES, 1),
            "regime_description": _choose(key, REGIME_PROFILES, 2),
        }
    )


def align_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Bars with the label of their date, the last one before it, or 5."""
    joined = df.join(labels.select("ticker", "dt", "label"), ["ticker", "dt"], "left")
    return joined.withColumn("label", F.coalesce(forward_fill(F.col("label")), F.lit(5)))


# ---------------------------------------------------------------------------
# Statistics
# ---------------------------------------------------------------------------

HORIZONS = (5, 10, 20)


def forward_stats(df: DataFrame, samples: int | None = 10) -> DataFrame:
    """Forward returns per regime and horizon; the last 20 rows are not eligible.

    ``samples`` recent returns are listed beside the statistics of all; None lists all.
    """
    df = with_position(df.select("ticker", "dt", "close", "regime"), count="n")
    forward = {
        f"_f{h}": (F.try_divide(F.lead("close", h).over(by_ticker()), F.col("close")) - 1.0) * 100.0 for h in HORIZONS
    }
    df = df.withColumns(forward).where(F.col("seq") < F.col("n") - 20)
    pairs = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"_f{h}").alias("fwd")) for h in HORIZONS])
    long = df.select("ticker", "dt", "regime", F.inline(pairs)).where(F.col("fwd").isNotNull())
    recent = Window.partitionBy("ticker", "regime", "horizon").orderBy(F.col("dt").desc())
    long = long.withColumn("_back", F.row_number().over(recent))
    # Adding zero turns a rounded -0.0 into 0.0, which SQL engines print differently.
    sample = F.struct("dt", (F.round("fwd", 2) + 0.0).alias("v"))
    last = sample if samples is None else F.when(F.col("_back") <= samples, sample)
    stats = long.groupBy("ticker", "regime", "horizon").agg(
        F.count("fwd").alias("count"),
        F.percentile("fwd", F.lit(0.5)).alias("median"),
        F.avg("fwd").alias("mean"),
        (F.avg(F.when(F.col("fwd") > 0, 1.0).otherwise(0.0)) * 100).alias("pct_positive"),
        F.array_sort(F.collect_list(last))["v"].alias("samples"),
    )
    # Every ticker reports all six regimes: absent ones count 0.
    grid = F.array(*[F.struct(F.lit(r).alias("regime"), F.lit(h).alias("horizon")) for r in range(K) for h in HORIZONS])
    cells = df.select("ticker").distinct().select("ticker", F.inline(grid))
    out = cells.join(stats, ["ticker", "regime", "horizon"], "left").withColumns(
        {
            "count": F.coalesce("count", F.lit(0)).cast("bigint"),
            "samples": F.coalesce("samples", F.array().cast("array<double>")),
        }
    )
    # Eligible rows reach every horizon, so a regime's days are the count of any of them.
    days = F.max("count").over(Window.partitionBy("ticker", "regime"))
    return with_profile(out.withColumn("total_days", days)).drop("regime_color", "regime_description")


def similar_scenarios(df: DataFrame, top_k: int = 5, horizon: int = 10, exclude: int = 15) -> DataFrame:
    """Earlier rows most like the latest one (cosine of z-scores) and what followed.

    Needs ``z0..z4``, ``close`` and ``regime``; series under 30 rows give nothing.
    """
    df = with_position(df, count="n").where(F.col("n") >= 30)
    last = F.max_by(F.array(*Z_COLS), "seq").over(whole_ticker())
    df = df.withColumns(
        {
            "_t": last,
            "path": F.collect_list("close").over(by_ticker().rowsBetween(0, horizon)),
        }
    )
    dot, own, target = F.lit(0.0), F.lit(0.0), F.lit(0.0)
    for i, z in enumerate(Z_COLS):
        dot = dot + F.col(z) * F.col("_t")[i]
        own = own + F.col(z) * F.col(z)
        target = target + F.col("_t")[i] * F.col("_t")[i]
    df = df.withColumn("similarity", F.coalesce(F.try_divide(dot, F.sqrt(own) * F.sqrt(target)), F.lit(0.0)))
    df = df.where(F.col("seq") < F.col("n") - exclude)
    best = Window.partitionBy("ticker").orderBy(F.round("similarity", 9).desc(), F.col("dt"))
    df = df.withColumn("match", F.row_number().over(best)).where(F.col("match") <= top_k)
    rebased = F.transform("path", lambda p: F.round(F.try_divide(p, F.col("path")[0]) * 100.0, 2))
    return with_profile(df).select(
        "ticker", "match", "dt", "regime_name", "regime_color",
        F.round(F.col("similarity") * 100.0, 1).alias("similarity_pct"),
        F.round((F.try_divide(F.element_at("path", -1), F.col("path")[0]) - 1.0) * 100.0, 2).alias("fwd_10d_ret"),
        rebased.alias("price_path"),
    )


def regime_timeline(df: DataFrame) -> DataFrame:
    return with_profile(downsample(df, 500, keep_last=True)).select(
        "ticker", "dt", F.col("regime").alias("regime_id"), "regime_name", "regime_color", "risk_score", "close"
    )


def transition_matrix(df: DataFrame) -> DataFrame:
    """P(next | current) for all 36 pairs; a regime that never occurs has a zero row."""
    steps = df.select("ticker", F.col("regime").alias("cur"), F.lead("regime").over(by_ticker()).alias("nxt"))
    grid = F.array(*[F.struct(F.lit(a).alias("from_regime"), F.lit(b).alias("to_regime")) for a in range(K) for b in range(K)])
    counts = steps.groupBy("ticker").agg(
        *[F.count_if((F.col("cur") == a) & (F.col("nxt") == b)).alias(f"_{a}{b}") for a in range(K) for b in range(K)]
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(a).alias("from_regime"), F.lit(b).alias("to_regime"),
                F.col(f"_{a}{b}").alias("transitions"),
                sum((F.col(f"_{a}{j}") for j in range(K)), F.lit(0)).alias("leaving"),
            )
            for a in range(K) for b in range(K)
        ]
    )
    share = F.when(F.col("leaving") > 0, F.col("transitions") / (F.col("leaving") + 1e-12)).otherwise(0.0)
    return counts.select("ticker", F.inline(cells)).withColumn("probability", F.round(share, 3)).drop("leaving")


def with_confidence(df: DataFrame) -> DataFrame:
    """1 - distance to the nearest centre / largest distance of the series to any centre."""
    dist = [F.sqrt(squared_distance(k)) for k in range(K)]
    df = df.withColumns({"_near": F.least(*dist), "_far": F.greatest(*dist)})
    far = F.max("_far").over(whole_ticker())
    return df.withColumn("confidence", 1.0 - F.col("_near") / (far + 1e-12)).drop("_near", "_far")


def confidence_by_regime(df: DataFrame) -> DataFrame:
    """Current confidence and the mean per regime (0 where a regime does not occur)."""
    means = [
        F.coalesce(F.round(F.avg(F.when(F.col("regime") == k, F.col("confidence"))), 3), F.lit(0.0)).alias(f"_{k}")
        for k in range(K)
    ]
    agg = with_confidence(df).groupBy("ticker").agg(F.round(F.max_by("confidence", "dt"), 3).alias("current"), *means)
    cells = F.array(*[F.struct(F.lit(n).alias("regime_name"), F.col(f"_{k}").alias("confidence")) for k, n in enumerate(REGIME_SHORT_NAMES)])
    return agg.select("ticker", "current", F.inline(cells))


def feature_importance(df: DataFrame) -> DataFrame:
    """Relative growth of the within-cluster distance when one feature is shuffled.

    The shuffle is a fixed permutation per feature: the row in position p takes the value of the row whose hash ranks
    p-th.  A series is bounded by the calendar, so it is permuted where it is and gives one row per feature.
    """
    from tickloom.functions.hashing import bits_value

    def shuffled(series: pa.Table) -> pa.Table:
        days = series["dt"].cast(pa.int32()).to_numpy()
        z = np.column_stack([series[c].to_numpy() for c in Z_COLS])[np.argsort(days, kind="stable")]
        centers = np.array(series["centers"][0].as_py(), dtype=float).reshape(-1, DIMS)
        near = lambda points: ((points[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2).min(axis=1).sum()
        own, gains = near(z), []
        for f in range(DIMS):
            bits = np.array([bits_value(f"{f}:{p}") for p in range(len(z))], np.int64)
            mixed = z.copy()
            mixed[:, f] = z[np.lexsort((np.arange(len(z)), bits)), f]
            gains.append(near(mixed))
        return pa.table(
            {
                "ticker": pa.array([series["ticker"][0].as_py()] * DIMS, pa.string()), "f": pa.array(range(DIMS), pa.int32()),
                "_own": pa.array([own] * DIMS, pa.float64()), "_new": pa.array(gains, pa.float64()),
            }
        )

    out = df.select("ticker", "dt", "centers", *Z_COLS).groupBy("ticker").applyInArrow(shuffled, "ticker string, f int, _own double, _new double")
    name = F.element_at(F.array(*[F.lit(c) for c in REGIME_FEATURES]), F.col("f") + 1)
    gain = F.round((F.col("_new") - F.col("_own")) / (F.col("_own") + 1e-12), 4)
    out = out.select("ticker", name.alias("feature"), gain.alias("importance"))
    order = Window.partitionBy("ticker").orderBy(F.col("importance").desc(), "feature")
    return out.withColumn("rank", F.row_number().over(order))


def regime_scoreboard(df: DataFrame) -> DataFrame:
    """Latest regime, risk, alert and indicators of every ticker."""
    cols = ["dt", "regime", "risk_score", "close", "rsi14", "ema20", "macd", "macd_hist", "log_return"]
    latest = df.groupBy("ticker").agg(F.max_by(F.struct(*cols), "dt").alias("row")).select("ticker", "row.*")
    return with_alert(with_profile(latest))
