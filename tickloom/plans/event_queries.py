"""Queries on texts, vectors, model runs, request logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.vectors import similar_vectors as nearest_vectors
from tickloom.operators import alerts, regimes, sentiment, telemetry
from tickloom.operators.indicators import indicator_columns, regime_features
from tickloom.plans.panels import rounded, service_regimes
from tickloom.session import materialise
from tickloom.sources import tables
from tickloom.sources.bars import as_trades, load_bars
from tickloom.streaming import alert_state, run, windows

AS_OF = "2001-08-01"


def _lexicon(spark, sf):
    docs = tables.texts(spark, sf)
    derived = sentiment.frequent_terms(docs)
    finance = sentiment.finance_lexicon(spark)
    return finance.unionByName(derived.join(F.broadcast(finance.select("term")), "term", "left_anti"))


def _scores(spark, sf):
    return sentiment.score_texts(tables.texts(spark, sf), _lexicon(spark, sf), ["text_id", "grp"])


def lexicon_score(spark, sf):
    return _scores(spark, sf).select("text_id", "compound", "positive", "negative", "neutral")


def sentiment_label(spark, sf):
    return _scores(spark, sf).select("text_id", "label", "confidence")


def recency_sentiment(spark, sf):
    out = sentiment.recency_sentiment(_scores(spark, sf), "grp", "text_id")
    return rounded(out, {c: 4 for c in [*sentiment.SHARES, "confidence"]})


def bull_bear_split(spark, sf):
    out = sentiment.recency_sentiment(_scores(spark, sf), "grp", "text_id").withColumn("compound", F.round("compound", 4))
    return sentiment.bull_bear_split(out).select("grp", "compound", "bullish_pct", "bearish_pct")


def regime_text_sentiment(spark, sf):
    """Finance lexicon over a line of text about every bar: its regime's description, and how its return stands to it."""
    bars = regimes.with_profile(service_regimes(spark, sf).select("ticker", "dt", "regime", "log_return"))
    up = F.col("log_return") > 0
    opening = (
        F.when(F.col("regime").isin(0, 3) & up, "A VERY strong rally!!")
        .when(F.col("regime").isin(0, 3), "Not a rally today, but")
        .when(F.col("regime").isin(4, 5) & up, "Is the selloff over?? Hardly a rebound:")
        .when(F.col("regime").isin(4, 5), "Extremely bearish, no growth without risks!")
        .otherwise("Stable, so")
    )
    texts = bars.select("ticker", "dt", F.concat_ws(" ", opening, "regime_description").alias("text"))
    return sentiment.score_texts(texts, sentiment.finance_lexicon(spark), ["ticker", "dt"])


def similar_vectors(spark, sf):
    return nearest_vectors(tables.table(spark, sf, "embeddings"))


def _runs(spark, sf):
    return telemetry.with_version(tables.model_runs(spark, sf))


def next_version(spark, sf):
    return telemetry.next_version(_runs(spark, sf))


def best_latest_model(spark, sf):
    return telemetry.best_latest_model(_runs(spark, sf))


def stale_models(spark, sf):
    return telemetry.stale_models(tables.model_runs(spark, sf), AS_OF).select("ticker", "run_id", "trained_at")


def registry_stats(spark, sf):
    return telemetry.registry_stats(tables.model_runs(spark, sf))


def label_counters(spark, sf):
    return telemetry.label_counters(tables.request_log(spark, sf), ["label", "from_cache"])


def _histogram(spark, sf):
    return tables.request_log(spark, sf).groupBy("label").agg(*telemetry.histogram_columns("latency_s"))


def histogram_buckets(spark, sf):
    return telemetry.histogram_buckets(_histogram(spark, sf), ["label"])


def bucket_percentile(spark, sf):
    return telemetry.bucket_percentile(_histogram(spark, sf), ["label"])


def latency_percentiles(spark, sf):
    return telemetry.latency_percentiles(tables.request_log(spark, sf))


def sliding_failure_rate(spark, sf):
    out = telemetry.sliding_failure_rate(tables.request_log(spark, sf))
    return rounded(out.select("event_id", "key", "outcomes", "failure_rate", "tripped"), {"failure_rate": 6})


def rolling_call_count(spark, sf):
    # An hour instead of a minute: the log is sparse.
    out = telemetry.rolling_call_count(tables.request_log(spark, sf), limit=2, seconds=3600.0)
    return out.select("event_id", "key", "calls", "over_limit")


def _rules(spark, sf):
    """Six rules for every brand; the one on low RSI is already triggered."""
    levels = dict(zip(alerts.CONDITIONS, [110.0, 100.2, 60.0, 40.0, 0.0, 9.0]))
    kinds = F.array(*[
        F.struct(F.lit(k).alias("condition_type"), F.lit(v).alias("threshold"), F.lit("TRIGGERED" if k == "RSI_BELOW" else "ACTIVE").alias("status"))
        for k, v in levels.items()
    ])
    brands = tables.table(spark, sf, "part").select(F.col("p_brand").alias("ticker")).distinct()
    rules = brands.select("ticker", F.concat(F.lit("user-"), F.col("ticker")).alias("user_id"), F.inline(kinds))
    return rules.withColumn("rule_id", F.concat_ws(":", "ticker", "condition_type"))


def alert_matches(spark, sf):
    frame = alerts.alert_inputs(service_regimes(spark, sf))
    return rounded(alerts.alert_matches(frame, _rules(spark, sf)), {"value": 6})


def stream_bars(spark, sf):
    return _zoneless(windows.tick_bars(windows.ticks(tables.table(spark, sf, "events"))))


def stream_histogram(spark, sf):
    hist = windows.latency_histogram(tables.request_log(spark, sf))
    return _zoneless(telemetry.histogram_buckets(hist, ["label", "start"]))


def _zoneless(df):
    return df.withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_bars_run(spark, sf):
    return _zoneless(run.drain(windows.tick_bars(windows.ticks(run.read_stream(spark, sf, "events")))))


def stream_histogram_run(spark, sf):
    events = run.read_stream(spark, sf, "events")
    hist = run.drain(windows.latency_histogram(tables.as_request_log(events)))
    return _zoneless(telemetry.histogram_buckets(hist, ["label", "start"]))


def alert_stream_run(spark, sf):
    """Alert rules against a stream of bars: the event stream's closed bars join the rules as they come."""
    bars = windows.tick_bars(windows.ticks(run.read_stream(spark, sf, "events")))
    out = run.drain(alerts.alert_matches(alerts.stream_inputs(bars), _stream_rules(spark, sf)))
    return out.select("rule_id", "user_id", "ticker", "dt", "condition_type", "threshold", "value")


MODEL_DAY = "1999-10-01"


def _regime_models(spark, sf):
    """Regime models fitted on the bars before MODEL_DAY and stored in the shared folder."""
    bars = load_bars(spark, sf, "brand", end=MODEL_DAY)
    features = regime_features(indicator_columns(bars), "drop")
    return materialise(regimes.fit_models(features, starts=1), "regime-models")


def alert_conditions(spark, sf):
    """All six kinds of rules on bars judged by stored regime models."""
    frame = alert_state.batch_inputs(load_bars(spark, sf, "brand"), _regime_models(spark, sf))
    return rounded(alerts.alert_matches(frame, _rules(spark, sf)), {"value": 6})


def alert_conditions_run(spark, sf):
    """The same on a stream of trades: closed bars go through the state of their ticker and meet the rules."""
    trades = as_trades(run.read_stream(spark, sf, "lineitem"), spark, sf, "brand")
    frame = alert_state.stream_inputs(windows.trade_bars(trades), _regime_models(spark, sf))
    return rounded(run.drain(alerts.alert_matches(frame, _rules(spark, sf))), {"value": 6})


def _stream_rules(spark, sf):
    """A rule above and one below the middle of prices for every key of the event log."""
    keys = tables.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("ticker")).distinct()
    both = F.array(
        *[F.struct(F.lit(k).alias("condition_type"), F.lit(v).alias("threshold")) for k, v in (("PRICE_ABOVE", 110.0), ("PRICE_BELOW", 101.0))]
    )
    return keys.select("ticker", F.inline(both)).select(
        F.concat_ws("-", "ticker", "condition_type").alias("rule_id"), F.col("ticker").alias("user_id"), "ticker",
        "condition_type", "threshold", F.lit("ACTIVE").alias("status"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_score, sentiment_label, recency_sentiment, bull_bear_split, regime_text_sentiment, similar_vectors, next_version,
        best_latest_model, stale_models, registry_stats, label_counters, histogram_buckets, bucket_percentile,
        latency_percentiles, sliding_failure_rate, rolling_call_count, alert_matches, stream_bars, stream_histogram,
        stream_bars_run, stream_histogram_run, alert_stream_run, alert_conditions, alert_conditions_run,
    )
}
