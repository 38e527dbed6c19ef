"""Comparison SQL for texts, vectors, model runs, request logs and streams."""

from __future__ import annotations

from oracle.ctes import FEATURES, W, bars, indicators, kmeans, regime_drop, service_regimes, sql, zscores
from tickloom.constants import BOOSTERS, DAMPENERS, FINANCE_LEXICON, LATENCY_BOUNDS, NEGATIONS, REGIME_PROFILES

Q: dict[str, str] = {}
FIN = ", ".join(f"('{t}', {v}::DOUBLE)" for t, v in FINANCE_LEXICON.items())
LETTERS = "\\p{L}+(?:''\\p{L}+)*"


def listed(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def sentiment(source, keys, lexicon):
    """Scores of the texts of ``source`` by windows over their tokens; ends in ``sc``."""
    k = ", ".join(keys)
    lags = ", ".join(f"LAG({c}, {d}) OVER t AS {c}{d}" for c in ("low", "v", "boost", "caps", "neg") for d in (1, 2, 3))
    sign = "CASE WHEN {x} < 0 THEN -1 ELSE 1 END"
    out = [
        ("st", f"SELECT {k}, text, regexp_extract_all(text, '{LETTERS}') AS toks FROM {source}"),
        ("tk0", f"SELECT {k}, UNNEST(toks) AS tok, UNNEST(RANGE(LEN(toks))) AS i FROM st"),
        ("tk1", f"""SELECT {k}, i, LOWER(tok) AS low, tok = UPPER(tok) AND tok <> LOWER(tok) AS caps,
  CASE WHEN LOWER(tok) IN {listed(BOOSTERS)} THEN 0.293::DOUBLE WHEN LOWER(tok) IN {listed(DAMPENERS)} THEN -0.293::DOUBLE ELSE 0::DOUBLE END AS boost,
  LOWER(tok) IN {listed(NEGATIONS)} OR CONTAINS(LOWER(tok), 'n''t') AS neg FROM tk0"""),
        ("tk2", f"SELECT t.*, l.valence AS v FROM tk1 t LEFT JOIN {lexicon} l ON l.term = t.low"),
        ("tk3", f"""SELECT *, {lags}, BOOL_OR(caps) OVER d AND BOOL_OR(NOT caps) OVER d AS diff, MIN(CASE WHEN low = 'but' THEN i END) OVER d AS but
FROM tk2 WINDOW t AS (PARTITION BY {k} ORDER BY i), d AS (PARTITION BY {k})"""),
        ("e0", f"SELECT *, v + CASE WHEN caps AND diff THEN 0.733 * {sign.format(x='v')} ELSE 0 END AS x0 FROM tk3"),
    ]
    for d, scale in ((1, 1.0), (2, 0.95), (3, 0.9)):
        so = {1: "FALSE", 2: "low1 IN ('so', 'this')", 3: "low1 IN ('so', 'this') OR low2 IN ('so', 'this')"}[d]
        doubt = {1: "FALSE", 2: "low1 = 'doubt'", 3: "low1 = 'doubt' OR low2 = 'doubt'"}[d]
        x, s = f"x{d - 1}", sign.format(x=f"x{d - 1}")
        out.append((f"e{d}", f"""SELECT *, CASE WHEN low{d} IS NULL OR v{d} IS NOT NULL THEN {x} ELSE
  ({x} + {scale} * (boost{d} * {s} + CASE WHEN boost{d} <> 0 AND caps{d} AND diff THEN 0.733 * {s} ELSE 0 END))
  * CASE WHEN low{d} = 'never' AND ({so}) THEN 1.25 WHEN low{d} = 'without' AND ({doubt}) THEN 1.0 WHEN neg{d} THEN -0.74 ELSE 1.0 END END AS x{d} FROM e{d - 1}"""))
    return out + [
        ("e4", f"""SELECT {k}, CASE WHEN v IS NULL OR boost <> 0 THEN 0 ELSE x3
  * CASE WHEN low1 = 'least' AND v1 IS NULL AND COALESCE(low2, '') NOT IN ('at', 'very') THEN -0.74 ELSE 1 END
  * CASE WHEN but IS NULL OR i = but THEN 1 WHEN i < but THEN 0.5 ELSE 1.5 END END AS c FROM e3"""),
        ("ts", f"SELECT {k}, SUM(c) AS s, SUM(CASE WHEN c > 0 THEN c + 1 ELSE 0 END) AS p, SUM(CASE WHEN c < 0 THEN 1 - c ELSE 0 END) AS n, COUNT(*) FILTER (c = 0) AS z FROM e4 GROUP BY {k}"),
        ("tm", f"""SELECT {k}, COALESCE(s, 0) AS s, COALESCE(p, 0) AS p, COALESCE(n, 0) AS n, COALESCE(z, 0) AS z,
  LEAST(LENGTH(text) - LENGTH(REPLACE(text, '!', '')), 4) * 0.292::DOUBLE
  + CASE WHEN LENGTH(text) - LENGTH(REPLACE(text, '?', '')) > 3 THEN 0.96::DOUBLE WHEN LENGTH(text) - LENGTH(REPLACE(text, '?', '')) > 1
    THEN (LENGTH(text) - LENGTH(REPLACE(text, '?', ''))) * 0.18::DOUBLE ELSE 0 END AS loud FROM st LEFT JOIN ts USING ({k})"""),
        ("sm", f"""SELECT {k}, s + CASE WHEN s > 0 THEN loud WHEN s < 0 THEN -loud ELSE 0 END AS s, p + CASE WHEN p > n THEN loud ELSE 0 END AS p,
  n + CASE WHEN p < n THEN loud ELSE 0 END AS n, z FROM tm"""),
        ("sc0", f"""SELECT {k}, ROUND(s / SQRT(s * s + 15), 4) AS compound, CASE WHEN p + n + z > 0 THEN ROUND(p / (p + n + z), 3) ELSE 0 END AS positive,
  CASE WHEN p + n + z > 0 THEN ROUND(n / (p + n + z), 3) ELSE 0 END AS negative, CASE WHEN p + n + z > 0 THEN ROUND(z / (p + n + z), 3) ELSE 1 END AS neutral FROM sm"""),
        ("sc", "SELECT *, CASE WHEN compound >= 0.05 THEN 'Bullish' WHEN compound <= -0.05 THEN 'Bearish' ELSE 'Neutral' END AS label, ABS(compound) AS confidence FROM sc0"),
    ]


LEX = [
    ("fin", f"SELECT * FROM (VALUES {FIN}) v(term, valence)"),
    ("docs", "SELECT doc_id AS text_id, source AS grp, COALESCE(text, '') AS text FROM documents"),
    ("tok", f"SELECT UNNEST(REGEXP_EXTRACT_ALL(LOWER(text), '{LETTERS}')) AS term FROM docs"),
    ("frq", "SELECT term, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, term) - 1 AS r FROM tok GROUP BY term QUALIFY r < 200"),
    ("lex", "SELECT * FROM fin UNION ALL SELECT term, ((r % 9) - 4) * 0.5::DOUBLE FROM frq WHERE term NOT IN (SELECT term FROM fin)"),
] + sentiment("docs", ["text_id", "grp"], "lex")
Q["lexicon_score"] = sql(LEX, "SELECT text_id, compound, positive, negative, neutral FROM sc")
Q["sentiment_label"] = sql(LEX, "SELECT text_id, label, confidence FROM sc")
SH = ["compound", "positive", "negative", "neutral"]
REC = LEX + [
    ("wt", "SELECT *, EXP(-0.3 * (ROW_NUMBER() OVER (PARTITION BY grp ORDER BY text_id DESC) - 1)) AS w FROM sc"),
    ("rc", "SELECT grp, " + ", ".join(f"SUM({c} * w) / SUM(w) AS {c}" for c in SH) + " FROM wt GROUP BY grp"),
]
Q["recency_sentiment"] = sql(REC, "SELECT grp, " + ", ".join(f"ROUND({c}, 4) AS {c}" for c in SH)
    + ", CASE WHEN compound >= 0.05 THEN 'Bullish' WHEN compound <= -0.05 THEN 'Bearish' ELSE 'Neutral' END AS label, ROUND(ABS(compound), 4) AS confidence FROM rc")
Q["bull_bear_split"] = sql(REC + [("bb", "SELECT grp, ROUND(compound, 4) AS compound, CAST(GREATEST(0, LEAST(100, FLOOR((ROUND(compound, 4) + 1.0) / 2.0 * 100))) AS INTEGER) AS b FROM rc")],
                           "SELECT grp, compound, b AS bullish_pct, 100 - b AS bearish_pct FROM bb")
ABOUT = " ".join(f"WHEN {k} THEN '{v[2]}'" for k, v in REGIME_PROFILES.items())
Q["regime_text_sentiment"] = sql(
    service_regimes() + [
        ("fin", f"SELECT * FROM (VALUES {FIN}) v(term, valence)"),
        ("lines", f"""SELECT ticker, dt, CASE WHEN regime IN (0, 3) AND log_return > 0 THEN 'A VERY strong rally!!' WHEN regime IN (0, 3) THEN 'Not a rally today, but'
  WHEN regime IN (4, 5) AND log_return > 0 THEN 'Is the selloff over?? Hardly a rebound:' WHEN regime IN (4, 5) THEN 'Extremely bearish, no growth without risks!'
  ELSE 'Stable, so' END || ' ' || CASE regime {ABOUT} END AS text FROM lab"""),
    ] + sentiment("lines", ["ticker", "dt"], "fin"),
    "SELECT ticker, dt, compound, positive, negative, neutral, label, confidence FROM sc")
Q["similar_vectors"] = """
WITH t AS (SELECT embedding::DOUBLE[] AS e, vec_id AS id FROM embeddings ORDER BY vec_id DESC LIMIT 1)
SELECT vec_id, label, ROUND(LIST_DOT_PRODUCT(embedding::DOUBLE[], e) / (SQRT(LIST_DOT_PRODUCT(embedding::DOUBLE[], embedding::DOUBLE[])) * SQRT(LIST_DOT_PRODUCT(e, e))), 6) AS similarity
FROM embeddings, t WHERE vec_id <> id ORDER BY similarity DESC, vec_id LIMIT 5"""

RUNS = [("runs", """SELECT o_orderpriority AS ticker, o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'training' ELSE 'failed' END AS status,
  o_totalprice AS rmse, CAST(o_orderdate AS DATE) AS trained_at, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS num FROM orders""")]
Q["next_version"] = sql(RUNS, "SELECT ticker, 'v' || (MAX(num) + 1) AS next_version FROM runs GROUP BY ticker")
Q["best_latest_model"] = sql(RUNS, """SELECT ticker, 'v' || ARG_MIN(num, (rmse, num)) AS best, MIN(rmse) AS best_rmse, 'v' || MAX(num) AS latest, ARG_MAX(rmse, num) AS latest_rmse
FROM runs WHERE status = 'ready' GROUP BY ticker""")
Q["stale_models"] = sql(RUNS, "SELECT ticker, run_id, trained_at FROM runs WHERE status = 'ready' AND trained_at < DATE '2001-08-01' - 7")
Q["registry_stats"] = sql(RUNS, """SELECT COUNT(DISTINCT ticker) AS total_tickers, COUNT(*) AS total_versions, COUNT(*) FILTER (status = 'ready') AS ready,
  COUNT(*) FILTER (status = 'training') AS training, COUNT(*) FILTER (status = 'failed') AS failed, COUNT(*) FILTER (status NOT IN ('ready', 'training', 'failed')) AS other FROM runs""")

LOG = [("log", """SELECT event_id, CAST(user_id AS VARCHAR) AS key, ts, event_type AS label, value / 50.0::DOUBLE AS latency_s,
  event_type <> 'error' AS ok, event_id % 3 = 0 AS from_cache FROM events""")]
BOUNDS = "(VALUES " + ", ".join(f"({b}::DOUBLE)" for b in LATENCY_BOUNDS) + ", ('Infinity'::DOUBLE)) b(le)"
Q["label_counters"] = sql(LOG, 'SELECT label, from_cache, COUNT(*) AS "count" FROM log GROUP BY ALL')


def buckets(source, keys):
    k = ", ".join(keys)
    on = " AND ".join(f"s.{c} = h.{c}" for c in keys)
    sk = ", ".join("s." + c for c in keys)
    return [("hs", f"SELECT {k}, SUM(latency_s) AS total, COUNT(*) AS c FROM {source} GROUP BY {k}"),
            ("hb", f"SELECT {sk}, ROUND(total, 6) AS sum, c AS \"count\", ROUND(total / c, 6) AS mean, le, (SELECT COUNT(*) FROM {source} h WHERE {on} AND h.latency_s <= le) AS cumulative FROM hs s, {BOUNDS}")]


Q["histogram_buckets"] = sql(LOG + buckets("log", ["label"]), "SELECT * FROM hb")
Q["bucket_percentile"] = sql(
    LOG + buckets("log", ["label"]),
    "SELECT label, " + ", ".join(f'MIN(le) FILTER (cumulative >= {p}::DOUBLE * "count") AS p{int(p * 100)}' for p in (0.5, 0.95, 0.99)) + " FROM hb GROUP BY label")
Q["latency_percentiles"] = sql(
    LOG + [("rk", "SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY latency_s) AS rn, COUNT(*) OVER (PARTITION BY label) AS n FROM log")],
    """SELECT label, COUNT(*) AS total_requests, ROUND(COUNT(*) / ((EPOCH_US(MAX(ts)) - EPOCH_US(MIN(ts))) / 1e6), 6) AS throughput_rps,
  ROUND(AVG(CASE WHEN ok THEN 0.0 ELSE 1.0 END), 4) AS error_rate, ROUND(AVG(CASE WHEN from_cache THEN 1.0 ELSE 0.0 END), 4) AS cache_hit_rate,
  ROUND(MIN(latency_s) * 1000, 2) AS min_ms, ROUND(MAX(latency_s) * 1000, 2) AS max_ms, ROUND(AVG(latency_s) * 1000, 2) AS mean_ms, """
    + ", ".join(f"ROUND(MAX(latency_s) FILTER (rn = CEIL({p}::DOUBLE * n)) * 1000, 2) AS p{int(p * 100)}_ms" for p in (0.5, 0.95, 0.99)) + " FROM rk GROUP BY label")
W20 = "PARTITION BY key ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"
Q["sliding_failure_rate"] = sql(
    LOG + [("fr", f"SELECT event_id, key, COUNT(*) OVER ({W20}) AS outcomes, AVG(CASE WHEN ok THEN 0.0 ELSE 1.0 END) OVER ({W20}) AS r FROM log")],
    "SELECT event_id, key, outcomes, ROUND(r, 6) AS failure_rate, outcomes = 20 AND r >= 0.5 AS tripped FROM fr")
Q["rolling_call_count"] = sql(
    LOG, """SELECT event_id, key, calls, calls > 2 AS over_limit FROM (SELECT event_id, key,
  COUNT(*) OVER (PARTITION BY key ORDER BY EPOCH_US(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls FROM log)""")
RULES = [
    ("kinds", "SELECT * FROM (VALUES ('PRICE_ABOVE', 110.0::DOUBLE, 'ACTIVE'), ('PRICE_BELOW', 100.2, 'ACTIVE'), ('RSI_ABOVE', 60.0, 'ACTIVE'), ('RSI_BELOW', 40.0, 'TRIGGERED'), ('REGIME_CHANGE', 0.0, 'ACTIVE'), ('DRAWDOWN_EXCEEDS', 9.0, 'ACTIVE')) v(condition_type, threshold, status)"),
    ("rules", "SELECT p_brand AS ticker, 'user-' || p_brand AS user_id, p_brand || ':' || condition_type AS rule_id, condition_type, threshold FROM (SELECT DISTINCT p_brand FROM part), kinds WHERE status = 'ACTIVE'"),
]
def inputs(source):
    return [("ai", f"SELECT ticker, dt, close, rsi14, regime, LAG(regime) OVER ({W}) AS prev, (MAX(close) OVER ({W} ROWS UNBOUNDED PRECEDING) - close) / MAX(close) OVER ({W} ROWS UNBOUNDED PRECEDING) * 100 AS drawdown FROM {source}")]


HITS = [("hit", """SELECT *, CASE condition_type WHEN 'PRICE_ABOVE' THEN close WHEN 'PRICE_BELOW' THEN close WHEN 'RSI_ABOVE' THEN rsi14 WHEN 'RSI_BELOW' THEN rsi14
  WHEN 'REGIME_CHANGE' THEN CAST(regime AS DOUBLE) ELSE drawdown END AS value FROM ai JOIN rules USING (ticker)
WHERE (condition_type = 'PRICE_ABOVE' AND close > threshold) OR (condition_type = 'PRICE_BELOW' AND close < threshold) OR (condition_type = 'RSI_ABOVE' AND rsi14 > threshold)
  OR (condition_type = 'RSI_BELOW' AND rsi14 < threshold) OR (condition_type = 'REGIME_CHANGE' AND regime <> prev) OR (condition_type = 'DRAWDOWN_EXCEEDS' AND drawdown > threshold)""")]
MATCHES = "SELECT rule_id, user_id, ticker, dt, condition_type, threshold, ROUND(value, 6) AS value FROM hit"
Q["alert_matches"] = sql(service_regimes() + RULES + inputs("lab") + HITS, MATCHES)
# Regimes of all rows by models of the rows before a day.
SCALE = ", ".join(f"AVG({c}) AS a{i}, CASE WHEN STDDEV_POP({c}) > 0 THEN STDDEV_POP({c}) ELSE 1 END AS s{i}" for i, c in enumerate(FEATURES))
NEAR = " + ".join(f"POW(({c} - a{i}) / s{i} - m{i}, 2)" for i, c in enumerate(FEATURES))
MODEL = bars("brand") + indicators() + regime_drop("ind", "rf") + [("past", "SELECT * FROM rf WHERE dt < DATE '1999-10-01'")] + zscores("past", "z") + kmeans() + [
    ("sc", f"SELECT ticker, {SCALE} FROM past GROUP BY ticker"),
    ("now", f"SELECT r.ticker, r.dt, ARG_MIN(m.regime, (FLOOR(({NEAR}) * 1e9 + 0.5), m.k)) AS regime FROM rf r JOIN sc USING (ticker) JOIN lab_m m ON m.ticker = r.ticker GROUP BY r.ticker, r.dt"),
    ("judged", "SELECT i.ticker, i.dt, i.close, i.rsi14, CAST(n.regime AS INTEGER) AS regime FROM ind i LEFT JOIN now n ON n.ticker = i.ticker AND n.dt = i.dt"),
]
Q["alert_conditions"] = sql(MODEL + RULES + inputs("judged") + HITS, MATCHES)
Q["alert_conditions_run"] = Q["alert_conditions"] + " WHERE dt + INTERVAL '1 day' <= (SELECT MAX(l_shipdate) FROM lineitem) - INTERVAL '1 hour'"
Q["stream_bars"] = """
SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS start, ARG_MIN(px, (ts, event_id)) AS open, MAX(px) AS high, MIN(px) AS low,
  ARG_MAX(px, (ts, event_id)) AS close, COUNT(*) AS volume FROM (SELECT *, 100.0::DOUBLE + value / 10.0::DOUBLE AS px FROM events) GROUP BY ALL"""
Q["stream_histogram"] = sql(
    LOG + [("sl", "SELECT *, TIME_BUCKET(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - h * INTERVAL '12 hours' AS start FROM log, (VALUES (0), (1)) v(h)")]
    + buckets("sl", ["label", "start"]), "SELECT * FROM hb")
# A drained stream has emitted the windows that ended before its last watermark.
CLOSED = "start + INTERVAL '1 day' <= (SELECT MAX(ts) FROM events) - INTERVAL '1 hour'"
Q["stream_bars_run"] = f"SELECT * FROM ({Q['stream_bars']}) WHERE {CLOSED}"
Q["stream_histogram_run"] = Q["stream_histogram"] + f" WHERE {CLOSED}"
Q["alert_stream_run"] = f"""
SELECT ticker || '-' || condition_type AS rule_id, ticker AS user_id, ticker, CAST(start AS DATE) AS dt, condition_type, threshold, close AS value
FROM ({Q['stream_bars_run']}), (VALUES ('PRICE_ABOVE', 110.0::DOUBLE), ('PRICE_BELOW', 101.0::DOUBLE)) r(condition_type, threshold)
WHERE (condition_type = 'PRICE_ABOVE' AND close > threshold) OR (condition_type = 'PRICE_BELOW' AND close < threshold)"""
