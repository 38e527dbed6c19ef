"""Comparison SQL for the queries over bars."""

from __future__ import annotations

from oracle.ctes import (
    FEATURES, VALUES, W, bars, cleaned, engineered, fill, guarded, indicators, kmeans_restarts, outliers, position,
    regime_bfill, regime_drop, risk, service_regimes, sql, winsor, zscores,
)
from tickloom.constants import (
    ALERT_LEVELS, BRIEF_HEADLINE, BRIEF_SUMMARY, BRIEF_TAKEAWAYS, REGIME_PROFILES, REGIME_SHORT_NAMES, SECTOR_REGIME_TAGS,
)

OHLCV = "ticker, dt, open, high, low, close, volume"
Q: dict[str, str] = {}


def rounds(cols, d):
    return ", ".join(f"ROUND({c}, {d}) AS {c}" for c in cols)


def quoted(text):
    return "'" + text.replace("'", "''") + "'"


def case_map(expr, table, pos=None):
    esc = lambda s: s.replace("'", "''")
    whens = " ".join(f"WHEN {k!r} THEN '{esc(v if pos is None else v[pos])}'" for k, v in table.items())
    return f"CASE {expr} {whens} END"


PROFILE = ", ".join(
    f"{case_map('regime', REGIME_PROFILES, i)} AS {n}" for i, n in enumerate(["regime_name", "regime_color", "regime_description"])
)
B = bars()
BP = B + position("bars", "bp")

Q["load_bars"] = sql(B, f"SELECT {OHLCV} FROM bars WHERE dt >= DATE '1990-01-01' AND dt < DATE '2030-01-01'")
Q["clean_sort_dedup"] = sql(
    BP + [("raw", f"SELECT {OHLCV}, 1 AS ingest_seq FROM bp UNION ALL SELECT ticker, dt, open, high, low, close + 1, volume, 2 FROM bp WHERE seq % 50 = 0")],
    f"SELECT {OHLCV} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, dt ORDER BY ingest_seq) AS rn FROM raw) WHERE rn = 1",
)
Q["clean_inf_to_null"] = sql(
    BP + [("raw", "SELECT ticker, dt, CASE WHEN seq % 23 = 5 THEN 'Infinity'::DOUBLE ELSE close END AS close FROM bp")],
    "SELECT ticker, dt, CASE WHEN ISINF(close) OR ISNAN(close) THEN NULL ELSE close END AS close FROM raw",
)
GAPPY = [("gappy", "SELECT * REPLACE (CASE WHEN seq % 17 = 0 THEN NULL ELSE close END AS close) FROM bp")]
Q["clean_fill_gaps"] = sql(BP + GAPPY + fill("gappy", "filled"), f"SELECT {OHLCV} FROM filled")
SPIKY = bars(spiky=True)
KEPT = SPIKY + outliers("bars", "fl") + [("kept", "SELECT * FROM fl WHERE NOT outlier")]
Q["clean_iqr_outliers"] = sql(KEPT, f"SELECT {OHLCV} FROM kept")
Q["clean_winsorize"] = sql(KEPT + winsor("kept", "wn"), f"SELECT ticker, dt, {rounds(VALUES, 9)} FROM wn")
Q["data_quality_report"] = sql(
    SPIKY + position("bars", "bp") + GAPPY + [
        ("raw", f"SELECT {OHLCV}, 1 AS ingest_seq FROM gappy UNION ALL SELECT ticker, dt, open, high, low, close + 1, volume, 2 FROM bp WHERE seq % 50 = 0"),
        ("uniq", f"SELECT {OHLCV} FROM raw QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, dt ORDER BY ingest_seq) = 1"),
    ] + fill("uniq", "filled") + outliers("filled", "fl"),
    """SELECT r.ticker, raw_rows, clean_rows, outliers_removed, gaps_filled,
  ROUND((raw_rows - clean_rows) / raw_rows * 100, 1) AS rows_dropped_pct
FROM (SELECT ticker, COUNT(*) AS raw_rows FROM raw GROUP BY ticker) r
JOIN (SELECT ticker, COUNT(*) FILTER (NOT outlier) AS clean_rows, COUNT(*) FILTER (outlier) AS outliers_removed FROM fl GROUP BY ticker) f USING (ticker)
JOIN (SELECT ticker, COUNT(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL) AS gaps_filled FROM uniq GROUP BY ticker) g USING (ticker)""",
)
FEAT = B + cleaned() + engineered("clean")
Q["min_rows_gate"] = sql(FEAT, """SELECT ticker, COUNT(*) AS available, 1410::BIGINT AS required,
  CASE WHEN COUNT(*) >= 1410 THEN 'ok' ELSE 'insufficient' END AS status FROM feat GROUP BY ticker""")
Q["min_rows_split"] = sql(FEAT, "SELECT ticker, COUNT(*) AS rows, GREATEST(1410 - COUNT(*), 0)::BIGINT AS missing FROM feat GROUP BY ticker")
Q["pct_return"] = sql(B, f"SELECT ticker, dt, ROUND(close / LAG(close) OVER ({W}) - 1, 8) AS ret1, ROUND(close / LAG(close, 10) OVER ({W}) - 1, 8) AS ret10 FROM bars")
Q["log_return"] = sql(B, f"SELECT ticker, dt, ROUND(LN(close) - LAG(LN(close)) OVER ({W}), 8) AS log_return FROM bars")
Q["day_of_week"] = sql(B, "SELECT ticker, dt, CAST(ISODOW(dt) - 1 AS BIGINT) AS day_of_week FROM bars")
Q["next_return_target"] = sql(FEAT, f"SELECT ticker, dt, ROUND(target, 8) AS target FROM (SELECT *, LEAD(log_return) OVER ({W}) AS target FROM feat) WHERE target IS NOT NULL")


def last_two(universe):
    return bars(universe) + [
        ("lagged", f"SELECT ticker, dt, close, LAG(close) OVER ({W}) AS prev FROM bars"),
        ("last2", "SELECT ticker, ARG_MAX(close, dt) AS close, LAST(prev ORDER BY dt) AS prev FROM lagged GROUP BY ticker"),
        ("chg", "SELECT *, COALESCE(ROUND((close - prev) / NULLIF(prev, 0) * 100, 2), 0) AS change_pct FROM last2"),
    ]


Q["price_direction_quotes"] = sql(last_two("brand"), "SELECT ticker, ROUND(close, 2) AS price, change_pct, CASE WHEN change_pct >= 0 THEN 'up' ELSE 'down' END AS direction FROM chg")
Q["sector_heatmap"] = sql(
    last_two("type") + [("mood", "SELECT *, CASE WHEN change_pct > 0.3 THEN 'Bullish' WHEN change_pct < -0.3 THEN 'Bearish' ELSE 'Neutral' END AS sentiment FROM chg")],
    f"SELECT ticker AS sector, change_pct, sentiment, {case_map('sentiment', SECTOR_REGIME_TAGS)} AS regime FROM mood",
)
REG = service_regimes()
RISK = REG + risk()
ALERT = "CASE WHEN regime IN (0, 3) AND risk_score < 4.5 THEN 'GREEN' WHEN regime IN (4, 5) OR risk_score >= 7.0 THEN 'RED' ELSE 'YELLOW' END"
Q["condition_alert"] = sql(RISK, f"""SELECT ticker, dt, CAST(regime AS INTEGER) AS regime, alert, {case_map('alert', ALERT_LEVELS, 0)} AS alert_label
FROM (SELECT *, {ALERT} AS alert FROM risk)""")
METRICS = REG + [
    ("mm", f"SELECT *, (close / LAG(close, 21) OVER ({W}) - 1) * 100 AS return_1m, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) AS back FROM lab"),
    ("metrics", f"""SELECT ticker, close AS last_price, return_1m, vol20 * SQRT(252.0) * 100 AS vol, rsi14 AS rsi, {PROFILE},
  CASE WHEN return_1m > 0.5 THEN 'UP' WHEN return_1m < -0.5 THEN 'DOWN' ELSE 'FLAT' END AS signal_dir,
  LEAST(0.95, 0.5 + ABS(return_1m) / 100) AS confidence FROM mm WHERE back = 1"""),
]
Q["attribution_weights"] = sql(METRICS, """
SELECT ticker, 'RSI (14-Day)' AS feature, ROUND((rsi - 50) / 100, 4) AS weight, CASE WHEN rsi > 50 THEN 'Positive' ELSE 'Negative' END AS impact FROM metrics
UNION ALL SELECT ticker, '20-Day Volatility', ROUND(-0.02 * (vol - 15), 4), CASE WHEN vol > 20 THEN 'Negative' ELSE 'Positive' END FROM metrics
UNION ALL SELECT ticker, 'EMA 20/50 Slope', ROUND(return_1m / 50, 4), CASE WHEN return_1m > 0 THEN 'Positive' ELSE 'Negative' END FROM metrics
UNION ALL SELECT ticker, 'Regime Vector Distance', ROUND(confidence * 0.25, 4), 'Positive' FROM metrics
UNION ALL SELECT ticker, 'MACD Histogram', ROUND((rsi - 50) * return_1m / 10000, 4), CASE WHEN rsi > 50 AND return_1m > 0 THEN 'Positive' ELSE 'Negative' END FROM metrics""")
Q["narrative_columns"] = sql(
    METRICS + [("mb", "SELECT *, CASE signal_dir WHEN 'UP' THEN 'Bullish' WHEN 'DOWN' THEN 'Bearish' ELSE 'Neutral' END AS sentiment_bias FROM metrics")],
    f"""SELECT ticker, sentiment_bias, ROUND(confidence, 4) AS confidence_score,
  printf({quoted(BRIEF_HEADLINE)}, ticker, sentiment_bias, regime_name, confidence * 100) AS headline,
  printf({quoted(BRIEF_SUMMARY)}, ticker, last_price, return_1m, vol, regime_name, rsi, signal_dir) AS executive_summary,
  [printf({quoted(BRIEF_TAKEAWAYS[0])}, regime_name, GREATEST(45, LEAST(85, CAST(FLOOR(confidence * 100 + 5) AS INTEGER)))),
   printf({quoted(BRIEF_TAKEAWAYS[1])}, rsi, CASE WHEN rsi > 70 THEN 'overbought momentum' WHEN rsi < 30 THEN 'oversold recovery' ELSE 'neutral equilibrium' END),
   printf({quoted(BRIEF_TAKEAWAYS[2])}, vol, CASE WHEN vol > 25 THEN 'elevated tail risk' ELSE 'controlled variance' END),
   printf({quoted(BRIEF_TAKEAWAYS[3])}, signal_dir, last_price * 0.95)] AS key_takeaways
FROM mb""")
Q["regime_profile_join"] = sql(REG, f"SELECT ticker, dt, CAST(regime AS INTEGER) AS regime, {PROFILE} FROM lab")
Q["downsample_every_k"] = sql(BP, """
SELECT ticker, dt, close, 'points_200' AS variant FROM bp WHERE seq % GREATEST(1, n // 200) = 0
UNION ALL SELECT ticker, dt, close, 'timeline_500' FROM bp WHERE seq % GREATEST(1, n // 500) = 0 OR seq = n - 1""")
IND6 = ["rsi14", "ema20", "macd", "macd_hist", "log_return"]
Q["latest_indicators"] = sql(FEAT, f"SELECT ticker, dt, {rounds(IND6, 4)}, ROUND(close, 6) AS close FROM feat WHERE seq = n - 1")
IND = B + indicators()
Q["rsi14"] = sql(IND, "SELECT ticker, dt, ROUND(rsi14, 4) AS rsi14 FROM ind")
Q["ema20"] = sql(IND, "SELECT ticker, dt, ROUND(ema20, 4) AS ema20 FROM ind")
Q["macd"] = sql(IND, f"SELECT ticker, dt, {rounds(['macd', 'macd_signal', 'macd_hist'], 4)} FROM ind")
Q["engineer_features"] = sql(
    B + engineered("bars"),
    f"SELECT {OHLCV}, seq, {rounds(['rsi14', 'ema20', 'macd', 'macd_signal', 'macd_hist'], 4)}, {rounds(['ret', 'log_return'], 8)}, CAST(day_of_week AS BIGINT) AS day_of_week FROM feat",
)
LR = B + [("lr", f"SELECT *, LN(close) - LAG(LN(close)) OVER ({W}) AS log_return, COALESCE(close / LAG(close) OVER ({W}) - 1, 0) AS ret FROM bars")]
Q["rolling_vol"] = sql(LR, f"""SELECT ticker, dt, ROUND({guarded('STDDEV_SAMP', 20, 'log_return')}, 8) AS vol20,
  ROUND({guarded('STDDEV_SAMP', 90, 'log_return')}, 8) AS vol90, ROUND({guarded('STDDEV_SAMP', 30, 'log_return')} * SQRT(252.0) * 100, 4) AS vol30_annual_pct FROM lr""")
RF = FEAT + regime_bfill()
FEATS4 = f"{rounds([c for c in FEATURES if c != 'vol20'], 4)}, ROUND(vol20, 8) AS vol20"
Q["regime_features"] = sql(RF, f"SELECT ticker, dt, {FEATS4} FROM rf")
Q["regime_features_drop"] = sql(IND + regime_drop(), f"SELECT ticker, dt, {FEATS4} FROM rf")
Q["rolling_sharpe60"] = sql(
    LR + [("ex", "SELECT *, log_return - 0.05 / 252 AS exc FROM lr")],
    f"SELECT ticker, dt, ROUND({guarded('AVG', 60, 'exc')} / ({guarded('STDDEV_POP', 60, 'exc')} + 1e-12) * SQRT(252.0), 6) AS sharpe60 FROM ex",
)
EQ = LR + [("eq", f"SELECT *, 10000 * PRODUCT(1 + ret) OVER ({W} ROWS UNBOUNDED PRECEDING) AS equity FROM lr")]
Q["equity_curve"] = sql(EQ, "SELECT ticker, dt, ROUND(equity, 4) AS equity FROM eq")
Q["drawdown_series"] = sql(
    EQ + [("pk", f"SELECT *, MAX(equity) OVER ({W} ROWS UNBOUNDED PRECEDING) AS peak FROM eq")],
    "SELECT ticker, dt, ROUND((equity - peak) / (peak + 1e-12) * 100, 6) AS drawdown_pct FROM pk",
)
T = bars("type")
COMMON = lambda src: [("common", f"SELECT dt FROM {src} GROUP BY dt HAVING COUNT(DISTINCT ticker) = (SELECT COUNT(DISTINCT ticker) FROM {src})")]
Q["common_dates"] = sql(T + COMMON("bars"), "SELECT dt FROM common")
Q["common_dates_two"] = sql(T, "SELECT dt FROM bars WHERE ticker = 'ECONOMY' INTERSECT SELECT dt FROM bars WHERE ticker <> 'ECONOMY'")
Q["align_panel"] = sql(T + COMMON("bars"), "SELECT ticker, dt, close FROM bars WHERE dt IN (SELECT dt FROM common)")
Q["benchmark_align"] = sql(B + bars("type", "tb"), "SELECT b.ticker, b.dt, b.close, t.close AS bench_close FROM bars b JOIN tb t ON t.dt = b.dt AND t.ticker = 'ECONOMY'")
Q["label_align"] = sql(
    B + bars("type", "tb") + [("lb", """SELECT ticker, dt, close, CASE WHEN dt IN (SELECT dt FROM tb WHERE ticker = 'ECONOMY') THEN (ISODOW(dt) - 1) % 6 END AS label FROM bars""")],
    f"SELECT ticker, dt, close, CAST(COALESCE(LAST_VALUE(label IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING), 5) AS INTEGER) AS label FROM lb",
)
Q["fetch_errors"] = sql(B, """
SELECT ticker, 'No data returned for ' || ticker AS error FROM (
  SELECT DISTINCT UPPER(TRIM(t)) AS ticker FROM (SELECT ' ' || LOWER(p_brand) AS t FROM part UNION ALL SELECT p_type FROM part))
WHERE ticker NOT IN (SELECT UPPER(ticker) FROM bars)
UNION ALL SELECT UPPER(ticker), 'Need 30 rows, got ' || COUNT(*) FROM bars GROUP BY UPPER(ticker) HAVING COUNT(*) < 30""")
PANEL = T + cleaned() + engineered("clean") + COMMON("feat") + [("panel", "SELECT * EXCLUDE (seq, n) FROM feat WHERE dt IN (SELECT dt FROM common)")]
Q["normalised_prices"] = sql(PANEL, f"SELECT ticker, dt, ROUND(close / FIRST_VALUE(close) OVER ({W}) * 100.0, 2) AS value FROM panel")
Q["daily_returns_pct"] = sql(PANEL, f"SELECT ticker, dt, ROUND(COALESCE(close / LAG(close) OVER ({W}) - 1, 0) * 100.0, 4) AS return_pct FROM panel")
Q["return_correlation"] = sql(PANEL, """SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, ROUND(CORR(a.log_return, b.log_return), 4) AS correlation
FROM panel a JOIN panel b USING (dt) GROUP BY a.ticker, b.ticker""")
Q["ticker_summary"] = sql(
    PANEL + [("ps", f"SELECT *, PRODUCT(1 + log_return) OVER ({W} ROWS UNBOUNDED PRECEDING) AS eq FROM panel"),
             ("pd", f"SELECT *, eq / MAX(eq) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM ps")],
    """SELECT ticker, ROUND((ARG_MAX(close, dt) / ARG_MIN(close, dt) - 1) * 100, 2) AS total_return_pct,
  ROUND(AVG(log_return) * 25200, 2) AS annualised_return_pct, ROUND(STDDEV_SAMP(log_return) * SQRT(252.0) * 100, 2) AS annualised_volatility_pct,
  ROUND(AVG(log_return - 0.05 / 252) / (STDDEV_SAMP(log_return - 0.05 / 252) + 1e-9) * SQRT(252.0), 4) AS sharpe_ratio,
  ROUND(MIN(dd) * 100, 2) AS max_drawdown_pct, ROUND(ARG_MAX(rsi14, dt), 1) AS latest_rsi,
  ROUND(ARG_MAX(close, dt), 2) AS latest_close, ROUND(ARG_MIN(close, dt), 2) AS start_close FROM pd GROUP BY ticker""")
Q["compare_date_range"] = sql(PANEL, 'SELECT MIN(dt) AS start, MAX(dt) AS "end", COUNT(DISTINCT dt) AS trading_days FROM panel')
ZS = [f"z{i}" for i in range(5)]
Q["standard_scale"] = sql(RF + zscores(), f"SELECT ticker, dt, {rounds(ZS, 6)} FROM z")
Q["regime_kmeans"] = sql(REG, "SELECT ticker, dt, CAST(cluster AS INTEGER) AS cluster FROM lab")
Q["regime_kmeans_restarts"] = sql(
    bars("type") + cleaned() + engineered("clean") + regime_bfill() + zscores() + kmeans_restarts(10),
    "SELECT ticker, dt, CAST(start AS INTEGER) AS start, CAST(cluster AS INTEGER) AS cluster, CAST(regime AS INTEGER) AS regime FROM lab")
Q["regime_semantic_order"] = sql(REG, "SELECT ticker, dt, CAST(cluster AS INTEGER) AS cluster, CAST(regime AS INTEGER) AS regime FROM lab")
Q["risk_score"] = sql(RISK, "SELECT ticker, dt, CAST(regime AS INTEGER) AS regime, ROUND(risk_score, 6) AS risk_score FROM risk")
Q["regime_forward_stats"] = sql(
    REG + [("fw", f"SELECT ticker, dt, CAST(regime AS INTEGER) AS regime, ROW_NUMBER() OVER ({W}) - 1 AS seq, COUNT(*) OVER (PARTITION BY ticker) AS n, "
            + ", ".join(f"(LEAD(close, {h}) OVER ({W}) / close - 1) * 100 AS f{h}" for h in (5, 10, 20)) + " FROM lab"),
           ("fl", " UNION ALL ".join(f"SELECT ticker, dt, regime, {h} AS horizon, f{h} AS fwd FROM fw WHERE seq < n - 20 AND f{h} IS NOT NULL" for h in (5, 10, 20))),
           ("fb", "SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, regime, horizon ORDER BY dt DESC) AS back FROM fl"),
           ("fs", """SELECT ticker, regime, horizon, COUNT(*) AS "count", ROUND(MEDIAN(fwd), 4) AS median, ROUND(AVG(fwd), 4) AS mean,
  ROUND(AVG(CASE WHEN fwd > 0 THEN 1.0 ELSE 0.0 END) * 100, 4) AS pct_positive,
  LIST(ROUND(fwd, 2) + 0.0 ORDER BY dt) FILTER (back <= 10) AS samples FROM fb GROUP BY ALL"""),
           ("cells", "SELECT ticker, CAST(r AS INTEGER) AS regime, CAST(h AS INTEGER) AS horizon FROM (SELECT DISTINCT ticker FROM fw), UNNEST([0, 1, 2, 3, 4, 5]) a(r), UNNEST([5, 10, 20]) b(h)")],
    f"""SELECT ticker, regime, {case_map('regime', REGIME_PROFILES, 0)} AS regime_name, horizon, MAX(COALESCE("count", 0)) OVER (PARTITION BY ticker, regime) AS total_days, COALESCE("count", 0) AS "count", median, mean, pct_positive, COALESCE(samples, []::DOUBLE[]) AS samples
FROM cells LEFT JOIN fs USING (ticker, regime, horizon)""")
Q["similar_scenarios"] = sql(
    REG + [("sp", f"SELECT *, ROW_NUMBER() OVER ({W}) - 1 AS pos, COUNT(*) OVER (PARTITION BY ticker) AS cnt FROM lab"),
           ("tgt", "SELECT ticker, z0 AS t0, z1 AS t1, z2 AS t2, z3 AS t3, z4 AS t4 FROM sp WHERE pos = cnt - 1"),
           ("sim", "SELECT s.*, (" + " + ".join(f"z{i} * t{i}" for i in range(5)) + ") / (SQRT(" + " + ".join(f"z{i} * z{i}" for i in range(5))
            + ") * SQRT(" + " + ".join(f"t{i} * t{i}" for i in range(5)) + ")) AS sim FROM sp s JOIN tgt USING (ticker) WHERE cnt >= 30 AND pos < cnt - 15"),
           ("best", f"SELECT *, {PROFILE} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY ROUND(sim, 9) DESC, dt) AS match FROM sim) WHERE match <= 5"),
           ("paths", "SELECT b.ticker, b.match, LIST(ROUND(p.close / b.close * 100, 2) ORDER BY p.pos) AS price_path, ARG_MAX(p.close, p.pos) AS final FROM best b JOIN sp p ON p.ticker = b.ticker AND p.pos BETWEEN b.pos AND b.pos + 10 GROUP BY b.ticker, b.match")],
    """SELECT ticker, CAST(match AS INTEGER) AS match, dt, regime_name, regime_color, ROUND(sim * 100, 1) AS similarity_pct,
  ROUND((final / close - 1) * 100, 2) AS fwd_10d_ret, price_path FROM best JOIN paths USING (ticker, match)""")
Q["regime_timeline"] = sql(
    RISK + [("rp", f"SELECT *, {PROFILE}, ROW_NUMBER() OVER ({W}) - 1 AS pos, COUNT(*) OVER (PARTITION BY ticker) AS cnt FROM risk")],
    """SELECT ticker, dt, CAST(regime AS INTEGER) AS regime_id, regime_name, regime_color, ROUND(risk_score, 6) AS risk_score, ROUND(close, 6) AS close
FROM rp WHERE pos % GREATEST(1, cnt // 500) = 0 OR pos = cnt - 1""")
Q["transition_matrix"] = sql(
    REG + [("st", f"SELECT ticker, regime AS cur, LEAD(regime) OVER ({W}) AS nxt FROM lab"),
           ("grid", "SELECT ticker, CAST(a AS INTEGER) AS from_regime, CAST(b AS INTEGER) AS to_regime FROM (SELECT DISTINCT ticker FROM st), UNNEST([0,1,2,3,4,5]) x(a), UNNEST([0,1,2,3,4,5]) y(b)"),
           ("cnt", "SELECT ticker, cur, nxt, COUNT(*) AS c FROM st WHERE nxt IS NOT NULL GROUP BY ALL"),
           ("cell", "SELECT g.*, COALESCE(c, 0) AS transitions, SUM(COALESCE(c, 0)) OVER (PARTITION BY g.ticker, from_regime) AS leaving FROM grid g LEFT JOIN cnt ON cnt.ticker = g.ticker AND cur = from_regime AND nxt = to_regime")],
    "SELECT ticker, from_regime, to_regime, transitions, ROUND(CASE WHEN leaving > 0 THEN transitions / (leaving + 1e-12) ELSE 0 END, 3) AS probability FROM cell")
DIST = " + ".join(f"POW(p.z{i} - c.m{i}, 2)" for i in range(5))
CONF = [
    ("dd", f"SELECT p.ticker, p.dt, MIN(SQRT({DIST})) AS near, MAX(SQRT({DIST})) AS far FROM lab p JOIN lab_m c USING (ticker) GROUP BY p.ticker, p.dt"),
    ("conf", "SELECT l.*, 1 - near / (MAX(far) OVER (PARTITION BY l.ticker) + 1e-12) AS confidence FROM lab l JOIN dd USING (ticker, dt)"),
]
Q["regime_confidence"] = sql(
    REG + CONF + [("cur", "SELECT ticker, ROUND(ARG_MAX(confidence, dt), 3) AS current FROM conf GROUP BY ticker"),
                  ("means", "SELECT ticker, regime, ROUND(AVG(confidence), 3) AS c FROM conf GROUP BY ALL")],
    "SELECT cur.ticker, current, name AS regime_name, COALESCE(c, 0) AS confidence FROM cur, (VALUES "
    + ", ".join(f"({k}, '{n}')" for k, n in enumerate(REGIME_SHORT_NAMES))
    + ") v(k, name) LEFT JOIN means ON means.ticker = cur.ticker AND means.regime = v.k")
MIX = " + ".join(f"POW(CASE WHEN p.f = {i} THEN p.donor ELSE p.z{i} END - c.m{i}, 2)" for i in range(5))
Q["feature_importance"] = sql(
    REG + [("ps", f"SELECT *, ROW_NUMBER() OVER ({W}) - 1 AS pos FROM lab"),
           ("pr", "SELECT *, ROW_NUMBER() OVER (PARTITION BY ticker, f ORDER BY ('0x' || SUBSTR(MD5(f || ':' || pos), 1, 8))::BIGINT, pos) - 1 AS r FROM ps, UNNEST([0,1,2,3,4]) u(f)"),
           ("px", "SELECT a.*, CASE a.f " + " ".join(f"WHEN {i} THEN b.z{i}" for i in range(5)) + " END AS donor FROM pr a JOIN pr b ON a.ticker = b.ticker AND a.f = b.f AND b.r = a.pos"),
           ("pm", f"SELECT p.ticker, p.f, p.dt, MIN({DIST}) AS own, MIN({MIX}) AS new FROM px p JOIN lab_m c ON p.ticker = c.ticker GROUP BY p.ticker, p.f, p.dt"),
           ("pg", "SELECT ticker, f, ROUND((SUM(new) - SUM(own)) / (SUM(own) + 1e-12), 4) AS importance FROM pm GROUP BY ticker, f"),
           ("pn", "SELECT ticker, CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FEATURES)) + " END AS feature, importance FROM pg")],
    'SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY importance DESC, feature) AS INTEGER) AS "rank" FROM pn')
Q["regime_scoreboard"] = sql(
    RISK + [("last", "SELECT * FROM risk QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker ORDER BY dt DESC) = 1"),
            ("al", f"SELECT *, {PROFILE}, {ALERT} AS alert FROM last")],
    f"""SELECT ticker, dt, CAST(regime AS INTEGER) AS regime, {rounds(['risk_score', 'rsi14', 'ema20', 'macd', 'macd_hist', 'log_return'], 4)}, ROUND(close, 6) AS close,
  regime_name, regime_color, regime_description, alert, {", ".join(f"{case_map('alert', ALERT_LEVELS, i)} AS {n}" for i, n in enumerate(["alert_label", "alert_color", "alert_description"]))} FROM al""")
#: What was written is what is read.
Q["write_result"] = Q["regime_scoreboard"]
