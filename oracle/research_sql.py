"""Comparison SQL for back-tests, research metrics, forecasts and portfolios."""

from __future__ import annotations

import math
from statistics import NormalDist

from oracle.ctes import W, bars, cleaned, engineered, guarded, position, report_regimes, risk, service_regimes, sql
from oracle.market_sql import COMMON, CONF, rounds
from tickloom.constants import FEATURE_COLS

Q: dict[str, str] = {}
REG, REP = service_regimes(), report_regimes()
WEIGHT = "CASE WHEN regime IN (0, 3) THEN 1.0::DOUBLE WHEN regime IN (1, 2) THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
RUN = f"{W} ROWS UNBOUNDED PRECEDING"
SQ = "SQRT(252.0)"


def strategy(source, name, ret):
    return [
        (name + "_w", f"SELECT *, {ret} AS r, {WEIGHT} AS weight FROM {source}"),
        (name + "_l", f"SELECT *, LAG(weight) OVER ({W}) AS pw FROM {name}_w"),
        (name + "_c", f"SELECT *, COALESCE(ABS(weight - pw), 0) AS wc, COALESCE(ABS(weight - pw), 0) * 0.001 AS cost FROM {name}_l"),
        (name, f"SELECT *, COALESCE(pw, 0) * r - cost AS strat_ret FROM {name}_c"),
    ]


SIMPLE = f"COALESCE(close / LAG(close) OVER ({W}) - 1, 0)"
Q["regime_weights"] = sql(REG, f"SELECT ticker, dt, CAST(regime AS INTEGER) AS regime, {WEIGHT} AS weight FROM lab")
RETURNS = "SELECT ticker, dt, weight, ROUND(cost, 8) AS cost, ROUND(strat_ret, 8) AS strat_ret FROM st"
Q["strategy_returns"] = sql(REG + strategy("lab", "st", SIMPLE), RETURNS)
Q["strategy_returns_log"] = sql(REP + strategy("lab", "st", "log_return"), RETURNS)
Q["regime_backtest_metrics"] = sql(
    REG + strategy("lab", "st", SIMPLE) + [
        ("eq", f"SELECT *, 10000 * PRODUCT(1 + r) OVER ({RUN}) AS bh, 10000 * PRODUCT(1 + strat_ret) OVER ({RUN}) AS se FROM st"),
        ("dd", f"SELECT *, bh / MAX(bh) OVER ({RUN}) - 1 AS bdd, se / MAX(se) OVER ({RUN}) - 1 AS sdd FROM eq")],
    f"""SELECT ticker, ROUND((ARG_MAX(bh, dt) / 10000 - 1) * 100, 2) AS benchmark_total_return, ROUND((ARG_MAX(se, dt) / 10000 - 1) * 100, 2) AS strategy_total_return,
  ROUND(MIN(bdd) * 100, 2) AS benchmark_max_drawdown, ROUND(MIN(sdd) * 100, 2) AS strategy_max_drawdown,
  ROUND(CASE WHEN STDDEV_SAMP(r) > 0 THEN AVG(r - 0.05 / 252) / STDDEV_SAMP(r - 0.05 / 252) * {SQ} ELSE 0 END, 2) AS benchmark_sharpe,
  ROUND(CASE WHEN STDDEV_SAMP(strat_ret) > 0 THEN AVG(strat_ret - 0.05 / 252) / STDDEV_SAMP(strat_ret - 0.05 / 252) * {SQ} ELSE 0 END, 2) AS strategy_sharpe,
  ROUND(COALESCE(AVG(CASE WHEN strat_ret > 0 THEN 1.0 ELSE 0.0 END) FILTER (pw > 0) * 100, 0), 1) AS strategy_win_rate,
  ROUND(SUM(cost) * 100, 4) AS total_transaction_cost_pct, COUNT(*) FILTER (wc > 0) AS n_trades, 0.05::DOUBLE AS risk_free_rate_annual FROM dd GROUP BY ticker""",
)
Q["regime_backtest_curves"] = sql(
    REG + strategy("lab", "st", SIMPLE) + [
        ("eq", f"SELECT ticker, dt, 10000 * PRODUCT(1 + r) OVER ({RUN}) AS bh, 10000 * PRODUCT(1 + strat_ret) OVER ({RUN}) AS se, ROW_NUMBER() OVER ({W}) - 1 AS pos, COUNT(*) OVER (PARTITION BY ticker) AS cnt FROM st")],
    "SELECT ticker, dt, ROUND(bh, 2) AS benchmark_equity, ROUND(se, 2) AS strategy_equity FROM eq WHERE pos % GREATEST(1, cnt // 200) = 0")
B = bars()
PRED = B + [
    ("pv", f"SELECT ticker, dt, close AS actual, LAG(close) OVER ({W}) AS naive FROM bars"),
    ("pw", f"SELECT *, {guarded('AVG', 5, 'naive')} AS sma5, {guarded('AVG', 20, 'naive')} AS sma20 FROM pv"),
    ("wide", "SELECT * FROM pw WHERE sma20 IS NOT NULL"),
]
TRADE = PRED + [
    ("tp", "SELECT ticker, dt, actual, (naive + sma5 + sma20) / 3 AS pred FROM wide"),
    ("ts", f"""SELECT *, COALESCE(SIGN(pred - LAG(pred) OVER ({W})), 0) AS signal,
  COALESCE((actual - LAG(actual) OVER ({W})) / (LAG(actual) OVER ({W}) + 1e-9), 0) AS ret FROM tp"""),
    ("te", f"SELECT *, ret * signal AS sr, 10000 * PRODUCT(1 + ret * signal) OVER ({RUN}) AS equity, CASE WHEN signal > 0 THEN actual END AS buy, CASE WHEN signal < 0 THEN actual END AS sell FROM ts"),
]
Q["signal_backtest"] = sql(TRADE, "SELECT ticker, dt, CAST(signal AS INTEGER) AS signal, ROUND(equity, 3) AS equity, buy, sell FROM te")
Q["signal_backtest_metrics"] = sql(TRADE, f"""SELECT ticker, ROUND(AVG(sr - 0.05 / 252) / (STDDEV_POP(sr - 0.05 / 252) + 1e-9) * {SQ}, 4) AS sharpe,
  ROUND((ARG_MAX(equity, dt) / ARG_MIN(equity, dt) - 1) * 100, 4) AS total_return_pct, ROUND((ARG_MAX(actual, dt) / ARG_MIN(actual, dt) - 1) * 100, 4) AS buy_hold_return_pct,
  COUNT(buy) AS buys, COUNT(sell) AS sells FROM te GROUP BY ticker""")
METRICS = """ROUND(SQRT(AVG(POW(actual - pred, 2))), {d}) AS rmse, ROUND(AVG(ABS(actual - pred)), {d}) AS mae,
  ROUND(1 - SUM(POW(actual - pred, 2)) / (VAR_POP(actual) * COUNT(*) + 1e-9), {d}) AS r2,
  ROUND(AVG(CASE WHEN SIGN(d_actual) = SIGN(d_pred) THEN 1.0 WHEN SIGN(d_actual) <> SIGN(d_pred) THEN 0.0 END) * 100, {d}) AS directional_accuracy"""
Q["forecast_metrics"] = sql(
    PRED + [("lg", " UNION ALL ".join(f"SELECT ticker, dt, actual, '{m}' AS model, {e} AS pred FROM wide" for m, e in
                                      [("naive", "naive"), ("sma5", "sma5"), ("sma20", "sma20"), ("ensemble", "(naive + sma5 + sma20) / 3")])),
            ("ld", "SELECT *, actual - LAG(actual) OVER w AS d_actual, pred - LAG(pred) OVER w AS d_pred FROM lg WINDOW w AS (PARTITION BY ticker, model ORDER BY dt)")],
    f"SELECT ticker, model, {METRICS.format(d=6)}, ROUND(AVG(ABS((actual - pred) / (actual + 1e-9))) * 100, 6) AS mape FROM ld GROUP BY ticker, model",
)
FRAME = REP + strategy("lab", "st", "log_return") + [
    ("eq", f"SELECT * EXCLUDE (seq, n), 10000 * PRODUCT(1 + r) OVER ({RUN}) AS bh, 10000 * PRODUCT(1 + strat_ret) OVER ({RUN}) AS se FROM st"),
    ("fr", f"""SELECT *, (bh - MAX(bh) OVER ({RUN})) / (MAX(bh) OVER ({RUN}) + 1e-12) AS bdd, (se - MAX(se) OVER ({RUN})) / (MAX(se) OVER ({RUN}) + 1e-12) AS sdd,
  ROW_NUMBER() OVER ({W}) - 1 AS seq, COUNT(*) OVER (PARTITION BY ticker) AS n, LEAD(r) OVER ({W}) AS fwd FROM eq"""),
]
PERF = [
    ("p0", f"""SELECT ticker, COUNT(*) AS n_trading_days, AVG(strat_ret - 0.05 / 252) / (STDDEV_POP(strat_ret - 0.05 / 252) + 1e-12) * {SQ} AS sharpe_ratio,
  AVG(strat_ret - 0.05 / 252) / (CASE WHEN COUNT(*) FILTER (strat_ret < 0) > 1 THEN STDDEV_POP(strat_ret) FILTER (strat_ret < 0) ELSE 1e-9 END + 1e-12) * {SQ} AS sortino_ratio,
  MIN(sdd) * 100 AS max_drawdown, (POW(ARG_MAX(se, dt) / ARG_MIN(se, dt), 252.0 / COUNT(*)) - 1) * 100 AS cagr,
  AVG(r - 0.05 / 252) / (STDDEV_POP(r - 0.05 / 252) + 1e-12) * {SQ} AS sharpe_bh, MIN(bdd) * 100 AS mdd_bh,
  (POW(ARG_MAX(bh, dt) / ARG_MIN(bh, dt), 252.0 / COUNT(*)) - 1) * 100 AS cagr_bh,
  COVAR_POP(strat_ret, bench_ret) / VAR_POP(bench_ret) AS beta,
  (AVG(strat_ret) - 0.05 / 252 - COVAR_POP(strat_ret, bench_ret) / VAR_POP(bench_ret) * (AVG(bench_ret) - 0.05 / 252)) * 25200 AS alpha
FROM fr GROUP BY ticker"""),
    ("perf", "SELECT *, CASE WHEN max_drawdown <> 0 THEN cagr / ABS(max_drawdown) ELSE 0 END AS calmar_ratio FROM p0"),
]
SCORES = ["sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown", "cagr", "sharpe_bh", "mdd_bh", "cagr_bh"]
Q["perf_ratios"] = sql(FRAME + PERF, f"SELECT ticker, n_trading_days, {rounds(SCORES, 4)} FROM perf")
Q["alpha_beta"] = sql(FRAME + PERF, "SELECT ticker, ROUND(beta, 6) AS beta, ROUND(alpha, 4) AS alpha FROM perf")


def spearman(source, name, keys):
    k = ", ".join(keys)
    return [
        (name + "_r", f"""SELECT {k}, RANK() OVER (PARTITION BY {k} ORDER BY weight) + (COUNT(*) OVER (PARTITION BY {k}, weight) - 1) / 2.0 AS rw,
  RANK() OVER (PARTITION BY {k} ORDER BY fwd) + (COUNT(*) OVER (PARTITION BY {k}, fwd) - 1) / 2.0 AS rf FROM {source}"""),
        (name + "_m", f"SELECT {k}, COUNT(*) AS c, COVAR_POP(rw, rf) AS cv, SQRT(VAR_POP(rw) * VAR_POP(rf)) AS sd FROM {name}_r GROUP BY {k}"),
        (name, f"SELECT {k}, CASE WHEN sd > 0 AND c > 10 THEN cv / sd ELSE 0 END AS ic FROM {name}_m"),
    ]


IC = [("anchors", "SELECT ticker, dt AS adt, seq AS aseq FROM fr WHERE seq >= 60 AND seq <= n - 2"),
      ("pairs", "SELECT a.ticker, a.adt AS dt, f.weight, f.fwd FROM anchors a JOIN fr f ON f.ticker = a.ticker AND f.seq >= a.aseq - 60 AND f.seq < a.aseq")
      ] + spearman("pairs", "ics", ["ticker", "dt"])
Q["rolling_ic"] = sql(FRAME + IC, "SELECT ticker, dt, ROUND(ic, 8) AS ic FROM ics")
ICS = [("icsum", """SELECT ticker, COUNT(*) AS n, AVG(ic) AS ic_mean, STDDEV_POP(ic) AS ic_std, AVG(ic) / (STDDEV_POP(ic) + 1e-12) AS ic_ir,
  CASE WHEN COUNT(*) > 2 THEN AVG(ic) / (STDDEV_SAMP(ic) / SQRT(COUNT(*))) ELSE 0 END AS t_stat FROM ics GROUP BY ticker""")]
Q["ic_ttest"] = sql(FRAME + IC + ICS, "SELECT ticker, n, ROUND(ic_mean, 6) AS ic_mean, ROUND(ic_std, 6) AS ic_std, ROUND(ic_ir, 4) AS ic_ir, ROUND(t_stat, 4) AS t_stat FROM icsum")
# Student-t tail by Simpson's rule on 2,000 steps.
PV = [("tz", "SELECT ticker, t_stat, n - 1 AS v, ABS(t_stat) / 2000 AS h FROM icsum"),
      ("td", """SELECT ticker, t_stat, SUM((CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * EXP(LGAMMA((v + 1) / 2.0) - LGAMMA(v / 2.0)) / SQRT(v * PI()) * POW(1 + POW(i * h, 2) / v, -(v + 1) / 2.0)) * ANY_VALUE(h) / 3 AS area
FROM tz, range(0, 2001) g(i) GROUP BY ticker, t_stat"""),
      ("tp", "SELECT ticker, ROUND(t_stat, 4) AS t_stat, 1 - 2 * area AS p FROM td")]
Q["ic_significance"] = sql(FRAME + IC + ICS + PV, "SELECT ticker, t_stat, ROUND(p, 6) AS p_value, p < 0.05 AS significant FROM tp")
CV = [("cvp", "SELECT ticker, CAST(FLOOR((seq - (n - 5 * (n // 6))) / (n // 6)) AS BIGINT) AS fold, weight, COALESCE(fwd, 0) AS fwd FROM fr WHERE seq >= n - 5 * (n // 6)")
      ] + spearman("cvp", "cvic", ["ticker", "fold"]) + [
    ("cvs", "SELECT ticker, LIST(ROUND(ic, 4) ORDER BY fold) AS fold_ics, AVG(ic) AS cv_mean, STDDEV_POP(ic) AS cv_std FROM cvic GROUP BY ticker")]
Q["cv_ic"] = sql(FRAME + CV, "SELECT ticker, fold_ics, ROUND(cv_mean, 4) AS ic_mean, ROUND(cv_std, 4) AS ic_std FROM cvs")
WF = [("wfr", """SELECT f.ticker, f.dt, f.regime, f.r, f.seq // (n // 6) AS fold, g.i, g.b, g.w FROM fr f,
  (VALUES (0, 1.0::DOUBLE, 0.5::DOUBLE), (1, 0.8::DOUBLE, 0.4::DOUBLE), (2, 0.6::DOUBLE, 0.3::DOUBLE)) g(i, b, w)
  WHERE n // 6 >= 20 AND f.seq // (n // 6) BETWEEN 1 AND 5"""),
      ("wfw", "SELECT *, COALESCE(LAG(CASE WHEN regime IN (0, 3) THEN b WHEN regime IN (1, 2) THEN w ELSE 0 END) OVER (PARTITION BY ticker, fold, i ORDER BY dt), 0) * r AS sr FROM wfr"),
      ("wfs", f"SELECT ticker, fold, i, b, w, MIN(dt) AS test_start, MAX(dt) AS test_end, ROUND(AVG(sr - 0.05 / 252) / (STDDEV_POP(sr - 0.05 / 252) + 1e-12) * {SQ}, 9) AS s FROM wfw GROUP BY ALL"),
      ("wfb", "SELECT * FROM wfs QUALIFY ROW_NUMBER() OVER (PARTITION BY ticker, fold ORDER BY GREATEST(s, -999.0) DESC, i) = 1"),
      ("wff", "SELECT ticker, fold, test_start, test_end, ROUND(GREATEST(s, -999.0), 4) AS best_sharpe, b AS bull_thresh, w AS neutral_thresh FROM wfb"),
      ("wfm", "SELECT ticker, AVG(best_sharpe) AS wf_sharpe_mean, STDDEV_POP(best_sharpe) AS wf_sharpe_std FROM wff GROUP BY ticker")]
Q["walk_forward_thresholds"] = sql(FRAME + WF, "SELECT * FROM wff")
Q["walk_forward_summary"] = sql(FRAME + WF, "SELECT ticker, ROUND(wf_sharpe_mean, 4) AS wf_sharpe_mean, ROUND(wf_sharpe_std, 4) AS wf_sharpe_std FROM wfm")
Q["quant_report"] = sql(
    FRAME + PERF + IC + ICS + CV + WF + CONF + [("cc", "SELECT ticker, ROUND(ARG_MAX(confidence, dt), 3) AS confidence_current FROM conf GROUP BY ticker")],
    f"""SELECT ticker, n_trading_days, {rounds([*SCORES, 'alpha', 'beta', 'ic_mean', 'ic_std', 'ic_ir', 't_stat', 'wf_sharpe_mean', 'wf_sharpe_std'], 4)},
  ROUND(cv_mean, 4) AS cv_ic_mean, ROUND(cv_std, 4) AS cv_ic_std, confidence_current
FROM perf LEFT JOIN icsum USING (ticker) LEFT JOIN cvs USING (ticker) LEFT JOIN wfm USING (ticker) LEFT JOIN cc USING (ticker)""")

ROWS = B + cleaned() + engineered("clean") + [
    ("tg", f"SELECT * EXCLUDE (seq, n), LEAD(log_return) OVER ({W}) AS target FROM feat"),
    ("tt", "SELECT * FROM tg WHERE target IS NOT NULL")] + position("tt", "mr0") + [
    ("mr", """SELECT *, CAST(FLOOR(n * 0.7::DOUBLE) AS BIGINT) AS ntr,
  CASE WHEN seq < FLOOR(n * 0.7::DOUBLE) THEN 'train' WHEN seq < FLOOR(n * 0.7::DOUBLE) + FLOOR(n * 0.15::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM mr0""")]
Q["chrono_split"] = sql(ROWS, "SELECT ticker, dt, split FROM mr")
ALLC = [*FEATURE_COLS, "target"]
MM = [("mmb", "SELECT ticker, " + ", ".join(f"MIN({c}) AS {c}_lo, CASE WHEN MAX({c}) = MIN({c}) THEN 1 ELSE MAX({c}) - MIN({c}) END AS {c}_rg" for c in ALLC) + " FROM mr WHERE split = 'train' GROUP BY ticker")]
Q["minmax_train_only"] = sql(ROWS + MM, "SELECT ticker, dt, split, " + ", ".join(f"ROUND(({c} - {c}_lo) / {c}_rg, 8) AS {c}_scaled" for c in ALLC) + " FROM mr JOIN mmb USING (ticker)")
F90 = f"{W} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING"
Q["make_sequences"] = sql(
    ROWS + [("sq", f"""SELECT *, COUNT(*) OVER ({F90}) AS length, SUM(close) OVER ({F90}) AS sc, SUM(rsi14) OVER ({F90}) AS sr,
  LAG(close, 90) OVER ({W}) AS fc, LAG(macd) OVER ({W}) AS lm FROM mr""")],
    """SELECT ticker, dt, split, length, ROUND(sc, 9) AS sum_close, ROUND(sr, 4) AS sum_rsi, ROUND(fc, 6) AS first_close, ROUND(lm, 4) AS last_macd, ROUND(target, 8) AS target
FROM sq WHERE length = 90 AND seq >= CASE WHEN split = 'test' THEN ntr + 90 ELSE 90 END""")
Q["inverse_scale"] = sql(ROWS + MM, """SELECT ticker, dt, ROUND((target - target_lo) / target_rg * target_rg + target_lo, 8) AS target_restored,
  ROUND((close - close_lo) / close_rg * close_rg + close_lo, 9) AS close_restored, ROUND((close - close_lo) / close_rg, 8) AS close_single FROM mr JOIN mmb USING (ticker)""")
Q["price_from_logret"] = sql(ROWS, "SELECT ticker, dt, ROUND(close * EXP(target), 9) AS next_price FROM mr")
Q["ensemble_band"] = sql(PRED + [("eb", "SELECT ticker, dt, AVG(p) AS m, STDDEV_POP(p) AS s FROM (SELECT ticker, dt, UNNEST([naive, sma5, sma20]) AS p FROM wide) GROUP BY ticker, dt")],
                         "SELECT ticker, dt, ROUND(m, 4) AS ensemble, ROUND(m - 1.96 * s, 4) AS lower, ROUND(m + 1.96 * s, 4) AS upper FROM eb")
AR = ROWS + [("ar", "SELECT ticker, REGR_SLOPE(target, log_return) AS b, REGR_INTERCEPT(target, log_return) AS a, COUNT(*) AS c FROM mr WHERE split = 'train' GROUP BY ticker")]
Q["ar1_forecaster"] = sql(AR, "SELECT ticker, ROUND(b, 8) AS slope, ROUND(a, 8) AS intercept, c AS train_rows FROM ar")
Q["roll_forecast"] = sql(
    AR + [("rf0", "SELECT ticker, dt, close, log_return FROM feat WHERE seq = n - 1"),
          ("rl RECURSIVE", """SELECT ticker, 0 AS step, dt AS last, log_return AS r, close AS p FROM rf0
UNION ALL SELECT l.ticker, l.step + 1, l.last, ar.a + ar.b * l.r, l.p * EXP(ar.a + ar.b * l.r) FROM rl l JOIN ar USING (ticker) WHERE l.step < 5""")],
    "SELECT ticker, CAST(step AS INTEGER) AS step, CAST(last + CAST(step AS INTEGER) AS DATE) AS dt, ROUND(p, 4) AS price FROM rl WHERE step > 0")
WE = ROWS + [
    ("wa", "SELECT m.ticker, f, REGR_SLOPE(target, log_return) AS b, REGR_INTERCEPT(target, log_return) AS a FROM mr m, range(1, 6) g(f) WHERE m.seq < (n // 6) * f AND n // 6 >= 100 GROUP BY m.ticker, f"),
    ("wt", "SELECT m.ticker, f AS fold, close * EXP(target) AS actual, close * EXP(a + b * log_return) AS pred, target AS d_actual, a + b * log_return AS d_pred FROM mr m JOIN wa ON wa.ticker = m.ticker AND m.seq // (n // 6) = f"),
]
Q["walk_forward_eval"] = sql(WE, f"SELECT ticker, fold, {METRICS.format(d=4)} FROM wt GROUP BY ticker, fold")
Q["walk_forward_eval_summary"] = sql(
    WE + [("wg", f"SELECT ticker, fold, ROUND(rmse, 4) AS rmse, ROUND(directional_accuracy, 2) AS da FROM (SELECT ticker, fold, {METRICS.format(d=9)} FROM wt GROUP BY ticker, fold)")],
    """SELECT ticker, COUNT(*) AS n_folds, ROUND(AVG(da), 3) AS mean_directional_accuracy, ROUND(STDDEV_POP(da), 3) AS std_directional_accuracy,
  ROUND(AVG(rmse), 3) AS mean_rmse, ROUND(STDDEV_POP(rmse), 3) AS std_rmse FROM wg GROUP BY ticker""")
Q["batch_score"] = sql(AR, "SELECT ticker, dt, ROUND(a + b * log_return, 8) AS score FROM mr JOIN ar USING (ticker) WHERE split = 'test'")
RECORD = AR + [
    ("ts", "SELECT ticker, close AS naive, close * EXP(target) AS actual, close * EXP(a + b * log_return) AS fitted, target, a + b * log_return AS r FROM mr JOIN ar USING (ticker) WHERE split = 'test'"),
    ("er", """SELECT ticker, SQRT(AVG(POW(actual - fitted, 2))) AS fitted_rmse, AVG(ABS(actual - fitted)) AS fitted_mae,
  SQRT(AVG(POW(actual - naive, 2))) AS naive_rmse, AVG(ABS(actual - naive)) AS naive_mae,
  AVG(CASE WHEN SIGN(target) = SIGN(r) THEN 1.0 ELSE 0.0 END) * 100 AS directional_accuracy, STDDEV_POP(target - r) AS residual_sd FROM ts GROUP BY ticker"""),
    ("la", "SELECT ticker, close AS p0, log_return AS r0 FROM feat WHERE seq = n - 1"),
    ("ho RECURSIVE", """SELECT ticker, 0 AS step, r0 AS r, p0 AS p FROM la
UNION ALL SELECT h.ticker, h.step + 1, ar.a + ar.b * h.r, h.p * EXP(ar.a + ar.b * h.r) FROM ho h JOIN ar USING (ticker) WHERE h.step < 5"""),
    ("hp", "SELECT ticker, MAX(p) FILTER (step = 1) AS next_price, MAX(p) FILTER (step = 5) AS horizon_price FROM ho GROUP BY ticker"),
]
Q["forecast_record"] = sql(RECORD, """SELECT ticker, ROUND(b, 8) AS slope, ROUND(a, 8) AS intercept, c AS train_rows, ROUND(fitted_rmse, 4) AS fitted_rmse,
  ROUND(fitted_mae, 4) AS fitted_mae, ROUND(naive_rmse, 4) AS naive_rmse, ROUND(naive_mae, 4) AS naive_mae, ROUND(directional_accuracy, 4) AS directional_accuracy,
  ROUND(residual_sd, 8) AS residual_sd, ROUND(next_price, 4) AS next_price, ROUND(horizon_price, 4) AS horizon_price,
  ROUND(next_price * EXP(-1.96 * residual_sd), 4) AS lower, ROUND(next_price * EXP(1.96 * residual_sd), 4) AS upper
FROM ar JOIN er USING (ticker) JOIN hp USING (ticker)""")



def eliminate(source, name, p):
    """Gauss-Jordan steps on the p x (p + 1) systems ``m`` of a table; ``x`` has the solutions."""
    return [
        (name + "_e RECURSIVE", f"""SELECT * EXCLUDE (m), 1 AS k, m FROM {source}
UNION ALL
SELECT * EXCLUDE (k, m), k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN list_transform(r, lambda v: v / m[k][k])
  ELSE list_transform(r, lambda v, j: v - r[k] * m[k][j] / m[k][k]) END) FROM {name}_e WHERE k <= {p}"""),
        (name, f"SELECT * EXCLUDE (k, m), list_transform(m, lambda r: r[{p + 1}]) AS x FROM {name}_e WHERE k = {p + 1}"),
    ]


NF = len(FEATURE_COLS)
WF_LONG = ROWS + [
    ("fs", "SELECT ticker, n, n // 6 AS size, UNNEST(RANGE(1, 6)) AS f FROM (SELECT DISTINCT ticker, n FROM mr) WHERE n // 6 >= 100"),
    ("lf", "SELECT ticker, seq, UNNEST([" + ", ".join(f"{{'j': {i}, 'x': CAST({c} AS DOUBLE)}}" for i, c in enumerate([*FEATURE_COLS, "target"])) + "], recursive := true) FROM mr"),
    ("sc", f"SELECT ticker, f, j, MIN(x) AS lo, CASE WHEN MAX(x) > MIN(x) THEN MAX(x) - MIN(x) ELSE 1 END AS rg FROM lf JOIN fs USING (ticker) WHERE seq < size * f GROUP BY ALL"),
    ("xs0", f"SELECT ticker, f, seq, j, CASE WHEN j = {NF} THEN x ELSE (x - lo) / rg END AS x FROM lf JOIN fs USING (ticker) JOIN sc USING (ticker, f, j) WHERE seq < size * f"),
    ("xm", "SELECT ticker, f, j, AVG(x) AS xm, COUNT(*) AS rows FROM xs0 GROUP BY ALL"),
    ("xs", "SELECT ticker, f, seq, j, x - xm AS x FROM xs0 JOIN xm USING (ticker, f, j)"),
    ("gr", f"SELECT a.ticker, a.f, a.j AS i, b.j, SUM(a.x * b.x) + CASE WHEN a.j = b.j THEN 1.0 ELSE 0.0 END AS v FROM xs a JOIN xs b USING (ticker, f, seq) WHERE a.j < {NF} GROUP BY a.ticker, a.f, a.j, b.j"),
    ("gm", "SELECT ticker, f, LIST(r ORDER BY i) AS m FROM (SELECT ticker, f, i, LIST(v ORDER BY j) AS r FROM gr GROUP BY ALL) GROUP BY ticker, f"),
] + eliminate("gm", "gs", NF) + [
    ("bt", "SELECT ticker, f, UNNEST(x) AS b, UNNEST(RANGE(LEN(x))) AS j FROM gs"),
    ("tp", f"""SELECT l.ticker, fs.f, l.seq, SUM(b * ((l.x - lo) / rg - xm)) + ANY_VALUE(y.ym) AS d_pred, ANY_VALUE(y.rows) AS train_rows
FROM lf l JOIN fs ON fs.ticker = l.ticker AND l.seq // fs.size = fs.f JOIN bt ON bt.ticker = l.ticker AND bt.f = fs.f AND bt.j = l.j
JOIN sc ON sc.ticker = l.ticker AND sc.f = fs.f AND sc.j = l.j JOIN xm ON xm.ticker = l.ticker AND xm.f = fs.f AND xm.j = l.j
JOIN (SELECT ticker, f, xm AS ym, rows FROM xm WHERE j = {NF}) y ON y.ticker = l.ticker AND y.f = fs.f GROUP BY ALL"""),
    ("tq", "SELECT ticker, f AS fold, train_rows, close * EXP(target) AS actual, close * EXP(d_pred) AS pred, target AS d_actual, d_pred FROM tp JOIN mr USING (ticker, seq)"),
]
Q["walk_forward_features"] = sql(WF_LONG, f"""SELECT ticker, fold, 'ok' AS status, train_rows, {METRICS.format(d=4)} FROM tq GROUP BY ticker, fold, train_rows
UNION ALL SELECT ticker, NULL, 'insufficient: ' || n || ' rows, need 600', NULL, NULL, NULL, NULL, NULL FROM (SELECT DISTINCT ticker, n FROM mr) WHERE n // 6 < 100""")
LAG = ROWS + [
    ("lg0", "SELECT ticker, dt, close, split, target, log_return, " + ", ".join(f"{'log_return' if i == 0 else f'LAG(log_return, {i}) OVER ({W})'} AS lag{i}" for i in range(5)) + " FROM mr"),
    ("lg", "SELECT * FROM lg0 WHERE lag4 IS NOT NULL"),
]


def least_squares(lags, name):
    """Normal equations of the train rows with a constant, as one system."""
    xs = ["1.0::DOUBLE", *[f"lag{i}" for i in range(lags)]]
    rows = ", ".join("[" + ", ".join(f"SUM({a} * {b})" for b in [*xs, "target"]) + "]" for a in xs)
    out = [(name + "_m", f"SELECT [{rows}] AS m FROM lg WHERE split = 'train'")] + eliminate(name + "_m", name, len(xs))
    return out, " + ".join(f"{name}.x[{i + 1}] * {x}" for i, x in enumerate(xs))


FITS = [least_squares(n, f"ls{n}") for n in (1, 3, 5)]
SCORED = LAG + [c for ctes, _ in FITS for c in ctes] + [
    ("sv", "SELECT lg.*, " + ", ".join(f"{e} AS s{k + 1}" for k, (_, e) in enumerate(FITS)) + " FROM lg, ls1, ls3, ls5"),
    ("bv", "SELECT ARG_MIN(v, (miss, v)) AS v FROM (SELECT UNNEST([" + ", ".join(f"{{'v': {k}, 'miss': SQRT(AVG(POW(s{k} - target, 2)))}}" for k in (1, 2, 3)) + "], recursive := true) FROM sv WHERE split = 'val')"),
]
Q["batch_score_stored"] = sql(SCORED, "SELECT ticker, dt, 'v' || v AS version, ROUND(CASE v WHEN 1 THEN s1 WHEN 2 THEN s2 ELSE s3 END, 8) AS score FROM sv, bv WHERE split = 'test'")
Q["linear_member"] = sql(
    SCORED + [("ol", "SELECT ticker, REGR_SLOPE(target, log_return) AS b, REGR_INTERCEPT(target, log_return) AS a FROM lg WHERE split = 'train' GROUP BY ticker")],
    """SELECT ticker, dt, 'linear' AS model, ROUND(close * EXP(s3), 6) AS pred FROM sv WHERE split = 'test'
UNION ALL SELECT ticker, dt, 'ar1', ROUND(close * EXP(a + b * log_return), 6) FROM sv JOIN ol USING (ticker) WHERE split = 'test'""")

U = "(('0x' || SUBSTR(MD5({k}), {s}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
PF = bars("type") + COMMON("bars") + [
    ("al", f"SELECT ticker, dt, LN(close) - LAG(LN(close)) OVER ({W}) AS lr FROM bars WHERE dt IN (SELECT dt FROM common)"),
    ("ix", "SELECT ticker, ROW_NUMBER() OVER (ORDER BY ticker) - 1 AS i FROM (SELECT DISTINCT ticker FROM al)"),
    ("cv", "SELECT a.ticker AS ta, b.ticker AS tb, COVAR_SAMP(a.lr, b.lr) * 252 AS c FROM al a JOIN al b USING (dt) GROUP BY ALL"),
    ("mn", "SELECT ticker, AVG(lr) * 252 AS m FROM al GROUP BY ticker"),
]
Q["mean_cov_annual"] = sql(PF, "SELECT ta AS ticker_a, tb AS ticker_b, ROUND(c, 6) AS cov, ROUND(m, 6) AS mean_a FROM cv JOIN mn ON mn.ticker = ta")
Q["equal_weight"] = sql(PF + [("ew", "SELECT (SELECT AVG(m) FROM mn) AS r, SQRT((SELECT SUM(c) FROM cv) / POW((SELECT COUNT(*) FROM mn), 2)) AS v")],
                        "SELECT ROUND(r, 4) AS expected_return, ROUND(v, 4) AS volatility, ROUND((r - 0.05) / v, 4) AS sharpe_ratio FROM ew")
CAND = PF + [
    ("ex", "SELECT c AS candidate, i, ticker, -LN(" + U.format(k="c || ':' || ticker", s=1) + ") AS e FROM range(0, 1000) g(c), ix"),
    ("wt", "SELECT candidate, i, ticker, e / SUM(e) OVER (PARTITION BY candidate) AS w FROM ex"),
    ("cr", "SELECT candidate, SUM(w * m) AS ret FROM wt JOIN mn USING (ticker) GROUP BY candidate"),
    ("cw", "SELECT a.candidate, SQRT(SUM(a.w * b.w * c)) AS vol FROM wt a JOIN wt b USING (candidate) JOIN cv ON cv.ta = a.ticker AND cv.tb = b.ticker GROUP BY a.candidate"),
    ("cd", "SELECT candidate, ret, vol, CASE WHEN vol > 0 THEN (ret - 0.05) / vol ELSE 0 END AS sharpe FROM cr JOIN cw USING (candidate)"),
]
Q["candidate_portfolios"] = sql(CAND, """SELECT CAST(candidate AS INTEGER) AS candidate, LIST(ROUND(w, 6) ORDER BY i) AS weights,
  ROUND(ANY_VALUE(ret), 6) AS ret, ROUND(ANY_VALUE(vol), 6) AS vol, ROUND(ANY_VALUE(sharpe), 6) AS sharpe FROM cd JOIN wt USING (candidate) GROUP BY candidate""")
Q["max_sharpe_min_vol"] = sql(
    CAND + [
        ("wl", "SELECT candidate, LIST({'ticker': ticker, 'w': w} ORDER BY i) AS ws FROM wt GROUP BY candidate"),
        ("cl", "SELECT candidate, ret, vol, sharpe, ws FROM cd JOIN wl USING (candidate)"),
        ("p1", "SELECT 'max_sharpe' AS portfolio, * FROM cl ORDER BY sharpe DESC, candidate LIMIT 1"),
        ("p2", "SELECT 'min_volatility' AS portfolio, * FROM cl ORDER BY vol, candidate LIMIT 1"),
        ("pk", "SELECT *, UNNEST(ws) AS c FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)"),
    ],
    """SELECT portfolio, CAST(candidate AS INTEGER) AS candidate, ROUND(ret, 4) AS expected_return, ROUND(vol, 4) AS volatility, ROUND(sharpe, 4) AS sharpe_ratio,
  c.ticker AS ticker, ROUND(c.w, 4) AS weight FROM pk""")
Q["efficient_frontier"] = sql(
    CAND + [("rd", 'SELECT candidate, ROUND(ret, 4) AS "return", ROUND(vol, 4) AS volatility, ROUND(sharpe, 4) AS sharpe FROM cd')],
    'SELECT volatility, ARG_MIN("return", candidate) AS "return", ARG_MIN(sharpe, candidate) AS sharpe FROM rd GROUP BY volatility ORDER BY volatility LIMIT 50')

DRIFT = PF + [
    ("tn", "SELECT ticker, i, COUNT(*) OVER () AS c FROM ix"),
    ("tg2", "SELECT 'equal' AS portfolio, LIST(1.0::DOUBLE / c ORDER BY i) AS t, LIST(ticker ORDER BY i) AS names FROM tn UNION ALL SELECT 'ranked', LIST((i + 1) * 2.0::DOUBLE / (c * (c + 1)) ORDER BY i), LIST(ticker ORDER BY i) FROM tn"),
    ("dy", "SELECT dt, LIST(close ORDER BY ticker) AS p, ROW_NUMBER() OVER (ORDER BY dt) AS d FROM bars WHERE dt IN (SELECT dt FROM common) GROUP BY dt"),
    ("dz", "SELECT a.*, b.p AS before, b.dt IS NULL OR DATE_TRUNC('month', a.dt) <> DATE_TRUNC('month', b.dt) AS rebalanced FROM dy a LEFT JOIN dy b ON b.d = a.d - 1"),
    ("wk RECURSIVE", """SELECT portfolio, names, t, d, dt, rebalanced, t AS w, t AS held FROM tg2, dz WHERE d = 1
UNION ALL
SELECT portfolio, names, t, d, dt, rebalanced, w, CASE WHEN rebalanced THEN t ELSE w END FROM (
  SELECT portfolio, names, t, d, dt, rebalanced, list_transform(v, lambda x: x / list_sum(v)) AS w FROM (
    SELECT k.portfolio, k.names, k.t, z.d, z.dt, z.rebalanced, list_transform(k.held, lambda h, i: h * z.p[i] / z.before[i]) AS v FROM wk k JOIN dz z ON z.d = k.d + 1))"""),
    ("dr", "SELECT portfolio, dt, rebalanced, UNNEST(names) AS ticker, UNNEST(w) AS weight, UNNEST(t) AS target FROM wk"),
]
Q["rebalance_drift"] = sql(DRIFT, "SELECT portfolio, ticker, dt, ROUND(weight, 8) AS weight, ROUND(weight - target, 8) AS drift, rebalanced FROM dr")
Q["rebalance_turnover"] = sql(DRIFT, "SELECT portfolio, dt, ROUND(SUM(ABS(weight - target)) / 2, 8) AS turnover, ROUND(MAX(ABS(weight - target)), 8) AS largest_drift FROM dr WHERE rebalanced GROUP BY portfolio, dt")
Q["portfolio_tail_risk"] = sql(
    service_regimes("type") + risk() + [c for c in CAND if c[0] != "bars"] + [
        ("lr", "SELECT candidate, dt, SUM(w * lr) AS r FROM wt JOIN al USING (ticker) WHERE candidate < 200 AND lr IS NOT NULL GROUP BY candidate, dt"),
        ("vq", "SELECT candidate, QUANTILE_CONT(r, 0.05) AS q, COUNT(*) AS days FROM lr GROUP BY candidate"),
        ("es", "SELECT candidate, AVG(r) AS e FROM lr JOIN vq USING (candidate) WHERE r <= q GROUP BY candidate"),
        ("rs", "SELECT ticker, ARG_MAX(risk_score, dt) AS s FROM risk GROUP BY ticker"),
        ("rw", "SELECT candidate, SUM(w * s) AS score FROM wt JOIN rs USING (ticker) GROUP BY candidate"),
    ],
    """SELECT CAST(candidate AS BIGINT) AS portfolio, days, ROUND(-q, 6) AS value_at_risk, ROUND(-e, 6) AS expected_shortfall, ROUND(score, 4) AS risk_score
FROM vq JOIN es USING (candidate) JOIN rw USING (candidate)""")
Q["shock_scenario"] = sql(
    PF + [("sh", "SELECT * FROM (VALUES ('ECONOMY', -0.10::DOUBLE), ('PROMO', 0.03::DOUBLE)) v(ticker, shock)"),
          ("sm0", "SELECT ta, LIST(c ORDER BY tb) || [ANY_VALUE(s.shock)] AS r FROM cv JOIN sh s ON s.ticker = ta WHERE tb IN (SELECT ticker FROM sh) GROUP BY ta"),
          ("sm1", "SELECT LIST(r ORDER BY ta) AS m, LIST(ta ORDER BY ta) AS names FROM sm0")] + eliminate("sm1", "sy", 2) + [
          ("yy", "SELECT UNNEST(names) AS tb, UNNEST(x) AS y FROM sy"),
          ("mv", "SELECT ta AS ticker, SUM(c * y) AS m FROM cv JOIN yy USING (tb) GROUP BY ta")],
    "SELECT ticker, shock, ROUND(COALESCE(shock, m), 8) AS expected_move FROM mv LEFT JOIN sh USING (ticker)")
BETA = ", ".join(
    f"ROUND(CASE WHEN COUNT(*) OVER w{n} = {n} THEN COVAR_POP(log_return, bench_ret) OVER w{n} / VAR_POP(bench_ret) OVER w{n} END, 6) AS beta{n}" for n in (60, 252))
Q["rolling_beta"] = sql(REP[: [n for n, _ in REP].index("common") + 1], f"SELECT ticker, dt, {BETA} FROM common WINDOW " + ", ".join(f"w{n} AS ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (60, 252)))
GRID = [(1.0, 0.5), (0.8, 0.4), (0.6, 0.3)]
TRIES = len(GRID)
MOST = (1 - 0.5772156649015329) * NormalDist().inv_cdf(1 - 1 / TRIES) + 0.5772156649015329 * NormalDist().inv_cdf(1 - 1 / (TRIES * math.e))
Q["deflated_sharpe"] = sql(
    REP + [
        ("gd", "SELECT * FROM (VALUES " + ", ".join(f"({k}, {b}::DOUBLE, {n}::DOUBLE)" for k, (b, n) in enumerate(GRID)) + ") v(k, b, w)"),
        ("wr", "SELECT ticker, dt, k, log_return, CASE WHEN regime IN (0, 3) THEN b WHEN regime IN (1, 2) THEN w ELSE 0 END AS wt FROM lab, gd"),
        ("rr", "SELECT ticker, k, COALESCE(LAG(wt) OVER (PARTITION BY ticker, k ORDER BY dt), 0) * log_return - 0.05 / 252 AS r FROM wr"),
        ("mm", "SELECT ticker, k, AVG(r) AS m, STDDEV_POP(r) AS sd, COUNT(*) AS days FROM rr GROUP BY ticker, k"),
        ("mo", "SELECT ticker, k, AVG(POW((r - m) / sd, 3)) AS sk, AVG(POW((r - m) / sd, 4)) - 3 AS ku FROM rr JOIN mm USING (ticker, k) GROUP BY ticker, k"),
        ("sp", f"SELECT ticker, STDDEV_SAMP(m / sd) * {MOST!r}::DOUBLE AS em, ARG_MAX(k, (ROUND(m / sd, 12), -k)) AS k FROM mm GROUP BY ticker"),
        ("ds", """SELECT ticker, days, k, m / sd AS s, em, sk, ku, (m / sd - em) * SQRT(days - 1) / SQRT(1 - sk * m / sd + (ku + 2) / 4 * POW(m / sd, 2)) AS z
FROM sp JOIN mm USING (ticker, k) JOIN mo USING (ticker, k)"""),
        ("ph", """SELECT ticker, 0.5 + SIGN(z) * SUM((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * EXP(-POW(i * ABS(z) / 4000, 2) / 2)) * ABS(z) / 12000 / SQRT(2 * PI()) AS p
FROM ds, RANGE(0, 4001) g(i) GROUP BY ticker, z"""),
    ],
    f"""SELECT ticker, days, CAST({TRIES} AS BIGINT) AS trials, CAST(k AS INTEGER) AS best, ROUND(s, 6) AS sharpe_daily, ROUND(em, 6) AS expected_max, ROUND(sk, 6) AS skewness,
  ROUND(ku, 6) AS excess_kurtosis, ROUND(p, 6) AS deflated_sharpe FROM ds JOIN ph USING (ticker)""")
