"""Queries on back-tests, research metrics, forecasts and portfolios."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tickloom.constants import FEATURE_COLS
from tickloom.functions.series import by_ticker
from tickloom.operators import backtest, compare, forecast, portfolio, regimes, research, ridge, risk, stored_models
from tickloom.operators.indicators import log_return
from tickloom.plans import report
from tickloom.plans.panels import engineered, report_features, report_regimes, rounded, service_regimes
from tickloom.session import materialise
from tickloom.sources import bars as src


def _frame(spark, sf, universe="brand"):
    return backtest.strategy_frame(regimes.drop_centers(report_regimes(spark, sf, universe)))


def regime_weights(spark, sf):
    df = service_regimes(spark, sf).select("ticker", "dt", "regime")
    return df.withColumn("weight", backtest.regime_weight(F.col("regime")))


def _returns_out(df):
    return rounded(df.select("ticker", "dt", "weight", "cost", "strat_ret"), {"cost": 8, "strat_ret": 8})


def strategy_returns(spark, sf):
    ret = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(by_ticker())) - 1, F.lit(0.0))
    return _returns_out(backtest.with_strategy_returns(service_regimes(spark, sf).withColumn("ret", ret), "ret"))


def strategy_returns_log(spark, sf):
    return _returns_out(backtest.with_strategy_returns(report_regimes(spark, sf), "log_return"))


def regime_backtest_metrics(spark, sf):
    return backtest.regime_backtest_metrics(service_regimes(spark, sf))


def regime_backtest_curves(spark, sf):
    return backtest.regime_backtest_curves(service_regimes(spark, sf))


def regime_report(spark, sf):
    return report.regime_report(service_regimes(spark, sf))


def _ensemble_trades(spark, sf):
    wide = forecast.baseline_predictions(src.load_bars(spark, sf))
    return backtest.signal_backtest(wide.withColumn("pred", (F.col("naive") + F.col("sma5") + F.col("sma20")) / 3))


def signal_backtest(spark, sf):
    df = _ensemble_trades(spark, sf).select("ticker", "dt", F.col("signal").cast("int").alias("signal"), "equity", "buy", "sell")
    return rounded(df, {"equity": 3})


def signal_backtest_metrics(spark, sf):
    df = backtest.signal_metrics(_ensemble_trades(spark, sf))
    return rounded(df, {"sharpe": 4, "total_return_pct": 4, "buy_hold_return_pct": 4})


def forecast_metrics(spark, sf):
    preds = forecast.long_predictions(forecast.baseline_predictions(src.load_bars(spark, sf)))
    out = backtest.forecast_metrics(preds, ["ticker", "model"])
    return rounded(out, {c: 6 for c in ["rmse", "mae", "mape", "r2", "directional_accuracy"]})


def perf_ratios(spark, sf):
    cols = [c for c in report.SCORES if c not in ("alpha", "beta")]
    return rounded(backtest.performance(_frame(spark, sf)).select("ticker", "n_trading_days", *cols), {c: 4 for c in cols})


def alpha_beta(spark, sf):
    out = _frame(spark, sf).groupBy("ticker").agg(*[c.alias(n) for n, c in backtest.alpha_beta().items()])
    return rounded(out, {"alpha": 4, "beta": 6})


def _ics(spark, sf):
    return research.rolling_ic(_frame(spark, sf))


def rolling_ic(spark, sf):
    return rounded(_ics(spark, sf), {"ic": 8})


def ic_ttest(spark, sf):
    out = research.ic_summary(_ics(spark, sf))
    return rounded(out, {"ic_mean": 6, "ic_std": 6, "ic_ir": 4, "t_stat": 4})


def ic_significance(spark, sf):
    out = research.with_p_value(research.ic_summary(_ics(spark, sf))).select("ticker", "t_stat", "p_value", "significant")
    return rounded(out, {"t_stat": 4, "p_value": 6})


def cv_ic(spark, sf):
    return rounded(research.cv_ic(_frame(spark, sf)), {"ic_mean": 4, "ic_std": 4})


def walk_forward_thresholds(spark, sf):
    return research.walk_forward_folds(_frame(spark, sf))


def walk_forward_summary(spark, sf):
    out = research.walk_forward_summary(research.walk_forward_folds(_frame(spark, sf)))
    return rounded(out, {"wf_sharpe_mean": 4, "wf_sharpe_std": 4})


def quant_report(spark, sf, universe="brand"):
    out = report.flat_report(report_regimes(spark, sf, universe)).drop("p_value", "significant")
    digits = {c: 4 for c in [*report.SCORES, "ic_mean", "ic_std", "ic_ir", "t_stat", "cv_ic_mean", "cv_ic_std", "wf_sharpe_mean", "wf_sharpe_std"]}
    return rounded(out, digits | {"confidence_current": 3})


def quant_report_nested(spark, sf):
    return report.nested_report(report_regimes(spark, sf))


def _model_rows(spark, sf):
    return forecast.with_split(forecast.with_target(engineered(spark, sf)))


def chrono_split(spark, sf):
    return _model_rows(spark, sf).select("ticker", "dt", "split")


def minmax_train_only(spark, sf):
    df = forecast.minmax_train_only(_model_rows(spark, sf), [*FEATURE_COLS, "target"])
    cols = [f"{c}_scaled" for c in [*FEATURE_COLS, "target"]]
    return rounded(df.select("ticker", "dt", "split", *cols), {c: 8 for c in cols})


def make_sequences(spark, sf):
    df = forecast.make_sequences(_model_rows(spark, sf), FEATURE_COLS)
    close, rsi, macd = (FEATURE_COLS.index(c) for c in ("close", "rsi14", "macd"))
    total = lambda i: F.aggregate("x", F.lit(0.0), lambda acc, r: acc + r[i])
    return df.select(
        "ticker", "dt", "split", F.size("x").cast("bigint").alias("length"),
        F.round(total(close), 9).alias("sum_close"), F.round(total(rsi), 4).alias("sum_rsi"), F.round(F.element_at("x", 1)[close], 6).alias("first_close"),
        F.round(F.element_at("x", -1)[macd], 4).alias("last_macd"), F.round("target", 8).alias("target"),
    )


def inverse_scale(spark, sf):
    df = forecast.minmax_train_only(_model_rows(spark, sf), ["close", "target"])
    return df.select(
        "ticker", "dt",
        F.round(forecast.inverse_minmax(F.col("target_scaled"), "target"), 8).alias("target_restored"),
        F.round(forecast.inverse_minmax(F.col("close_scaled"), "close"), 9).alias("close_restored"),
        F.round(forecast.scale_single(F.col("close"), "close"), 8).alias("close_single"),
    )


def price_from_logret(spark, sf):
    price = forecast.price_from_log_return(F.col("close"), F.col("target"))
    return _model_rows(spark, sf).select("ticker", "dt", F.round(price, 9).alias("next_price"))


def ensemble_band(spark, sf):
    wide = forecast.baseline_predictions(src.load_bars(spark, sf))
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("pred")) for m in forecast.MODELS])
    out = forecast.ensemble_band(wide.select("ticker", "dt", F.inline(cells)))
    return rounded(out, {"ensemble": 4, "lower": 4, "upper": 4})


def ar1_forecaster(spark, sf):
    return rounded(forecast.fit_ar1(_model_rows(spark, sf)), {"slope": 8, "intercept": 8})


def return_forecaster(spark, sf):
    return forecast.return_forecaster(_model_rows(spark, sf))


def roll_forecast(spark, sf):
    return rounded(forecast.roll_forecast(engineered(spark, sf)), {"price": 4})


def walk_forward_eval(spark, sf):
    out = forecast.walk_forward_eval(forecast.with_target(engineered(spark, sf)))
    return rounded(out, {c: 4 for c in ["rmse", "mae", "directional_accuracy", "r2"]})


def walk_forward_eval_summary(spark, sf):
    folds = rounded(forecast.walk_forward_eval(forecast.with_target(engineered(spark, sf))), {"rmse": 4, "directional_accuracy": 2})
    out = forecast.walk_forward_eval_summary(folds)
    return rounded(out, {c: 3 for c in out.columns if c.startswith(("mean", "std"))})


def batch_score(spark, sf):
    df = _model_rows(spark, sf)
    out = forecast.batch_score(df.where("split = 'test'"), forecast.fit_ar1(df))
    return rounded(out.select("ticker", "dt", "score"), {"score": 8})


def walk_forward_features(spark, sf):
    out = ridge.walk_forward_features(forecast.with_target(engineered(spark, sf)))
    return rounded(out, {c: 4 for c in ["rmse", "mae", "directional_accuracy", "r2"]})


def batch_score_stored(spark, sf):
    """Test rows scored by the best of three stored versions, loaded from the shared folder."""
    table = stored_models.model_table(_model_rows(spark, sf))
    runs, folders = stored_models.fit_versions(table, [1, 3, 5], datetime.date(2001, 7, 1))
    out = stored_models.batch_score(table.where("split = 'test'"), runs, folders)
    return rounded(out.select("ticker", "dt", "version", "score"), {"score": 8})


def ensemble_forecast(spark, sf):
    return stored_models.ensemble_forecast(stored_models.model_table(_model_rows(spark, sf)))


def linear_member(spark, sf):
    """The two members of the ensemble with a closed form."""
    members = stored_models.ensemble_members(stored_models.model_table(_model_rows(spark, sf)), trees=1)
    return rounded(members.where(F.col("model").isin("linear", "ar1")), {"pred": 6})


def forecast_record(spark, sf):
    out = forecast.forecast_record(engineered(spark, sf))
    return rounded(out, {c: 8 if c in ("slope", "intercept", "residual_sd") else 4 for c in out.columns if c not in ("ticker", "train_rows")})


def _asset_returns(spark, sf):
    aligned = compare.align_panel(src.load_bars(spark, sf, "type").select("ticker", "dt", "close"))
    return materialise(aligned.withColumn("log_return", log_return()), "asset-returns")


def mean_cov_annual(spark, sf):
    out = portfolio.mean_cov_annual(_asset_returns(spark, sf))
    return rounded(out, {"mean_a": 6, "cov": 6})


def equal_weight(spark, sf):
    out = portfolio.equal_weight(_asset_returns(spark, sf))
    return out.select(F.round("ret", 4).alias("expected_return"), F.round("vol", 4).alias("volatility"), F.round("sharpe", 4).alias("sharpe_ratio"))


def _candidates(spark, sf):
    return portfolio.candidate_portfolios(_asset_returns(spark, sf))


def candidate_portfolios(spark, sf):
    out = rounded(_candidates(spark, sf), {"ret": 6, "vol": 6, "sharpe": 6})
    return out.withColumn("weights", F.transform("weights", lambda w: F.round(w, 6)))


def max_sharpe_min_vol(spark, sf):
    returns = _asset_returns(spark, sf)
    return portfolio.best_portfolios(portfolio.candidate_portfolios(returns), returns)


def efficient_frontier(spark, sf):
    return portfolio.efficient_frontier(_candidates(spark, sf))


def _targets(returns):
    """Two portfolios over all instruments: equal weights, and weights that grow with the place of the name."""
    names = returns.agg(F.array_sort(F.collect_set("ticker")).alias("names"))
    rows = names.select(F.size("names").alias("n"), F.posexplode("names").alias("i", "ticker"))
    both = F.array(
        F.struct(F.lit("equal").alias("portfolio"), (F.lit(1.0) / F.col("n")).alias("target")),
        F.struct(F.lit("ranked").alias("portfolio"), ((F.col("i") + 1) * 2.0 / (F.col("n") * (F.col("n") + 1))).alias("target")),
    )
    return rows.select("ticker", F.inline(both))


def _drift(spark, sf):
    prices = _asset_returns(spark, sf)
    return risk.rebalance_drift(prices, _targets(prices))


def rebalance_drift(spark, sf):
    return rounded(_drift(spark, sf), {"weight": 8, "drift": 8})


def rebalance_turnover(spark, sf):
    return rounded(risk.rebalance_turnover(_drift(spark, sf)), {"turnover": 8, "largest_drift": 8})


def portfolio_tail_risk(spark, sf):
    """Candidate portfolios with their tail losses and the risk score of what they hold."""
    returns = _asset_returns(spark, sf)
    vectors = portfolio.candidate_portfolios(returns, 200).select(F.col("candidate").alias("portfolio"), "weights")
    board = regimes.regime_scoreboard(regimes.with_risk_score(regimes.drop_centers(service_regimes(spark, sf, "type"))))
    out = risk.tail_risk(materialise(vectors, "weights"), returns.where(F.col("log_return").isNotNull()), board.select("ticker", "risk_score"))
    return rounded(out, {"value_at_risk": 6, "expected_shortfall": 6, "risk_score": 4})


SHOCKS = [("ECONOMY", -0.10), ("PROMO", 0.03)]


def shock_scenario(spark, sf):
    covariances = portfolio.mean_cov_annual(_asset_returns(spark, sf)).select("ticker_a", "ticker_b", "cov")
    return rounded(risk.shock_scenario(covariances, spark.createDataFrame(SHOCKS, "ticker string, shock double")), {"expected_move": 8})


def rolling_beta(spark, sf):
    out = risk.rolling_beta(report_features(spark, sf).select("ticker", "dt", "log_return", "bench_ret"), [60, 252])
    return rounded(out.select("ticker", "dt", "beta60", "beta252"), {"beta60": 6, "beta252": 6})


def deflated_sharpe(spark, sf):
    out = risk.deflated_sharpe(report_regimes(spark, sf))
    return rounded(out, {c: 6 for c in ["sharpe_daily", "expected_max", "skewness", "excess_kurtosis", "deflated_sharpe"]})


QUERIES = {
    f.__name__: f
    for f in (
        regime_weights, strategy_returns, strategy_returns_log, regime_backtest_metrics, regime_backtest_curves,
        regime_report, signal_backtest, signal_backtest_metrics,
        forecast_metrics, perf_ratios, alpha_beta, rolling_ic, ic_ttest, ic_significance, cv_ic,
        walk_forward_thresholds, walk_forward_summary, quant_report, quant_report_nested,
        chrono_split, minmax_train_only, make_sequences, inverse_scale, price_from_logret, ensemble_band,
        ar1_forecaster, return_forecaster, roll_forecast, walk_forward_eval, walk_forward_eval_summary, batch_score, forecast_record,
        walk_forward_features, batch_score_stored, ensemble_forecast, linear_member,
        mean_cov_annual, equal_weight, candidate_portfolios, max_sharpe_min_vol, efficient_frontier,
        rebalance_drift, rebalance_turnover, portfolio_tail_risk, shock_scenario, rolling_beta, deflated_sharpe,
    )
}
