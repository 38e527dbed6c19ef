"""The quant report: every performance and research metric of a panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import backtest, indicators, regimes, research
from tickloom.session import materialise

SCORES = [
    "sharpe_ratio", "sortino_ratio", "calmar_ratio", "max_drawdown", "cagr", "alpha", "beta", "sharpe_bh", "mdd_bh", "cagr_bh",
]


def gather(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows of a ticker as one ordered array; only used on charts and tables of bounded length."""
    cells = F.array_sort(F.collect_list(F.struct(*order, *[c for c in df.columns if c not in (*order, "ticker")])))
    return df.groupBy("ticker").agg(cells.alias(name))


def _last(array: str, n: int | None):
    return F.col(array) if n is None else F.slice(array, F.greatest(F.lit(1), F.size(array) - (n - 1)), n)


def regime_report(labelled: DataFrame) -> DataFrame:
    """The regime service's result, one nested record per ticker."""
    base = materialise(labelled)
    scored = regimes.with_risk_score(base.drop("centers"))
    out = regimes.regime_scoreboard(scored)
    indicators_now = F.struct("rsi14", "ema20", "macd", "macd_hist", "close", "log_return").alias("indicators")
    current = F.struct(F.col("regime").alias("id"), F.col("regime_name").alias("name"), F.col("regime_color").alias("color"), F.col("regime_description").alias("description"))
    alert = F.struct(F.col("alert").alias("level"), F.col("alert_label").alias("label"), F.col("alert_color").alias("color"), F.col("alert_description").alias("description"))
    out = out.select("ticker", current.alias("current_regime"), "risk_score", alert.alias("alert"), indicators_now)
    backtested = backtest.regime_backtest_metrics(base)
    metrics = F.struct(*[c for c in backtested.columns if c != "ticker"])
    parts = [
        gather(regimes.forward_stats(base), "regime_stats", ["regime", "horizon"]),
        gather(regimes.regime_timeline(scored), "timeline", ["dt"]),
        gather(regimes.similar_scenarios(base), "similar_matches", ["match"]),
        backtested.select("ticker", metrics.alias("quant_backtest")),
        gather(backtest.regime_backtest_curves(base), "backtest_curves", ["dt"]),
    ]
    for part in parts:
        out = out.join(part, "ticker", "left")
    return out


def flat_report(labelled: DataFrame) -> DataFrame:
    """One row of scalar metrics per ticker."""
    frame = materialise(backtest.strategy_frame(regimes.with_confidence(labelled)).drop("centers", *regimes.Z_COLS))
    current = {"confidence_current": F.max_by("confidence", "dt")}
    perf = backtest.performance(frame, current)
    ic = research.with_p_value(research.ic_summary(research.rolling_ic(frame)))
    cv = research.cv_ic(frame).select("ticker", F.col("ic_mean").alias("cv_ic_mean"), F.col("ic_std").alias("cv_ic_std"))
    wf = research.walk_forward_summary(research.walk_forward_folds(frame))
    return perf.join(ic.drop("n"), "ticker", "left").join(cv, "ticker", "left").join(wf, "ticker", "left")


def nested_report(labelled: DataFrame, coefficients: int | None = None, points: int | None = 250) -> DataFrame:
    """The report as one nested record per ticker, charts included.

    ``coefficients``: the last so many rolling coefficients, None for all; ``points``: rows of the rolling chart at
    most, None for all.  Full series are the queries ``rolling_ic``, ``rolling_vol``, ``rolling_sharpe60``.
    """
    base = materialise(regimes.with_confidence(labelled))
    frame = materialise(backtest.strategy_frame(base).drop("centers", *regimes.Z_COLS))

    perf = backtest.performance(frame, {"confidence_current": F.max_by("confidence", "dt")})
    perf = perf.select("ticker", "n_trading_days", "confidence_current", F.struct(*[F.round(c, 4).alias(c) for c in SCORES]).alias("performance"))
    ics = materialise(research.rolling_ic(frame))
    stats = research.with_p_value(research.ic_summary(ics)).select("ticker", F.struct("ic_mean", "ic_std", "ic_ir", "t_stat", "p_value", "significant").alias("ic"))
    rolling = frame.withColumns(
        {"volatility": indicators.rolling_volatility(), "sharpe": indicators.rolling_sharpe("strat_ret")}
    ).select("ticker", "dt", "volatility", "sharpe", F.round("equity", 2).alias("equity_strat"), F.round("bh_equity", 2).alias("equity_bh"), F.round(F.col("equity_dd") * 100, 3).alias("drawdown"))
    series = gather(ics.select("ticker", "dt", F.round("ic", 4).alias("ic")), "_all", ["dt"])
    parts = [
        stats,
        series.select("ticker", _last("_all", coefficients).alias("ic_series")),
        gather(rolling if points is None else regimes.downsample(rolling, points), "rolling", ["dt"]),
        gather(regimes.transition_matrix(frame), "transition_matrix", ["from_regime", "to_regime"]),
        gather(regimes.feature_importance(base), "feature_importance", ["rank"]),
        gather(regimes.confidence_by_regime(base).drop("current"), "regime_confidence", ["regime_name"]),
        gather(research.walk_forward_folds(frame), "walk_forward", ["fold"]),
        research.cv_ic(frame).select("ticker", F.struct("fold_ics", "ic_mean", "ic_std").alias("cross_validation")),
    ]
    for part in parts:
        perf = perf.join(part, "ticker", "left")
    return perf
