"""What alert rules read, kept up to date bar by bar on a stream.

Every ticker has one row of state: its last closes, the running averages behind MACD and EMA, the peak and the last
regime.  The state does not grow with the series.  Regimes come from stored models (``regimes.fit_models``), fitted on
the past, so a bar is judged by what was known before it.  ``batch_inputs`` gives the same rows for a table of bars.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickloom.constants import REGIME_FEATURES
from tickloom.functions.series import by_ticker, running
from tickloom.operators.indicators import indicator_columns, regime_feature_columns

#: Days without a bar after which a series starts anew; its state goes by an event-time timer.
IDLE_DAYS = 365

INPUTS = "ticker string, dt date, close double, rsi14 double, regime int, prev_regime int, drawdown double"
_STATE = "bars long, closes array<double>, averages array<double>, ema20 array<double>, peak double, regime int, last date"
_DAY = datetime.date(1970, 1, 1)


def next_state(state: tuple | None, close: float) -> tuple[int, list[float], list[float], list[float], float]:
    """Bars, last 21 closes, (ema12, ema20, ema26, signal), last 11 values of ema20, peak, with one more close."""
    if state is None:
        return 1, [close], [close, close, close, 0.0], [close], close
    bars, closes, averages, ema20, peak = state
    e12, e20, e26 = (e + 2.0 / (span + 1) * (close - e) for e, span in zip(averages, (12, 20, 26), strict=False))
    signal = averages[3] + 0.2 * ((e12 - e26) - averages[3])
    return bars + 1, [*closes, close][-21:], [e12, e20, e26, signal], [*ema20, e20][-11:], max(peak, close)


def rsi14(closes: list[float]) -> float | None:
    if len(closes) < 15:
        return None
    deltas = [b - a for a, b in zip(closes[-15:-1], closes[-14:], strict=True)]
    gain, loss = sum(max(d, 0.0) for d in deltas) / 14, sum(max(-d, 0.0) for d in deltas) / 14
    return 100.0 - 100.0 / (1.0 + gain / (loss + 1e-9))


def features(state: tuple) -> list[float] | None:
    """The five regime features, once all their windows are full."""
    _, closes, averages, ema20, _ = state
    rsi = rsi14(closes)
    if rsi is None or len(closes) < 21 or min(closes) <= 0:
        return None
    returns = [math.log(b) - math.log(a) for a, b in zip(closes[-21:-1], closes[-20:], strict=True)]
    mean = sum(returns) / 20
    sma = sum(closes[-20:]) / 20
    base = ema20[0] or 1.0
    values = {
        "rsi_dev": rsi - 50.0,
        "macd_hist_norm": (averages[0] - averages[2] - averages[3]) / (sma * 0.01 + 1e-9),
        "ema_slope": (ema20[-1] - ema20[0]) / (base + 1e-9) * 100.0,
        "vol20": math.sqrt(sum((r - mean) ** 2 for r in returns) / 19),
        "ret10": (closes[-1] / closes[-11] - 1) * 100.0,
    }
    return [values[c] for c in REGIME_FEATURES]


def regime_of(values: list[float] | None, means, stds, centers, ranks) -> int | None:
    """Regime of the nearest stored centre, distances compared at nine digits, the lower cluster on ties."""
    if values is None or not ranks:
        return None
    z = [(v - m) / s for v, m, s in zip(values, means, stds, strict=True)]
    d = len(z)
    dist = [math.floor(sum((a - b) ** 2 for a, b in zip(z, centers[k * d : k * d + d], strict=True)) * 1e9 + 0.5) for k in range(len(ranks))]
    return int(ranks[dist.index(min(dist))])


class AlertInputs(StatefulProcessor):
    """One row out per bar: close, RSI, regime and the one before it, drawdown from the peak."""

    def __init__(self, idle_days: int):
        self.idle = idle_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        (ticker,) = key
        held = self.series.get() if self.series.exists() else None
        state, regime, last = (tuple(held[:5]), held[5], held[6]) if held is not None else (None, None, None)
        # A ticker has one bar a day, so a batch holds few rows of one; windows close in order of time.
        for bar in sorted(rows, key=lambda r: r["dt"]):
            if last is not None and bar["dt"] <= last:
                continue
            if last is not None and (bar["dt"] - last).days > self.idle:
                state, regime = None, None
            state = next_state(state, bar["close"])
            now = regime_of(features(state), bar["means"], bar["stds"], bar["centers"], bar["ranks"])
            peak = state[4]
            drawdown = (peak - bar["close"]) / peak * 100 if peak else None
            yield Row(ticker=ticker, dt=bar["dt"], close=bar["close"], rsi14=rsi14(state[1]), regime=now, prev_regime=regime, drawdown=drawdown)
            regime, last = now, bar["dt"]
        if last is not None:
            self.series.update((*state, regime, last))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(((last - _DAY).days + self.idle + 1) * 86_400_000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.series.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_inputs(bars: DataFrame, models: DataFrame, idle_days: int = IDLE_DAYS) -> DataFrame:
    """Streamed bars (ticker, dt, close, event time ``at``) with what the rules read.

    ``models`` is the static side, one row per ticker (``fit_models``); tickers without one have no regime.
    """
    judged = bars.select("ticker", "dt", "close", "at").join(models, "ticker", "left")
    return judged.groupBy("ticker").transformWithState(
        statefulProcessor=AlertInputs(idle_days), outputStructType=INPUTS, outputMode="Append", timeMode="EventTime"
    )


def stored_regime(values: list[Column]) -> Column:
    """The regime of a row by the stored model beside it."""
    count = len(values)
    z = [(v - F.get("means", F.lit(i))) / F.get("stds", F.lit(i)) for i, v in enumerate(values)]
    far = []
    for k in range(6):
        dist = sum((F.pow(z[i] - F.get("centers", F.lit(k * count + i)), 2) for i in range(count)), F.lit(0.0))
        rank = F.get("ranks", F.lit(k))
        far.append(F.when(rank.isNotNull(), F.struct(F.floor(dist * 1e9 + 0.5).alias("d"), F.lit(k).alias("k"), rank.alias("rank"))))
    complete = F.lit(True)
    for v in values:
        complete = complete & v.isNotNull()
    return F.when(complete, F.array_min(F.array(*far))["rank"]).cast("int")


def batch_inputs(bars: DataFrame, models: DataFrame, idle_days: int = IDLE_DAYS) -> DataFrame:
    """The rows of ``stream_inputs`` for a table of bars."""
    gap = F.datediff("dt", F.lag("dt").over(by_ticker())) > idle_days
    life = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    df = bars.select("ticker", "dt", "close").withColumn("_life", life)
    # Windows run per ticker; a life after a long silence is a series of its own.
    df = df.select(F.concat_ws("\n", "ticker", "_life").alias("ticker"), F.col("ticker").alias("_name"), "dt", "close")
    df = regime_feature_columns(indicator_columns(df))
    df = df.join(models.withColumnRenamed("ticker", "_name"), "_name", "left")
    df = df.withColumn("regime", stored_regime([F.col(c) for c in REGIME_FEATURES]))
    peak = F.max("close").over(running())
    return df.select(
        F.col("_name").alias("ticker"), "dt", "close", "rsi14", "regime", F.lag("regime").over(by_ticker()).alias("prev_regime"),
        (F.try_divide(peak - F.col("close"), peak) * 100).alias("drawdown"),
    )
