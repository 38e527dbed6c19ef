"""Column builders for ordered series.

A bar series holds at most one row per ticker and calendar day (``sources.bars``
enforces it), about 37,000 rows per century, so a per-ticker window is a bounded
group however many ticks the ticker has.  All operators use the same window
specification, so a plan shuffles its bars by ticker once and every later window
and per-ticker aggregate runs on that partitioning.

Tables without such a bound (request logs, ticks) go through ``functions.blocks``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TICKER = "ticker"
DATE = "dt"

# Exponents inside a block of the exponential scan stay below the first (doubles
# end near 709); what two blocks back contribute is below e to minus the second.
EMA_REACH, EMA_VANISH = 600.0, 40.0


def by_ticker():
    """The shared per-ticker, date-ordered window."""
    return Window.partitionBy(TICKER).orderBy(DATE)


def whole_ticker():
    return Window.partitionBy(TICKER)


def running():
    return by_ticker().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def full_window(value: Column, agg, n: int) -> Column:
    """``agg(value)`` over the last ``n`` rows, null until all ``n`` values exist."""
    frame = by_ticker().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, agg(value).over(frame))


def forward_fill(value: Column) -> Column:
    return F.last(value, ignorenulls=True).over(running())


def fill_both_ways(value: Column) -> Column:
    """Forward fill, then backward fill.

    After the forward fill only leading rows are empty, and all of them take the
    first value of the series; a frame up to the end of the series would cost
    quadratic time for the same result.
    """
    everything = by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(forward_fill(value), F.first(value, ignorenulls=True).over(everything))


def with_position(df: DataFrame, seq: str = "seq", count: str | None = None) -> DataFrame:
    """Add the 0-based position in the series and, on request, its length."""
    df = df.withColumn(seq, (F.row_number().over(by_ticker()) - 1).cast("bigint"))
    if count:
        df = df.withColumn(count, F.count(F.lit(1)).over(whole_ticker()).cast("bigint"))
    return df


def downsample(df: DataFrame, points: int, keep_last: bool = False) -> DataFrame:
    """Every k-th row of a series, k = max(1, n // points), plus the last row on request."""
    df = with_position(df, "_pos", "_n")
    step = F.greatest(F.lit(1), F.floor(F.col("_n") / points))
    keep = F.col("_pos") % step == 0
    if keep_last:
        keep = keep | (F.col("_pos") == F.col("_n") - 1)
    return df.where(keep).drop("_pos", "_n")


def ema_groups(specs: dict[str, tuple[str, int]]) -> list[tuple[int, list[str]]]:
    """(block length, names): averages whose decay lets them share a block length."""
    out: list[tuple[int, list[str]]] = []
    for name in sorted(specs, key=lambda n: specs[n][1]):
        decay = _decay(specs[name][1])
        if not out or out[-1][0] * decay < EMA_VANISH:
            out.append((max(1, int(EMA_REACH / decay)), []))
        out[-1][1].append(name)
    return out


def _decay(span: int) -> float:
    """Minus the logarithm of q = 1 - 2 / (span + 1)."""
    if span < 1:
        raise ValueError("span must be 1 at least")
    return -math.log1p(-2.0 / (span + 1)) if span > 1 else math.inf


def with_ema(df: DataFrame, specs: dict[str, tuple[str, int]]) -> DataFrame:
    """Add exponential moving averages ``{name: (column, span)}``; needs ``seq``.

    The recursion e_i = e_{i-1} + a (x_i - e_{i-1}), seeded with x_0, is a linear
    scan.  Inside a block it is a running sum of x_j q^-j scaled by q^k; the only
    carry is the last value of the preceding block, times q^(k+1).  The length of
    a block follows from q, so any span is exact to rounding: powers stay in
    range, and blocks before the preceding one have no weight left.
    """
    same = {name: F.col(source) for name, (source, span) in specs.items() if span == 1}
    rest = {name: spec for name, spec in specs.items() if spec[1] != 1}
    order = [*df.columns, *[n for n in specs if n not in df.columns]]
    for length, names in ema_groups(rest):
        df = _ema_pass(df, {n: rest[n] for n in names}, length)
    return df.withColumns(same).select(*order) if same else df.select(*order)


def _ema_pass(df: DataFrame, specs: dict[str, tuple[str, int]], length: int) -> DataFrame:
    keep = df.columns
    df = df.withColumn("_blk", F.floor(F.col("seq") / length)).withColumn("_k", (F.col("seq") % length).cast("double"))
    in_block = (
        Window.partitionBy(TICKER, "_blk").orderBy(DATE).rowsBetween(Window.unboundedPreceding, 0)
    )
    previous_block = Window.partitionBy(TICKER).orderBy("_blk").rangeBetween(-1, -1)
    local, carried = {}, {}
    for name, (source, span) in specs.items():
        alpha = 2.0 / (span + 1)
        q = 1.0 - alpha
        weight = F.when(F.col("seq") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
        scaled = weight * F.col(source) * F.pow(F.lit(q), -F.col("_k"))
        local[f"_loc_{name}"] = F.pow(F.lit(q), F.col("_k")) * F.sum(scaled).over(in_block)
        end = F.max(F.when(F.col("_k") == length - 1, F.col(f"_loc_{name}"))).over(previous_block)
        carried[name] = F.col(f"_loc_{name}") + F.coalesce(
            end * F.pow(F.lit(q), F.col("_k") + 1), F.lit(0.0)
        )
    return df.withColumns(local).withColumns(carried).select(*keep, *specs)


def sharpe(returns: Column, kind: str, over=None) -> Column:
    """Annualised Sharpe ratio; ``kind`` names the spread estimate and its guard.

    ``pop`` and ``pop9`` divide by the population deviation plus 1e-12 / 1e-9,
    ``sample9`` by the sample deviation plus 1e-9, ``sample0`` by the sample
    deviation and gives 0 when there is no spread.
    """
    from tickloom.constants import RISK_FREE_DAILY, TRADING_DAYS

    excess = returns - F.lit(RISK_FREE_DAILY)
    mean = F.avg(excess)
    std = F.stddev_samp(excess) if kind.startswith("sample") else F.stddev_pop(excess)
    if over is not None:
        mean, std = mean.over(over), std.over(over)
    scale = F.lit(math.sqrt(TRADING_DAYS))
    if kind == "sample0":
        return F.when(std > 0, mean / std * scale).otherwise(F.lit(0.0))
    guard = {"pop": 1e-12, "pop9": 1e-9, "sample9": 1e-9}[kind]
    return mean / (std + F.lit(guard)) * scale


def midrank(value: str, partition: list[str]) -> Column:
    """Average rank of ties within a bounded partition."""
    ordered = Window.partitionBy(*partition).orderBy(value)
    ties = Window.partitionBy(*partition, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def finite_or_null(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)
