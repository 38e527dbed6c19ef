"""Mean-variance portfolios over all instruments of a panel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.constants import RISK_FREE_ANNUAL
from tickloom.functions.hashing import uniform
from tickloom.operators.compare import complete_dates, pairwise
from tickloom.session import materialise

ANNUAL = 252.0


def mean_cov_annual(returns: DataFrame) -> DataFrame:
    """Annualised sample covariance in long form with the annualised mean of the first side."""
    cov = pairwise(returns, "log_return", "covariance", "cov")
    return cov.withColumn("cov", F.col("cov") * ANNUAL).join(_means(returns).withColumnRenamed("ticker", "ticker_a"), "ticker_a")


def _means(returns: DataFrame) -> DataFrame:
    return complete_dates(returns, "log_return").groupBy("ticker").agg((F.avg("log_return") * ANNUAL).alias("mean_a"))


def _with_sharpe(df: DataFrame, rf: float) -> DataFrame:
    ratio = F.when(F.col("vol") > 0, (F.col("ret") - rf) / F.col("vol")).otherwise(F.lit(0.0))
    return df.withColumn("sharpe", ratio)


def equal_weight(returns: DataFrame, rf: float = RISK_FREE_ANNUAL) -> DataFrame:
    """Return, volatility and Sharpe of all instruments at equal weights, from sums over the covariance table."""
    table = mean_cov_annual(returns)
    total = table.agg(F.sum("cov").alias("c"), F.avg("mean_a").alias("ret"), F.count_distinct("ticker_a").alias("n"))
    return _with_sharpe(total.select("ret", (F.sqrt("c") / F.col("n")).alias("vol")), rf)


#: Portfolios and dates of one tile of the product of weights and returns.
TILE_PORTFOLIOS, TILE_DATES = 128, 512


def portfolio_returns(vectors: DataFrame, returns: DataFrame) -> DataFrame:
    """Daily return of every portfolio: portfolio, dt, ret.

    ``vectors``: portfolio (a whole number) and ``weights``, one weight per instrument in order of names.  ``returns`` has
    ticker, dt and log_return on dates that all instruments share.  A date is one vector as well, bounded by the number
    of instruments; vectors are dealt into blocks and a tile is one product of two matrices, so no row per portfolio,
    date and instrument is ever made.
    """
    cells = F.array_sort(F.collect_list(F.struct("ticker", F.col("log_return").alias("r"))))
    days = returns.groupBy("dt").agg(F.transform(cells, lambda c: c["r"]).alias("x"))
    n_days, n_portfolios = returns.select("dt").distinct().count(), vectors.count()
    down, across = max(1, -(-n_portfolios // TILE_PORTFOLIOS)), max(1, -(-n_days // TILE_DATES))
    left = vectors.select(
        F.pmod("portfolio", F.lit(down)).cast("int").alias("_down"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_across"),
        F.col("portfolio").cast("long").alias("portfolio"), F.lit(None).cast("date").alias("dt"), F.col("weights").alias("x"),
    )
    right = days.select(
        F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_down"), F.pmod(F.unix_date("dt"), F.lit(across)).cast("int").alias("_across"),
        F.lit(None).cast("long").alias("portfolio"), "dt", "x",
    )

    def tile(rows: pa.Table) -> pa.Table:
        is_day = np.asarray(rows["portfolio"].is_null())
        x = np.array(rows["x"].to_pylist(), dtype=float)
        w, r = x[~is_day], x[is_day]
        product = (w @ r.T).ravel() if len(w) and len(r) else np.zeros(0)
        keep = pa.array(~is_day)
        portfolios, dates = rows["portfolio"].filter(keep).to_numpy(), rows["dt"].filter(pa.array(is_day)).combine_chunks()
        return pa.table(
            {
                "portfolio": pa.array(np.repeat(portfolios, len(r)), pa.int64()),
                "dt": dates.take(pa.array(np.tile(np.arange(len(r)), len(w)))),
                "ret": pa.array(product),
            }
        )

    return left.unionByName(right).groupBy("_down", "_across").applyInArrow(tile, "portfolio long, dt date, ret double")


def candidate_portfolios(returns: DataFrame, count: int = 1000, rf: float = RISK_FREE_ANNUAL) -> DataFrame:
    """Uniform draws from the weight simplex with return, volatility and Sharpe; ``weights`` is in order of names.

    A draw is a hash of (candidate, instrument).  A candidate's figures are mean and deviation of its own daily returns,
    which is the same as the sums over the covariance matrix and needs no matrix.
    """
    complete = materialise(complete_dates(returns, "log_return"), "returns")
    drawn = complete.select("ticker").distinct().withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    drawn = drawn.withColumn("e", -F.log(uniform(F.concat_ws(":", "candidate", "ticker"))))
    cells = F.array_sort(F.collect_list(F.struct("ticker", "e")))
    vectors = drawn.groupBy("candidate").agg(cells.alias("cells"), F.sum("e").alias("total"))
    vectors = materialise(
        vectors.select(F.col("candidate").alias("portfolio"), F.transform("cells", lambda c: c["e"] / F.col("total")).alias("weights")), "weights"
    )
    moments = portfolio_returns(vectors, complete).groupBy("portfolio").agg(
        (F.avg("ret") * ANNUAL).alias("ret"), (F.stddev_samp("ret") * F.sqrt(F.lit(ANNUAL))).alias("vol")
    )
    whole = vectors.join(moments, "portfolio")
    return _with_sharpe(whole.select(F.col("portfolio").alias("candidate"), "weights", "ret", "vol"), rf)


def best_portfolios(candidates: DataFrame, returns: DataFrame) -> DataFrame:
    """The highest Sharpe and the lowest volatility, the earlier candidate on ties."""
    row = F.struct("candidate", "weights", "ret", "vol", "sharpe")
    picked = candidates.agg(
        F.max_by(row, F.struct("sharpe", -F.col("candidate"))).alias("max_sharpe"),
        F.min_by(row, F.struct("vol", "candidate")).alias("min_volatility"),
    )
    both = F.array(
        F.struct(F.lit("max_sharpe").alias("portfolio"), F.col("max_sharpe").alias("p")),
        F.struct(F.lit("min_volatility").alias("portfolio"), F.col("min_volatility").alias("p")),
    )
    names = returns.agg(F.array_sort(F.collect_set("ticker")).alias("names"))
    out = picked.select(F.inline(both)).select("portfolio", "p.*").join(F.broadcast(names))
    return out.select(
        "portfolio", "candidate", F.round("ret", 4).alias("expected_return"), F.round("vol", 4).alias("volatility"),
        F.round("sharpe", 4).alias("sharpe_ratio"), F.inline(F.arrays_zip(F.col("names").alias("ticker"), F.transform("weights", lambda w: F.round(w, 4)).alias("weight"))).alias("ticker", "weight"),
    )


def efficient_frontier(candidates: DataFrame, points: int = 50) -> DataFrame:
    """The ``points`` lowest distinct volatilities (four digits) with the first candidate of each."""
    df = candidates.select(
        "candidate", F.round("ret", 4).alias("return"), F.round("vol", 4).alias("volatility"), F.round("sharpe", 4).alias("sharpe")
    )
    first = df.groupBy("volatility").agg(F.min_by(F.struct("return", "sharpe"), "candidate").alias("r"))
    return first.select("volatility", "r.*").orderBy("volatility").limit(points)
