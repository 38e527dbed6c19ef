"""Order-dependent work on keys without a size bound.

A request log may give a third of its rows to one key, or most of them to one
second, so neither a window per key nor one per stretch of time is an option.
Rows are dealt by ranges of (key, order), which Spark cuts by row counts; sums
run inside a range and start from the sums of the ranges before it.  Numbered
rows are cut into blocks that carry a copy of the few rows before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.session import materialise


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table with fewer splits than cores, dealt to all cores; a table of many splits stays where it is.

    For work that costs far more per row than moving the row.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if not df.isStreaming and df.rdd.getNumPartitions() < cores else df


def running_sum(df: DataFrame, key: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to this one, by ``order``.

    ``order`` should tell rows apart; equal rows may be summed in any order.  The
    ranges are written to the shared folder, since sums within and before a range
    must see the same cut.
    """
    names = [f"_o{i}" for i in range(len(order))]
    df = df.withColumns({**dict(zip(names, order)), "_v": value})
    ranged = materialise(df.repartitionByRange(key, *names).withColumn("_part", F.spark_partition_id()))
    upto = Window.partitionBy(key).orderBy("_part")  # one row per range
    before = (
        ranged.groupBy(key, "_part").agg(F.sum("_v").alias("_sum"))
        .select(F.col(key).alias("_key"), F.col("_part").alias("_at"), (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"))
    )
    inside = Window.partitionBy(key, "_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.withColumn(name, F.sum("_v").over(inside))
    out = out.join(before, out[key].eqNullSafe(before["_key"]) & (out["_part"] == before["_at"]))
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_v", "_part", "_key", "_at", "_before", *names)


def with_ordinal(
    df: DataFrame, key: str, order: Column, tiebreak: str, name: str = "seq", newest_first: bool = False
) -> DataFrame:
    """0-based position of every row within its key, by ``order`` then ``tiebreak`` (both numbers)."""
    ends = [order, F.col(tiebreak)]
    out = running_sum(df, key, [-c for c in ends] if newest_first else ends, F.lit(1).cast("bigint"), name)
    return out.withColumn(name, F.col(name) - 1)


def rolling_rows(df: DataFrame, key: str, seq: str, back: int, block: int, columns) -> DataFrame:
    """Add ``columns(window)`` over the last ``back + 1`` rows of the key.

    Every block of ``block`` rows gets a copy of the ``back`` rows before it, so
    the blocks of one key run in parallel and see the same frames.
    """
    own = F.floor(F.col(seq) / block)
    shared = F.col(seq) % block >= block - back
    df = df.withColumn("_blk", F.explode(F.when(shared, F.array(own, own + 1)).otherwise(F.array(own))))
    frame = Window.partitionBy(key, "_blk").orderBy(seq).rowsBetween(-back, 0)
    return df.withColumns(columns(frame)).where(F.col("_blk") == own).drop("_blk")


def trailing_count(df: DataFrame, key: str, micros: Column, span: int, row_id: str, name: str) -> DataFrame:
    """Add the number of rows of the key in the trailing ``span`` microseconds, peers included.

    Calls up to now less calls before the window: each row sets one mark where
    its window begins and one where it ends, and a mark takes the running count
    of rows.  Three rows a row, however many share a window.  ``row_id`` tells
    the rows of a key apart.
    """
    df = df.withColumn("_t", micros)
    marks = F.array(
        F.struct((F.col("_t") - span).alias("at"), F.lit(0).alias("kind")),
        F.struct(F.col("_t").alias("at"), F.lit(1).alias("kind")),
        F.struct(F.col("_t").alias("at"), F.lit(2).alias("kind")),
    )
    marked = df.select(key, row_id, F.inline(marks))
    summed = running_sum(
        marked, key, [F.col("at"), F.col("kind"), F.col(row_id)], (F.col("kind") == 1).cast("bigint"), "_rows"
    )
    sign = F.when(F.col("kind") == 2, F.col("_rows")).when(F.col("kind") == 0, -F.col("_rows")).otherwise(0)
    counts = summed.groupBy(key, row_id).agg(F.sum(sign).alias(name))
    return df.drop("_t").join(counts, [key, row_id])
