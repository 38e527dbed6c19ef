"""Shards along a Hilbert curve over several metadata columns, with DataFrame operations only.

Each dimension is quantised to ``bits`` bits, the cell's curve index comes from a constant of all cells (at most
2**15), rows are ordered by (index, hash bucket of the id, id) and the order is cut into runs of equal
row counts.  Neighbouring cells share a shard, so a filter on any of the dimensions skips whole shards.

Positions need no global sort: a count per (cell, bucket) is summed up along the order, and a row adds its number
within its own (cell, bucket).  A cell that holds a third of all rows is dealt over buckets, whose number grows with
the table.
"""

from __future__ import annotations

import os.path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import free_name

MOST_CELL_BITS = 15
#: A bucket of a cell that held all rows would have about so many.
BUCKET_ROWS = 50_000


#: Bytes of a string, after the prefix that all share, that its order is taken from.
STRING_BYTES = 7
#: Quantiles are right to about one row in so many.
QUANTILE_ACCURACY = 10_000


def quantised(df: DataFrame, columns: list[str], bits: int) -> tuple[list[Column], int]:
    """A coordinate of ``bits`` bits per column, and the number of rows.

    Coordinates follow rows, not values: a column of up to 2**bits values has a step for each, any other is cut at
    quantiles, so that every step holds about as many rows.  Both keep the order of values.  Null counts as the least.
    """
    parts = [F.count(F.lit(1))]
    for c in columns:
        parts += [F.min(df[c]), F.max(df[c])]
    rows, *ends = df.agg(*parts).first()
    keys = []
    for k, c in enumerate(columns):
        numeric = isinstance(df.schema[c].dataType, T.NumericType)
        keys.append(df[c].cast("double") if numeric else _string_key(df[c].cast("string"), *map(str, ends[2 * k : 2 * k + 2])))
    cells, out = 1 << bits, []
    cuts: list[list | None] = []
    for key in keys:
        values = df.select(key.alias("v")).where("v is not null").distinct().limit(cells + 1).collect()
        cuts.append(sorted(r["v"] for r in values) if len(values) <= cells else None)
    shares = [k / cells for k in range(1, cells)]
    wide = {f"q{k}": F.percentile_approx(key, shares, QUANTILE_ACCURACY) for k, key in enumerate(keys) if cuts[k] is None}
    quantiles = df.agg(*[c.alias(n) for n, c in wide.items()]).first().asDict() if wide else {}
    for k, key in enumerate(keys):
        if cuts[k] is None:
            steps = [(v, 1) for v in quantiles[f"q{k}"]]
        else:
            n = len(cuts[k])
            places = [i * cells // n for i in range(n)]
            steps = [(v, b - a) for v, a, b in zip(cuts[k], [0, *places], places, strict=False)]
        place = F.lit(0)
        for value, step in steps:
            if step:
                place = place + F.when(key >= F.lit(value), step).otherwise(0)
        out.append(F.coalesce(place, F.lit(0)).cast("int"))
    return out, rows


def _string_key(value: Column, low: str, high: str) -> Column:
    """The bytes after the prefix that least and greatest share, as a number in the order of strings."""
    shared = len(os.path.commonprefix([low.encode(), high.encode()]))
    digits = F.rpad(F.hex(F.substring(F.encode(value, "UTF-8"), shared + 1, STRING_BYTES)), 2 * STRING_BYTES, "0")
    return F.conv(digits, 16, 10).cast("long")


def curve_index(point: list[int], bits: int) -> int:
    """Index of a cell on the Hilbert curve: undo the rotations bit by bit, then Gray-decode (Skilling, 2004)."""
    x = list(point)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for k in range(len(x)):
            if x[k] >> b & 1:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[k]) & low
                x[0] ^= swap
                x[k] ^= swap
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    flip = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            flip ^= (1 << b) - 1
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v ^ flip) >> b & 1
    return out


def curve_of(coordinates: list[Column], bits: int) -> Column:
    """Curve index of the cell of these coordinates, looked up by position in a constant of two bytes a cell."""
    d = len(coordinates)
    if d * bits > MOST_CELL_BITS:
        raise ValueError(f"{d} dimensions of {bits} bits give more than 2**{MOST_CELL_BITS} cells")
    mask = (1 << bits) - 1
    cells = ([code >> bits * (d - 1 - k) & mask for k in range(d)] for code in range(1 << d * bits))
    constant = bytearray(b"".join(curve_index(cell, bits).to_bytes(2, "big") for cell in cells))
    code = F.lit(0)
    for c in coordinates:
        code = code * (1 << bits) + c
    return F.conv(F.hex(F.substring(F.lit(constant), code * 2 + 1, F.lit(2))), 16, 10).cast("int")


def hilbert_shards(
    df: DataFrame,
    dimensions: list[str],
    n_shards: int = 8,
    bits: int = 4,
    spread: int | None = None,
    id_column: str = "doc_id",
    salt: tuple[str, ...] = (),
) -> DataFrame:
    """The rows with ``curve``, ``position`` (0 ...), ``shard`` and ``slot`` (gapless from 0 in each shard).

    Row counts of shards differ by one at most.  Null metadata counts as the least value, null ids come first in their
    bucket, equal rows stand beside each other in any order.  Columns of those four names are replaced; others are
    kept.  An empty table stays empty.  Rows of one cell are dealt over ``spread`` buckets (by default one for each
    BUCKET_ROWS rows of the table) by a hash of the id and the columns of ``salt``, which tell rows of one id apart.
    """
    df = df.drop("curve", "position", "shard", "slot")
    coordinates, rows = quantised(df, dimensions, bits)
    spread = spread or max(256, rows // BUCKET_ROWS)
    bucket = free_name(df, "bucket")
    dealt = F.pmod(F.xxhash64(df[id_column], *[df[c] for c in salt]), F.lit(spread)).cast("int")
    placed = df.withColumns({"curve": curve_of(coordinates, bits), bucket: dealt})
    counts = placed.groupBy("curve", bucket).agg(F.count(F.lit(1)).alias("n"))
    per_cell = counts.groupBy("curve").agg(F.sum("n").alias("n_cell"))  # one row per cell at most
    before_cell = per_cell.select(
        F.col("curve").alias("cell"),
        (F.sum("n_cell").over(Window.orderBy("curve")) - F.col("n_cell")).alias("before_cell"),
    )
    along = Window.partitionBy("curve").orderBy(bucket)
    offsets = (
        counts.withColumn("before", F.sum("n").over(along) - F.col("n"))
        .join(F.broadcast(before_cell), F.col("curve") == F.col("cell"))
        .select(F.col("curve").alias("g_curve"), F.col(bucket).alias("g_bucket"), (F.col("before") + F.col("before_cell")).alias("g_offset"))
    )
    others = [df[c] for c in (*dimensions, *salt)]
    number = F.row_number().over(Window.partitionBy("curve", bucket).orderBy(df[id_column], *others)).cast("long")
    within = free_name(df, "within")
    located = placed.withColumn(within, number - 1).join(
        offsets, (F.col("curve") == F.col("g_curve")) & (F.col(bucket) == F.col("g_bucket"))
    )
    rows = max(rows, 1)
    return (
        located.withColumn("position", F.col("g_offset") + F.col(within))
        .drop("g_curve", "g_bucket", "g_offset", within, bucket)
        .withColumn("shard", F.expr(f"position * {n_shards}L div {rows}L").cast("int"))
        .withColumn("slot", F.expr(f"position - (shard * {rows}L + {n_shards - 1}L) div {n_shards}L"))
    )


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, rows along the curve, so that the files' column statistics are narrow."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
