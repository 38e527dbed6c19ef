"""Result sinks: nested records as parquet or JSON, non-finite numbers as null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.series import finite_or_null


def sanitise(df: DataFrame, digits: int | None = 4) -> DataFrame:
    """Turn NaN and infinities of every floating column into null and round the rest."""
    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = finite_or_null(col)
            col = F.round(col, digits) if digits is not None else col
        out.append(col.alias(field.name))
    return df.select(*out)


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """Keys plus one JSON document holding every other column."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest)).alias("record"))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = sanitise(df, None).write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
