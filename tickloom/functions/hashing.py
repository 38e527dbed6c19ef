"""Repeatable pseudo-random columns: the same draw on any cluster and after any retry."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_bits(key: Column, part: int = 0) -> Column:
    """32 bits of the key's md5 digest as a bigint; ``part`` picks one of four."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1 + 8 * part, 8), 16, 10).cast("bigint")


def uniform(key: Column, part: int = 0) -> Column:
    """A number strictly between 0 and 1."""
    return (uniform_bits(key, part) + 0.5) / float(2**32)


def bits_value(key: str) -> int:
    """The bits of ``uniform_bits``, for code inside a task."""
    return int(hashlib.md5(key.encode()).hexdigest()[:8], 16)


def uniform_value(key: str) -> float:
    """The draw of ``uniform``, for code inside a task."""
    return (bits_value(key) + 0.5) / 2**32


def normal(key: Column) -> Column:
    """A standard normal draw (Box-Muller over two parts of one digest)."""
    radius = F.sqrt(-2.0 * F.log(uniform(key, 0)))
    return radius * F.cos(2.0 * math.pi * uniform(key, 1))
