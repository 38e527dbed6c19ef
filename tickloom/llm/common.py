"""Small shared parts: tables, words, free column names, the shared folder."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.session import materialise

#: A word: digits, lower-case ASCII letters and everything outside ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


#: Rows that go to a Python worker at once.  Texts are long; Spark's default of 10,000 rows makes workers large.
ROWS_PER_BATCH = 1_000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_text(text: Column) -> Column:
    """The words of a text joined by one space; null counts as empty."""
    return F.trim(F.regexp_replace(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD, " "))


def words_of(text: str | None) -> list[bytes]:
    """The same words inside a task, as UTF-8.  Every byte of a non-ASCII character is a word byte."""
    if not text:
        return []
    return _WORD_BYTES.findall(text.encode("utf-8", "replace").lower())


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame does not use yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = f"__{wanted}"
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: a lost executor costs a read, not a recomputation."""
    return materialise(df, name)


def word_count(text: Column) -> Column:
    """Number of words of a text, from the edges of its runs of word bytes."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                inside = _BYTE_CLASS[np.frombuffer((t or "").encode("utf-8", "replace").lower(), np.uint8)]
                out.append(int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(bool(len(inside) and inside[0])))
            yield pd.Series(out, dtype="int64")

    return F.pandas_udf(look, "long")(text)


# --- hashed words of many texts at once -------------------------------------------------------------------------

_BYTE_CLASS = np.zeros(256, dtype=bool)
_BYTE_CLASS[ord("0") : ord("9") + 1] = True
_BYTE_CLASS[ord("a") : ord("z") + 1] = True
_BYTE_CLASS[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INVERSE = np.uint64(pow(int(_P), -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (shift, multiply), in place on a copy."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, modulo 2**64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for key, base in (("up", _P), ("down", _P_INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[key] = np.multiply.accumulate(out)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: Texts are hashed in blocks of about so many bytes, so the arrays stay small.
BLOCK_BYTES = 1 << 18


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts, and where each text starts (one entry more than texts)."""
    hashes, counts = [], np.zeros(len(texts), dtype=np.int64)
    block, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace").lower()
        block.append(raw)
        size += len(raw) + 1
        if size >= BLOCK_BYTES or i == len(texts) - 1:
            h, _, _, owner = hash_runs(block, _BYTE_CLASS)
            hashes.append(h)
            counts[first : i + 1] = np.bincount(owner, minlength=len(block))
            block, size, first = [], 0, i + 1
    starts = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(counts, out=starts[1:])
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), starts


def hash_runs(block: list[bytes], inside_class: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of the class's bytes in texts laid end to end, a line feed after each:
    hash, begin, end, number of the text."""
    raw = np.frombuffer(b"\n".join(block) + b"\n", dtype=np.uint8)
    inside = inside_class[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    begin, end = edges[0::2], edges[1::2]
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    h = mix((sums[end] - sums[begin]) * down[begin])
    ends = np.cumsum(np.fromiter((len(b) + 1 for b in block), dtype=np.int64, count=len(block)))
    return h, begin, end, np.searchsorted(ends, begin, side="right")


def shingles(hashes: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words per text, and the starts; a shorter text with words has one of all its words."""
    counts = np.diff(starts)
    rows = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    out_starts = np.zeros(len(counts) + 1, dtype=np.int64)
    np.cumsum(rows, out=out_starts[1:])
    total = int(out_starts[-1])
    if total == 0:
        return np.zeros(0, np.uint64), out_starts
    owner = np.repeat(np.arange(len(counts)), rows)
    at = starts[owner] + (np.arange(total) - out_starts[owner])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    end = starts[owner + 1]
    out = np.zeros(total, dtype=np.uint64)
    for k in range(n):
        word = np.where(at + k < end, padded[at + k], np.uint64(0))
        out = mix(out * np.uint64(0xD1342543DE82EF95) + word + np.uint64(k + 1))
    return out, out_starts


