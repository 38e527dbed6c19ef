"""Vectors as short codes: product codebooks fitted by ball k-means in whole numbers.

A vector is cut into parts and every part position has its own codebook.  The first assignment compares each part with
all entries.  Later ones start from the assignment before: an entry and its parts form a ball, whose radius says which
other entries are neighbours at all; a part nearer to its entry than half-way to the nearest neighbour is in the stable
core and keeps its entry unread; any other lies in a ring around the entry, and the ring's number is the number of
neighbours, nearest first, that are compared exactly.  Components are whole numbers, so the half-way test is one on
squared distances (d(a, j)^2 <= 4 d(x, a)^2), ties included, and codes equal those of a full search.

Rows stay where they are.  A round reads a table of components and codes, reduces it to one row of sums per task and
entry, adds those up and writes the next codes.  The driver sees the codebooks alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import written

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components beyond this (x beyond 2**18) count as this, so that all squares and their sums stay whole in 64 bits.
LARGEST = 1 << 26
#: Up to so many labels their sums are broadcast; beyond, they are joined by label.
FEW_LABELS = 20_000
#: A label with more than this share of the rows is hot.  There are fewer than 1 / share of them.
HOT_SHARE = 0.001


@dataclass(frozen=True)
class Codebooks:
    """Entries of all parts (part, entry, component), and per part and entry the radius of its ball."""

    entries: np.ndarray
    radius: np.ndarray | None = None

    @property
    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def neighbours(self) -> tuple[np.ndarray, np.ndarray]:
        """Per part and entry the other entries, nearest first, and their squared distances; those outside the ball's
        reach are set so far that no ring holds them."""
        parts, k, _ = self.entries.shape
        far = np.iinfo(np.int64).max
        order, dist = np.zeros((parts, k, k), np.int64), np.full((parts, k, k), far)
        for p, e in enumerate(self.entries):
            d = ((e[:, None, :] - e[None, :, :]) ** 2).sum(axis=2)
            np.fill_diagonal(d, -1)
            order[p] = np.argsort(d, axis=1, kind="stable")
            dist[p] = np.take_along_axis(d, order[p], axis=1)
            if self.radius is not None:
                dist[p][dist[p] > 4 * self.radius[p][:, None] ** 2] = far
        return order[:, :, 1:], dist[:, :, 1:]


def usable(vector: Column) -> Column:
    """A vector without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(vector: Column) -> Column:
    """Components as whole numbers: floor(256 x)."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * 256), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def nearest_of_all(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row and its squared distance, by comparing with every entry."""
    best, dist = np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
    for j, e in enumerate(entries):
        d = ((x - e) ** 2).sum(axis=1)
        nearer = d < dist
        best[nearer], dist[nearer] = j, d[nearer]
    return best, dist


def nearest_by_balls(
    x: np.ndarray, before: np.ndarray, entries: np.ndarray, order: np.ndarray, dist: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entry of each row from the one before, its squared distance, and how many distances were computed."""
    own = ((x - entries[before]) ** 2).sum(axis=1)
    ring = np.zeros(len(x), np.int64)
    by_entry = np.argsort(before, kind="stable")
    for rows in np.split(by_entry, np.flatnonzero(np.diff(before[by_entry])) + 1):
        if len(rows):
            ring[rows] = np.searchsorted(dist[before[rows[0]]], 4 * own[rows], side="right")
    best, least, computed = before.copy(), own.copy(), len(x)
    rows, step = np.flatnonzero(ring > 0), 0
    while len(rows):
        j = order[before[rows], step]
        d = ((x[rows] - entries[j]) ** 2).sum(axis=1)
        computed += len(rows)
        better = (d < least[rows]) | ((d == least[rows]) & (j < best[rows]))
        best[rows[better]], least[rows[better]] = j[better], d[better]
        step += 1
        rows = rows[ring[rows] > step]
    return best, least, computed


def _components(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("x")
    width = len(lists[0]) if len(lists) else 0
    return np.asarray(lists.flatten()).astype(np.int64).reshape(len(lists), width)


def _codes(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)


def _assign(books: Codebooks, known: bool):
    """Rows with the code of each part's nearest entry, and the sum of squared distances."""
    order, dist = books.neighbours() if known else (None, None)
    parts = len(books.entries)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _components(batch).reshape(batch.num_rows, parts, -1)
            before = _codes(batch, parts) if known else None
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                if known:
                    best, d, _ = nearest_by_balls(x[:, p], before[:, p], books.entries[p], order[p], dist[p])
                else:
                    best, d = nearest_of_all(x[:, p], books.entries[p])
                codes[:, p] = best
                error += d
            raw = codes.tobytes()
            cells = [raw[i : i + parts] for i in range(0, len(raw), parts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), batch.column("x"), pa.array(cells, pa.binary()), pa.array(error)],
                names=["id", "label", "x", "code", "error"],
            )

    return look


def _sums(books: Codebooks):
    """Per task, part and entry: count, sum of each component, largest squared distance."""
    parts, k, width = books.entries.shape

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums, far = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, codes = _components(batch).reshape(batch.num_rows, parts, -1), _codes(batch, parts)
            for p in range(parts):
                np.add.at(count[p], codes[:, p], 1)
                np.add.at(sums[p], codes[:, p], x[:, p])
                np.maximum.at(far[p], codes[:, p], ((x[:, p] - books.entries[p][codes[:, p]]) ** 2).sum(axis=1))
        at = np.argwhere(count > 0)
        p, e = at[:, 0], at[:, 1]
        yield pa.RecordBatch.from_arrays(
            [pa.array(p), pa.array(e), pa.array(count[p, e]), pa.array(far[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "far", "sums"],
        )

    return look


def _moved(state: DataFrame, books: Codebooks) -> Codebooks:
    """Entries at the floored mean of their parts; unused ones stay.  A ball's radius grows by its entry's step at most."""
    parts, k, width = books.entries.shape
    rows = state.mapInArrow(_sums(books), "part long, entry long, n long, far long, sums array<long>")
    total = rows.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.max("far").alias("far"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    )
    entries, radius = books.entries.copy(), np.zeros((parts, k), np.int64)
    for r in total.collect():  # at most parts x entries rows
        p, e = r["part"], r["entry"]
        entries[p, e] = [s // r["n"] for s in r["sums"]]
        step = int(((entries[p, e] - books.entries[p, e]) ** 2).sum())
        radius[p, e] = math.isqrt(r["far"]) + math.isqrt(step) + 2
    return Codebooks(entries, np.minimum(radius, 1 << 30))


def fit_and_encode(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """Columns id, label, x (whole components, all of one length that ``parts`` divides) to id, label, code, error.

    Codebooks start from the rows with the smallest ids (repeated ids by their components, null ids last); with fewer
    rows than ``entries`` they are as short as the table.
    """
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    if not first:
        return rows.select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), None
    start = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(start))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"id {kinds['id']}, label {kinds['label']}, x array<int>, code binary, error long"
    state = written(rows.mapInArrow(_assign(books, known=False), schema), "codes")
    for _ in range(rounds):
        books = _moved(state, books)
        state = written(state.mapInArrow(_assign(books, known=True), schema), "codes")
    return state.drop("x"), books


def with_label_sums(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels (null is one label).

    Few labels are broadcast by their count.  Of many, the hot ones are (fewer than 1 / HOT_SHARE by arithmetic), and
    the rest are joined by label, where rows of hot labels are dealt by their ids instead.
    """
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    sums = written(sums.withColumn("found", F.lit(True)).withColumnRenamed("label", "sum_label"), "label-sums")
    labels, total = sums.agg(F.count(F.lit(1)), F.sum("n")).first()
    if labels <= FEW_LABELS:
        return coded.join(F.broadcast(sums.select("sum_label", "label_error")), F.col("label").eqNullSafe(F.col("sum_label"))).drop("sum_label")
    hot = sums.where(F.col("n") > HOT_SHARE * total).select("sum_label", F.col("label_error").alias("hot_error"), "found")
    near = coded.join(F.broadcast(hot), F.col("label").eqNullSafe(F.col("sum_label")), "left").drop("sum_label")
    key = lambda label: F.concat_ws(":", label.isNull().cast("string"), label.cast("string"))
    near = near.withColumn("sum_key", F.when(F.col("found"), F.concat(F.lit("id:"), F.xxhash64("id", "code"))).otherwise(key(F.col("label"))))
    rest = sums.where(F.col("n") <= HOT_SHARE * total).select(key(F.col("sum_label")).alias("sum_key"), "label_error")
    return near.join(rest, "sum_key", "left").withColumn("label_error", F.coalesce("hot_error", "label_error")).drop("hot_error", "found", "sum_key")


def encode_vectors(
    table: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """id, code (two hex digits a part), error, label_error, codebooks_sha256, one row per row with a usable vector.

    Rows with a null vector, null or non-finite components go.  Vectors that are empty, or that differ in length from
    the most frequent length that ``parts`` divides (ties: the longest), cannot be cut alike and keep their row with
    null code and error; label_error leaves them out, so it is null where a label has no others.  Null labels are one
    label; null and repeated ids are allowed, and each repeated row is coded.  Components beyond 2**18 count as that.
    An empty table gives an empty result.  Only the three named columns are read.
    """
    if entries > 256:
        raise ValueError("a code has one byte per part: 256 entries at most")
    ids, labels = table.schema[id_column].dataType, table.schema[label_column].dataType
    vector = table[vector_column]
    rows = table.where(usable(vector)).select(table[id_column].alias("id"), table[label_column].alias("label"), whole(vector).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("width")).count().where((F.col("width") > 0) & (F.col("width") % parts == 0))
    usual = lengths.orderBy(F.desc("count"), F.desc("width")).limit(1).collect()
    width = usual[0]["width"] if usual else 0
    coded, books = fit_and_encode(rows.where(F.size("x") == width) if width else rows.where(F.lit(False)), parts, entries, rounds)
    odd = rows.where(F.size("x") != (width or -1)).select("id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"))
    out = with_label_sums(coded.unionByName(odd))
    return out.select(
        F.col("id").cast(ids).alias(id_column),
        F.lower(F.hex("code")).alias("code"),
        "error",
        "label_error",
        F.lit(books.digest if books else None).cast("string").alias("codebooks_sha256"),
        F.col("label").cast(labels).alias(label_column),
    )
