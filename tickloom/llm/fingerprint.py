"""Document fingerprints by MinHash, with a banded join of near documents.

A fingerprint is the minimum of many universal hash functions over a text's word shingles, computed in numpy; the
share of equal entries estimates the Jaccard coefficient.  ``near_texts`` joins the signatures' bands of two tables and
verifies the candidates on the shingle sets, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import hashed_words, shingles, written
from tickloom.llm.minhash import band_keys, bands_for, raw_gram, signatures
from tickloom.llm.ngram_join import word_key

FUNCTIONS, WORDS, THRESHOLD, RECALL = 128, 5, 0.8, 0.995
#: A bucket of consecutive ids holds about so many characters of text.
BUCKET_CHARS = 4_000_000
MOST_BUCKETS = 20_000
#: Texts of either side that a tile of the search compares.
BLOCK = 256


def printed(signature: np.ndarray) -> list[str]:
    """Fingerprints as text: the low 16 bits of every minimum, four hexadecimal digits each."""
    return [row.tobytes().hex() for row in (signature & np.uint32(0xFFFF)).astype(">u2")]


def fingerprint(text: Column, functions: int = FUNCTIONS, words: int = WORDS) -> Column:
    """Fingerprint of a text; null counts as empty, and an empty text has ``f`` throughout."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                out += printed(signatures(texts.iloc[at : at + 512].tolist(), functions, words))
            yield pd.Series(out)

    return F.pandas_udf(look, "string")(text.cast("string"))


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal printed entries of two arrays of signatures."""
    return ((a & np.uint32(0xFFFF)) == (b & np.uint32(0xFFFF))).mean(axis=1)


# --- neighbours in the order of ids -----------------------------------------------------------------------------


def id_buckets(rows: DataFrame, bucket_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut points between buckets of consecutive keys, and the least key of every bucket that has rows.

    Both are bounded by MOST_BUCKETS.  Keys are cut at approximate quantiles, so buckets are about equally large.
    """
    n, chars = rows.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    buckets = min(MOST_BUCKETS, max(1, -(-(chars or 0) // bucket_chars)))
    cuts = []
    if n and buckets > 1:
        cuts = rows.agg(F.percentile_approx("key", [k / buckets for k in range(1, buckets)], 10 * buckets)).first()[0]
    cuts = np.array(sorted(set(cuts)), np.int64)
    least = rows.groupBy(_placed(cuts, None)("key").alias("p")).agg(F.min("key").alias("first")).collect()
    return cuts, np.array(sorted(r["first"] for r in least), np.int64)


def _placed(cuts: np.ndarray, first: np.ndarray | None):
    """A key's bucket (cut points at or below it), and the buckets it is copied to: the one before, if it begins one."""
    if first is None:
        return F.pandas_udf(lambda keys: pd.Series(np.searchsorted(cuts, keys.to_numpy(), side="right")), "long")
    hosts = np.searchsorted(cuts, np.roll(first, 1), side="right")

    def look(keys: pd.Series) -> pd.Series:
        keys = keys.to_numpy()
        own = np.searchsorted(cuts, keys, side="right")
        at = np.minimum(np.searchsorted(first, keys), len(first) - 1)
        begins = first[at] == keys
        return pd.Series([[o, h] if f else [o] for o, h, f in zip(own.tolist(), hosts[at].tolist(), begins.tolist(), strict=True)])

    return F.pandas_udf(look, "array<long>")


def with_next(docs: DataFrame, id_column: str, text_column: str, bucket_chars: int = BUCKET_CHARS) -> tuple[DataFrame, int]:
    """(bucket, guest, key, id, text), to be dealt by bucket so that each row's next stands below it.

    The first row of a bucket is also a guest at the end of the one before, the very first of the last: one text more
    per bucket.  Key: the id, null before all others.
    """
    rows = docs.select(
        F.coalesce(docs[id_column].cast("long"), F.lit(-(1 << 63))).alias("key"),
        docs[id_column].alias("id"),
        F.coalesce(docs[text_column].cast("string"), F.lit("")).alias("text"),
    )
    cuts, first = id_buckets(rows, bucket_chars)
    if not len(first):
        return rows.select(F.lit(0).alias("bucket"), F.lit(False).alias("guest"), "key", "id", "text"), 1
    placed = rows.withColumn("buckets", _placed(cuts, first)("key"))
    return placed.select(F.posexplode("buckets").alias("guest", "bucket"), "key", "id", "text").select(
        "bucket", (F.col("guest") == 1).alias("guest"), "key", "id", "text"
    ), len(first)


def compare_with_next(
    docs: DataFrame,
    functions: int = FUNCTIONS,
    words: int = WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    bucket_chars: int = BUCKET_CHARS,
) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row per row.

    The edited text has the last quarter of its code points (rounded down) replaced by as many first ones, or all, of
    the next row's text.  Next is the next row in the order of ids (null first; equal ids by text, null as empty), and
    the first after the last; a single row is its own next.  Null texts count as empty; two empty texts are alike (1).
    An empty table gives an empty result.  Ids are integers.  Each text is shuffled once.
    """
    id_type = docs.schema[id_column].dataType
    schema = T.StructType(
        [
            T.StructField(id_column, id_type),
            T.StructField("n_chars", T.LongType()),
            T.StructField("edited_sha256", T.StringType()),
            T.StructField("fingerprint", T.StringType()),
            T.StructField("edited_fingerprint", T.StringType()),
            T.StructField("near_edited", T.DoubleType()),
            T.StructField("near_next", T.DoubleType()),
        ]
    )
    placed, buckets = with_next(docs, id_column, text_column, bucket_chars)
    dealt = placed.repartition(buckets, "bucket").sortWithinPartitions(
        "bucket", "guest", "key", "text"
    ).select("bucket", "guest", "id", "text")

    def compared(rows: list[tuple], id_kind) -> pa.RecordBatch:
        """All rows but the last, which is the next of the one before."""
        texts = [r[2] for r in rows]
        edited = []
        for text, following in zip(texts, texts[1:], strict=False):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + following[:cut])
        own, changed = signatures(texts, functions, words), signatures(edited, functions, words)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r in rows[:-1]], id_kind),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in edited], pa.string()),
                pa.array(printed(own[:-1]), pa.string()),
                pa.array(printed(changed), pa.string()),
                pa.array(likeness(own[:-1], changed), pa.float64()),
                pa.array(likeness(own[:-1], own[1:]), pa.float64()),
            ],
            names=schema.names,
        )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket, done = [], None, False  # done: the bucket's first guest has come
        for batch in batches:
            id_kind = batch.schema.field(2).type
            for at in range(0, batch.num_rows, 512):
                for b, guest, i, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    if b != bucket:
                        held, bucket, done = [], b, False
                    if done:
                        continue
                    held.append((b, i, text))
                    done = guest
                    if guest or len(held) > 256:
                        yield compared(held, id_kind)
                        held = held[-1:]

    return dealt.mapInArrow(look, schema)


# --- near documents ---------------------------------------------------------------------------------------------


def _bands_of(bands: int, rows: int, words: int):
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                out += band_keys(signatures(texts.iloc[at : at + 512].tolist(), bands * rows, words), bands, rows).tolist()
            yield pd.Series(out)

    return F.pandas_udf(look, "array<long>")


def _sets(words: int):
    """Sorted distinct shingle hashes of a text, 8 bytes each."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                grams, _ = shingles(*hashed_words([text]), words)
                out.append(np.unique(grams if len(grams) else raw_gram(text or "")).tobytes())
            yield pd.Series(out)

    return F.pandas_udf(look, "binary")


def tile_pairs(asking: list[dict], asked: list[dict], bucket: int, threshold: float) -> list[tuple[str, str, float]]:
    """Pairs between two blocks that are alike enough and have this bucket as the least of those they share."""
    if not asking or not asked:
        return []
    left = np.array([m["bands"] for m in asking], np.int64)
    right = np.array([m["bands"] for m in asked], np.int64)
    sets = [np.frombuffer(m["grams"], np.uint64) for m in asked]
    out, none = [], np.iinfo(np.int64).max
    for m, bands in zip(asking, left, strict=True):
        own = np.frombuffer(m["grams"], np.uint64)
        shared = np.where(right == bands[None, :], right, none).min(axis=1)
        for j in np.flatnonzero(shared == bucket).tolist():
            both = len(np.intersect1d(own, sets[j], assume_unique=True))
            jaccard = both / (len(own) + len(sets[j]) - both)
            if jaccard >= threshold:
                out.append((m["key"], asked[j]["key"], jaccard))
    return out


_PAIRS = T.StructType(
    [T.StructField("query_key", T.StringType()), T.StructField("key", T.StringType()), T.StructField("jaccard", T.DoubleType())]
)


def _pairs_of_tiles(threshold: float):
    """Rows sorted by tile, those that ask first; one tile at a time is held."""

    def result(members: list[dict]) -> pa.RecordBatch:
        sides = [[m for m in members if m["asks"] == s] for s in (True, False)]
        columns = list(zip(*tile_pairs(*sides, members[0]["bucket"], threshold), strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_PAIRS.names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, members = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    own = (row["bucket"], row["low"], row["high"])
                    if own != tile:
                        if members:
                            yield result(members)
                        tile, members = own, []
                    members.append(row)
        if members:
            yield result(members)

    return look


def near_nodes(
    queries: DataFrame,
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    block: int = BLOCK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(query_key, key, jaccard) of texts that are alike enough, and the members (query, query_key) and (id, key).

    Equal word sequences are one text on either side, so copies make no pairs; a pair of a key with itself stands for
    all its copies.  Texts meet in the buckets of their bands, of which those with the members of another are left
    out.  A bucket is cut into blocks of ``block`` texts of either side; a tile compares two of them, so a set travels
    once per block of queries it meets, and the Jaccard coefficient is taken on the whole sets.
    """
    bands, rows = bands_for(threshold, RECALL)

    def side(df: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        text = df[text_column].cast("string")
        base = df.select(df[id_column].alias("id"), word_key(text).alias("key"), text.alias("text"))
        marked = written(base.select("id", "key", _bands_of(bands, rows, words)("text").alias("bands")), "near-marks")
        nodes = marked.groupBy("key").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"))
        return base, marked.select("id", "key"), written(nodes, "near-nodes")

    sides = [side(queries), side(docs)]
    met = [nodes.select("key", F.explode("bands").alias("bucket")) for _, _, nodes in sides]

    def members(m: DataFrame, n: str) -> DataFrame:
        folds = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"{n}{k}") for k in range(2)]
        return m.groupBy("bucket").agg(F.count(F.lit(1)).alias(n), *folds)

    buckets = (
        members(met[0], "q")
        .join(members(met[1], "n"), "bucket")
        .groupBy("q", "q0", "q1", "n", "n0", "n1")
        .agg(F.min("bucket").alias("bucket"))
        .select("bucket", F.ceil(F.col("q") / block).alias("lows"), F.ceil(F.col("n") / block).alias("highs"))
    )
    buckets = written(buckets, "near-buckets")

    def tiles(k: int) -> DataFrame:
        base, _, nodes = sides[k]
        own, other = ("low", "high") if k == 0 else ("high", "low")
        dealt = met[k].join(buckets, "bucket").select(
            "key", "bucket", F.pmod(F.xxhash64("key", F.lit(2)), F.col(f"{own}s")).alias(own), F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        )
        dealt = written(dealt, "near-tiles")
        wanted = nodes.join(dealt.select("key").distinct(), "key", "left_semi").withColumnRenamed("key", "k")
        same = (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("first_id"))  # copies lie apart by their ids
        texts = base.join(wanted, same).select("key", "bands", "text").dropDuplicates(["key"])
        sets = texts.select("key", "bands", _sets(words)("text").alias("grams"))
        return dealt.join(sets, "key").select("bucket", "low", "high", F.lit(k == 0).alias("asks"), "key", "bands", "grams")

    rows_of_tiles = tiles(0).unionByName(tiles(1)).repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    pairs = written(rows_of_tiles.mapInArrow(_pairs_of_tiles(threshold), _PAIRS), "near-pairs")
    asking, asked = sides[0][1].toDF("query", "query_key"), sides[1][1]
    return pairs, asking, asked


def near_pairs(
    queries: DataFrame, docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(query, id, jaccard) of every query row and every document whose shingle sets are alike enough.

    ``queries`` is a stated set of rows; pairs are made between it and ``docs`` only.  Equal texts are pairs, too; rows
    without words match equal texts.  A row for each pair of copies is written out: ``near_texts`` has each text once.
    """
    pairs, asking, asked = near_nodes(queries, docs, threshold, words, id_column, text_column)
    return pairs.join(asking, "query_key").join(asked, "key").select("query", "id", "jaccard")


def near_texts(queries: DataFrame, docs: DataFrame, **options) -> DataFrame:
    """(query_key, query_id, n_queries, key, match_id, n_matches, jaccard): a row for each pair of texts alike enough.

    The ids are the least of the rows that share a text's words, the counts their number; a text of ``queries`` matches
    itself in ``docs``.  Null ids count, and stand for a text only if it has no other.  Null texts count as empty, and
    texts without words match equal texts alone.  Repeated rows count as copies; an empty table on either side gives
    an empty result; other columns are not read.
    """
    pairs, asking, asked = near_nodes(queries, docs, **options)
    left = asking.groupBy("query_key").agg(F.min("query").alias("query_id"), F.count(F.lit(1)).alias("n_queries"))
    right = asked.groupBy("key").agg(F.min("id").alias("match_id"), F.count(F.lit(1)).alias("n_matches"))
    return pairs.join(left, "query_key").join(right, "key").select(
        "query_key", "query_id", "n_queries", "key", "match_id", "n_matches", "jaccard"
    )
