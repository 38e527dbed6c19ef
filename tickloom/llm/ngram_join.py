"""Similarity join of documents on the Jaccard coefficient of their word n-gram sets, by MinHash banding.

Equal word sequences are one node.  Nodes meet in band buckets whose numbers of bands and rows follow from the target
recall.  A bucket whose members are those of an earlier band is left out, and a pair is compared only in the first
band in which it meets, so the sets travel about once.  Large buckets are dealt into blocks, and pairs of blocks are
tiles of bounded size that run in parallel; no row is made for a pair that is not needed: a tile gives every member's
number of links and a spanning forest of the links.  Links are verified on the full sets.  Classes are the connected
components, by repeated contraction of edges in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import free_name, hashed_words, shingles, words_text, written
from tickloom.llm.minhash import band_keys, bands_for, raw_gram, signatures
from tickloom.session import delete_path, shared_path

THRESHOLD, WORDS, RECALL = 0.8, 5, 0.995
#: Members of a block; a tile compares two blocks.
BLOCK = 256


def word_key(text: Column) -> Column:
    """Equal for texts of equal words; texts without words by their characters."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = words_text(text)
    return F.md5(F.when(words == "", F.concat(F.lit("\n"), text)).otherwise(words).cast("binary"))


def _bands(bands: int, rows: int, words: int):
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for at in range(0, len(texts), 512):
                out += band_keys(signatures(texts.iloc[at : at + 512].tolist(), bands * rows, words), bands, rows).tolist()
            yield pd.Series(out)

    return F.pandas_udf(look, "array<long>")


def _grams(words: int):
    """Sorted distinct n-gram hashes of a text, 8 bytes each."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                grams, _ = shingles(*hashed_words([text]), words)
                out.append(np.unique(grams if len(grams) else raw_gram(text or "")).tobytes())
            yield pd.Series(out)

    return F.pandas_udf(look, "binary")


# --- tiles ------------------------------------------------------------------------------------------------------


def owned_pairs(bands: np.ndarray, block: np.ndarray, low: int, high: int, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that meet first in this band: between its two blocks, or within its only one."""
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    earlier = np.zeros((len(left), len(right)), bool)
    for k in range(band):
        earlier |= bands[left, k][:, None] == bands[right, k][None, :]
    a, b = np.nonzero(~earlier)
    a, b = left[a], right[b]
    return (a, b) if low != high else (a[a < b], b[a < b])


def common_grams(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets a[i] and b[i]."""
    if len(a) <= 2 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)), np.int64, len(a))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.cumsum(counts > 1) - 1  # only grams that two sets have matter
    use = counts[column] > 1
    owner, column = owner[use], rank[column[use]]
    total, width = np.zeros((len(sets), len(sets))), 4096
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        block = np.zeros((len(sets), width), np.float32)
        block[owner[lo:hi], column[lo:hi] - at] = 1
        total += block @ block.T
    return np.rint(total[a, b]).astype(np.int64)


def tile_links(members: list[dict], band: int, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Documents linked to each member, and edges that connect what is linked."""
    bands = np.array([m["bands"] for m in members], np.int64)
    a, b = owned_pairs(bands, np.array([m["block"] for m in members]), members[0]["low"], members[0]["high"], band)
    sets = [np.frombuffer(m["grams"], np.uint64) for m in members]
    both = common_grams(sets, a, b)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    linked = both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9
    a, b = a[linked], b[linked]
    copies = np.array([m["copies"] for m in members], np.int64)
    links = np.zeros(len(members), np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root, forest = list(range(len(members))), []

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(i), top(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            forest.append((i, j))
    return links, forest


_LINKS = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("other", T.StringType()), T.StructField("links", T.LongType())]
)


def _links_of_tiles(threshold: float):
    """Rows sorted by tile; one tile at a time is held."""

    def result(members: list[dict], band: int) -> pa.RecordBatch:
        members = list({m["key"]: m for m in members}.values())
        links, forest = tile_links(members, band, threshold)
        rows = [(m["key"], None, int(n)) for m, n in zip(members, links, strict=True) if n]
        rows += [(members[i]["key"], members[j]["key"], 0) for i, j in forest]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_LINKS.names)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, members = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).to_pylist():
                    own = (row["bucket"], row["low"], row["high"])
                    if own != tile:
                        if len(members) > 1:
                            yield result(members, members[0]["band"])
                        tile, members = own, []
                    members.append(row)
        if len(members) > 1:
            yield result(members, members[0]["band"])

    return look


# --- components -------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the least node of its connected component.

    Each round hooks every node to its least neighbour, jumps once, and contracts the edges; the number of rounds
    grows with the logarithm of the diameter.  Rounds are written to the shared folder.
    """
    spark = edges.sparkSession
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    labels, old = None, []
    while True:
        path = shared_path(spark, "edges")
        edges.write.parquet(path)
        edges = spark.read.schema(edges.schema).parquet(path)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        again = hook.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        step = written(hook.join(again, "p").select(F.col("a").alias("node"), F.col("pp").alias("root")), "step")
        if labels is None:
            labels = step
        else:
            further = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = written(
                labels.join(further, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels"
            )
        left = (
            edges.join(step.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
            .join(step.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
            .where("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
            .distinct()
        )
        for p in old:
            delete_path(spark, p)
        old = [path]
        edges = written(left, "edges-left")
        if edges.isEmpty():
            return labels


# --- the join ---------------------------------------------------------------------------------------------------


def near_classes(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    recall: float = RECALL,
    id_column: str = "doc_id",
    text_column: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """(id, key, class_id, class_key, n_links), one row per row of ``docs``.

    Two documents are linked if their sets of ``words``-grams have a Jaccard coefficient of ``threshold`` or more, or
    their words are the same.  ``class_id`` is the least id of the connected component, ``n_links`` the number of
    documents linked to the row, its copies included.  Pairs at the threshold meet with probability ``recall``.

    A text of fewer words is one gram of all its words; texts without any word (null counts as empty) are linked only
    to equal texts.  Repeated rows count as copies.  Null ids are allowed; ``class_id`` is null only where all ids of
    a class are.  An empty table gives an empty result.
    """
    bands, rows = bands_for(threshold, recall)
    text = docs[text_column].cast("string")
    base = docs.select(docs[id_column].alias("id"), word_key(text).alias("key"), text.alias("text"))
    marked = written(base.select("id", "key", _bands(bands, rows, words)("text").alias("bands")), "marked")
    nodes = marked.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id"), F.first("bands").alias("bands"))
    nodes = written(nodes, "nodes")

    met = nodes.select("key", "copies", "bands", F.posexplode("bands").alias("band", "bucket"))
    own, other = F.xxhash64("key"), F.xxhash64("key", F.lit(1))
    buckets = (
        met.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.bit_xor(own).alias("x"), F.bit_xor(other).alias("y"), F.min("band").alias("band"))
        .where("n > 1")
        .groupBy("n", "x", "y")  # equal members: the first band will do
        .agg(F.min_by("bucket", "band").alias("bucket"))
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
        .select("bucket", "blocks")
    )
    members = met.join(buckets, "bucket").withColumn("block", F.pmod(F.xxhash64("key", F.lit(2)), F.col("blocks")).cast("int"))
    tiles = written(
        members.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "key", "copies", "bands", "band", "bucket", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high")
        ),
        "tiles",
    )
    wanted = tiles.select("key").distinct().join(nodes.select("key", "first_id"), "key").withColumnRenamed("key", "k")
    texts = base.join(wanted.hint("merge"), (F.col("key") == F.col("k")) & F.col("id").eqNullSafe(F.col("first_id"))).select("key", "text")
    texts = texts.dropDuplicates(["key"])  # rows may repeat an id, too
    sets = texts.select("key", _grams(words)("text").alias("grams"))
    rows_of_tiles = tiles.join(sets.hint("merge"), "key").repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = written(rows_of_tiles.mapInArrow(_links_of_tiles(threshold), _LINKS), "links")

    labels = components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    placed = (
        nodes.select("key", "copies", "first_id")
        .join(labels.withColumnRenamed("node", "key"), "key", "left")
        .join(links, "key", "left")
        .select(
            "key",
            "first_id",
            F.coalesce("root", "key").alias("root"),
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        )
    )
    classes = placed.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull(), "first_id", "key")).alias("best"))
    placed = placed.join(classes, "root").select(
        "key", F.col("best.first_id").alias("class_id"), F.col("best.key").alias("class_key"), "n_links"
    )
    return marked.select("id", "key").join(placed, "key").select(
        F.col("id").alias(id_column), F.col("key"), "class_id", "class_key", "n_links"
    )


def keep_one_of_each(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the least id, columns as before.

    Of repeated rows that share id and words one stays.
    """
    classes = near_classes(docs, text_column=text_column, id_column=id_column, **options)
    best = classes.where((F.col("key") == F.col("class_key")) & F.col(id_column).eqNullSafe(F.col("class_id")))
    key, winner, winner_id = free_name(docs, "key"), free_name(docs, "winner"), free_name(docs, "winner_id")
    best = best.select(F.col("key").alias(winner), F.col(id_column).alias(winner_id)).distinct()
    keyed = docs.withColumn(key, word_key(docs[text_column]))
    kept = keyed.join(best.hint("merge"), (F.col(key) == F.col(winner)) & F.col(id_column).eqNullSafe(F.col(winner_id)))
    return kept.dropDuplicates([key, id_column]).select(docs.columns)
