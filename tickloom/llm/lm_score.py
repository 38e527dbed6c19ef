"""Stupid-backoff scores of every document under n-gram counts of all documents.

Relational plan: documents are dealt to chunks; a chunk's distinct n-grams of all orders with their counts (a partial
aggregate) are partitioned by hash; each hash partition sums the counts of all chunks and joins the totals back to the
chunk that asked; the chunk joins totals to its exploded n-grams and sums per document.  Rows are packed: what one
chunk sends to one partition is one row of sorted hashes.  A frequent n-gram is one entry per chunk, so none is hot.
Rows are chunks x partitions while a chunk meets every partition, and at most the chunk's distinct n-grams beyond, so
there are never more of them than the plain form has.

``plain_scores`` is that plain form, one row per document and n-gram; it gives the same scores and needs several times
the shuffle (figures in the README).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import hashed_words, mix, word_count, words_text, written

ORDER, BACKOFF = 3, 0.4
#: Characters of text in a chunk, and of the corpus per hash partition.
CHUNK_CHARS = 16_000_000
#: Bytes of a hash that count, beside those of its partition.
HASH_BYTES = 6


def ngrams(hashes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """Per order k the hash of the k words that end at each position; 0 where the text has not begun k words before."""
    place = np.arange(len(hashes)) - np.repeat(starts[:-1], np.diff(starts))
    out, gram = [], np.zeros(len(hashes), np.uint64)
    for k in range(1, order + 1):
        if k == 1:
            gram = mix(hashes + np.uint64(1))
        else:
            longer = np.zeros(len(hashes), np.uint64)
            longer[1:] = mix(gram[:-1] * np.uint64(0xD1342543DE82EF95) + hashes[1:] + np.uint64(k))
            gram = longer
        gram = np.where(place >= k - 1, gram | np.uint64(1), np.uint64(0))
        out.append(gram)
    return out


def _starts(parts: int) -> np.ndarray:
    """First hash of each partition: ranges in the order of hashes, cut at multiples of 2**32."""
    return np.array([-(-(k << 32) // parts) << 32 for k in range(parts)], np.uint64)


def _dropped(parts: int) -> np.uint64:
    """Low bits of a hash that do not travel: what exceeds HASH_BYTES after the partition is taken off."""
    return np.uint64(max(0, 64 - (parts.bit_length() - 1) - 8 * HASH_BYTES))


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as steps: how many, bytes a step, the steps, then eight bytes for each that needs more.

    The width is that of the fewest bytes.  Hashes are spread evenly, so steps are shorter than hashes.
    """
    steps = np.diff(values, prepend=np.uint64(0))
    wide = {w: steps >= np.uint64((1 << 8 * w) - 1) for w in range(2, HASH_BYTES + 1)}
    width = min(wide, key=lambda w: len(steps) * w + 8 * int(np.count_nonzero(wide[w])))
    short = np.where(wide[width], np.uint64((1 << 8 * width) - 1), steps)
    body = np.ascontiguousarray(short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
    return len(steps).to_bytes(4, "little") + bytes([width]) + body + steps[wide[width]].astype("<u8").tobytes()


def _packed_size(raw: bytes) -> int:
    return int.from_bytes(raw[:4], "little")


def _unpack(raw: bytes) -> np.ndarray:
    n, width = _packed_size(raw), raw[4]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, offset=5).reshape(n, width)
    steps = out.view("<u8").ravel()
    steps[steps == np.uint64((1 << 8 * width) - 1)] = np.frombuffer(raw[5 + n * width :], "<u8")
    return np.cumsum(steps, dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """A bit a count, then a byte each for those over 0, then eight bytes each for those of 255 and more."""
    some = counts[counts > 0]
    large = some >= 255
    bits = np.packbits(counts > 0, bitorder="little").tobytes()
    return bits + np.where(large, 255, some).astype(np.uint8).tobytes() + some[large].astype("<u8").tobytes()


def _unpack_counts(raw: bytes, n: int) -> np.ndarray:
    end = (n + 7) // 8
    present = np.unpackbits(np.frombuffer(raw, np.uint8, end), bitorder="little", count=n).astype(bool)
    some = np.frombuffer(raw, np.uint8, int(present.sum()), offset=end).astype(np.int64)
    some[some == 255] = np.frombuffer(raw, "<u8", offset=end + len(some)).astype(np.int64)
    out = np.zeros(n, np.int64)
    out[present] = some
    return out


def _counted(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a chunk in order, and their counts.  Works in place where it can: chunks are large."""
    flat = np.concatenate([g[g != 0] for g in grams])
    flat.sort()
    fresh = np.ones(len(flat), bool)
    np.not_equal(flat[1:], flat[:-1], out=fresh[1:])
    first = np.flatnonzero(fresh)
    del fresh
    counts = np.empty(len(first), np.int32)
    counts[:-1] = first[1:] - first[:-1]
    if len(first):
        counts[-1] = len(flat) - first[-1]
    return flat[first], counts


def _cut(grams: list[np.ndarray], parts: int) -> None:
    """Drop the bits that do not travel, in place; 0 stays the mark of no n-gram."""
    drop = _dropped(parts)
    if drop:
        for g in grams:
            np.right_shift(g, drop, out=g)


_REQUEST = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("chunk", T.IntegerType()),
        T.StructField("grams", T.BinaryType()),
        T.StructField("counts", T.BinaryType()),
    ]
)
_ANSWER = T.StructType(
    [T.StructField("chunk", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("others", T.BinaryType())]
)


def _requests(order: int, parts: int):
    def look(chunk: pa.Table) -> pa.Table:
        grams = ngrams(*hashed_words(chunk.column("text").to_pylist()), order)
        _cut(grams, parts)
        values, counts = _counted(grams)
        del grams
        starts = _starts(parts) >> _dropped(parts)
        edges = np.concatenate([np.searchsorted(values, starts), [len(values)]])
        number = chunk.column("chunk")[0].as_py()
        asked = [k for k in range(parts) if edges[k] < edges[k + 1]]
        return pa.table(
            {
                "part": pa.array(asked, pa.int32()),
                "chunk": pa.array([number] * len(asked), pa.int32()),
                "grams": pa.array([_pack(values[edges[k] : edges[k + 1]] - starts[k]) for k in asked], pa.binary()),
                "counts": pa.array([_pack_counts(counts[edges[k] : edges[k + 1]] - 1) for k in asked], pa.binary()),
            }
        )

    return look


def _answers(asked: pa.Table) -> pa.Table:
    """Counts in the other chunks, for each chunk in the order in which it asked; mostly 0, which costs a bit."""
    sizes = [_packed_size(x.as_py()) for x in asked.column("grams")]
    cuts = np.cumsum([0, *sizes])
    values, counts = np.empty(cuts[-1], np.uint64), np.empty(cuts[-1], np.int64)
    for x, c, a, b in zip(asked.column("grams"), asked.column("counts"), cuts[:-1], cuts[1:], strict=True):
        values[a:b] = _unpack(x.as_py())
        counts[a:b] = _unpack_counts(c.as_py(), b - a) + 1
    order = np.argsort(values)
    values = values[order]
    fresh = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=fresh[1:])
    del values
    totals = np.add.reduceat(counts[order], np.flatnonzero(fresh))
    group = np.cumsum(fresh, dtype=np.int32)
    group -= 1
    counts[order] = totals[group] - counts[order]
    return pa.table(
        {
            "chunk": asked.column("chunk").cast(pa.int32()),
            "part": asked.column("part").cast(pa.int32()),
            "others": pa.array([_pack_counts(counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


def score_positions(counts: list[np.ndarray], words: np.ndarray, backoff: float) -> np.ndarray:
    """Log score of each position from the counts of the n-grams of each order that end there (negative: none).

    ``words``: per position the number of words that the counts rest on.  A word that occurs nowhere counts a half.
    """
    order, n = len(counts), len(words)
    score = np.log(np.maximum(counts[0], 0.5) / np.maximum(words, 1.0))
    for k in range(2, order + 1):
        context = np.concatenate([[0.0], counts[k - 2][:-1]]) if n else np.zeros(0)
        longer = counts[k - 1]
        seen = longer > 0
        step = np.log(np.where(seen, longer, 1.0) / np.where(seen, np.maximum(context, 1.0), 1.0))
        score = np.where(seen, step, np.where(longer < 0, score, score + np.log(backoff)))
    return score


def _places(values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked value among the sorted ones; asked in order, as neighbours are then found in the cache."""
    order = np.argsort(asked)
    out = np.empty(len(order), np.int64)
    out[order] = np.searchsorted(values, asked[order])
    return out


def _own_counts(owner: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """How often each row's n-gram stands in its own text."""
    key = owner * width + place
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=fresh[1:])
    del key
    sizes = np.diff(np.concatenate([np.flatnonzero(fresh), [len(fresh)]])).astype(np.int32)
    out = np.empty(len(order), np.int32)
    out[order] = np.repeat(sizes, sizes)
    return out


def _scores(order: int, parts: int, total: int, backoff: float, exclude_self: bool, id_type: pa.DataType, names: list[str]):
    def look(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        hashes, starts = hashed_words(chunk.column("text").to_pylist())
        n = np.diff(starts)
        sums = np.zeros(len(n))
        if len(hashes):
            grams = ngrams(hashes, starts, order)
            del hashes
            _cut(grams, parts)
            values, totals = _counted(grams)
            edges = np.concatenate([np.searchsorted(values, _starts(parts) >> _dropped(parts)), [len(values)]])
            totals = totals.astype(np.int64)
            for k, packed in zip(answers.column("part").to_pylist(), answers.column("others"), strict=True):
                totals[edges[k] : edges[k + 1]] += _unpack_counts(packed.as_py(), int(edges[k + 1] - edges[k]))
            owner, words, counts = np.repeat(np.arange(len(n)), n), np.full(int(starts[-1]), float(total)), []
            for k in range(order):
                at = np.flatnonzero(grams[k])
                asked = grams[k][at]
                grams[k] = None
                place = _places(values, asked)
                del asked
                found = np.full(len(owner), -1.0, np.float64)
                found[at] = totals[place]
                if exclude_self:
                    found[at] -= _own_counts(owner[at], place, len(values) + 1)
                counts.append(found)
            del values, totals
            if exclude_self:
                words -= np.repeat(n, n)
            score = score_positions(counts, words, backoff)
            sums = np.bincount(owner, weights=score, minlength=len(n))
        return pa.table(
            {
                names[0]: chunk.column("id").cast(id_type),
                names[1]: pa.array(n, pa.int64()),
                names[2]: pa.array(sums, pa.float64()),
                names[3]: pa.array([float(s / k) if k else None for s, k in zip(sums, n, strict=True)], pa.float64()),
            }
        )

    return look


def backoff_scores(
    docs: DataFrame,
    order: int = ORDER,
    backoff: float = BACKOFF,
    exclude_self: bool = True,
    id_column: str = "doc_id",
    text_column: str = "text",
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """id, n_words, log_score (sum over words), mean_log_score, one row per row.

    A word after its context scores count(context word) / count(context) for the longest context, of ``order - 1``
    words at most, with which it occurs; each shorter context costs a factor ``backoff``; alone it scores count / all
    words, and a half where it does not occur.  With ``exclude_self`` a row's own words are taken off all counts, so
    a text is judged by the others; repeated rows and copies count for one another.  Null and empty texts have no
    words, a log_score of 0 and a null mean; null ids are allowed; an empty table gives an empty result.
    """
    text = docs[text_column].cast("string")
    chars, total = docs.agg(F.sum(F.length(text)), F.sum(word_count(text))).first()
    chunks = max(1, -(-(chars or 0) // chunk_chars))
    # The split a row comes from parts equal rows, which one hash would deal to one chunk.
    dealt = F.pmod(F.xxhash64(docs[id_column], text, F.spark_partition_id()), F.lit(chunks)).cast("int")
    base = docs.select(dealt.alias("chunk"), docs[id_column].alias("id"), text.alias("text")).repartition(chunks, "chunk")
    requests = base.groupBy("chunk").applyInArrow(_requests(order, chunks), _REQUEST)
    answers = requests.repartition(chunks, "part").groupBy("part").applyInArrow(_answers, _ANSWER)
    schema = T.StructType(
        [
            T.StructField(id_column, docs.schema[id_column].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("log_score", T.DoubleType()),
            T.StructField("mean_log_score", T.DoubleType()),
        ]
    )
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(schema[0].dataType)
    score = _scores(order, chunks, total or 0, backoff, exclude_self, id_type, schema.names)
    return base.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def plain_scores(
    docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, exclude_self: bool = True, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """The rows of ``backoff_scores`` from a count table partitioned by hash, joined to exploded n-grams, summed per row.

    An n-gram is pre-aggregated per row before its hash is shuffled; one that no other row has is answered by 0 without
    a partner in the join.
    """
    words = F.filter(F.split(words_text(docs[text_column]), " "), lambda w: w != "")
    rows = written(docs.select(F.monotonically_increasing_id().alias("row"), docs[id_column].alias("id"), words.alias("w")), "words")
    total = rows.agg(F.sum(F.size("w"))).first()[0] or 0

    def ending_at(i: Column) -> Column:
        grams = [F.when(i >= k, F.struct(F.lit(k).alias("k"), i.alias("i"), F.xxhash64(F.lit(k), F.slice("w", i - (k - 1), F.lit(k))).alias("h"))) for k in range(1, order + 1)]
        return F.array_compact(F.array(*grams))

    places = F.when(F.size("w") > 0, F.sequence(F.lit(1), F.size("w")))
    exploded = rows.select("row", F.explode(places).alias("i"), "w").select("row", F.inline(ending_at(F.col("i"))))
    own = exploded.groupBy("row", "k", "h").agg(F.count(F.lit(1)).alias("own"))
    table = own.groupBy("k", "h").agg(F.sum("own").alias("total"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    others = own.join(table, ["k", "h"], "left").select("row", "k", "h", (F.coalesce("total", "own") - (F.col("own") if exclude_self else F.lit(0))).alias("c"))
    met = exploded.join(others, ["row", "k", "h"])
    counts = met.groupBy("row", "i").agg(*[F.max(F.when(F.col("k") == k, F.col("c"))).alias(f"c{k}") for k in range(1, order + 1)])
    before = Window.partitionBy("row").orderBy("i")
    counts = counts.withColumns({f"b{k}": F.lag(f"c{k}").over(before) for k in range(1, order)})
    sizes = rows.select("row", "id", F.size("w").cast("long").alias("n_words"))
    counts = counts.join(sizes.select("row", "n_words"), "row")
    n = F.lit(float(total)) - (F.col("n_words") if exclude_self else F.lit(0))
    score = F.log(F.greatest("c1", F.lit(0.5)) / F.greatest(n, F.lit(1.0)))
    for k in range(2, order + 1):
        seen = F.log(F.col(f"c{k}") / F.greatest(F.col(f"b{k - 1}"), F.lit(1)))
        score = F.when(F.col(f"c{k}") > 0, seen).when(F.col(f"c{k}").isNull(), score).otherwise(score + float(np.log(backoff)))
    summed = counts.select("row", score.alias("s")).groupBy("row").agg(F.sum("s").alias("log_score"))
    out = sizes.join(summed, "row", "left").withColumn("log_score", F.coalesce("log_score", F.lit(0.0)))
    return out.select(F.col("id").alias(id_column), "n_words", "log_score", F.try_divide("log_score", "n_words").alias("mean_log_score"))
