"""Benchmark decontamination by suffix arrays over the training texts.

The corpus is cut into shards of some megabytes inside the tasks.  A shard's words become numbers (0 for words that
the benchmark does not have) and its suffixes are sorted; a suffix that meets a 0 before the shortest benchmark window
ends cannot match and is left out.  Every benchmark suffix is then binary-searched in every shard's array, which gives
all places where its window stands; windows on one diagonal join to the longest verbatim match.  A document lies in
one shard, so nothing is shuffled and the corpus is read once for each block of the benchmark.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import free_name, words_of, written

WINDOW = 13
SHARD_CHARS = 4_000_000
#: The benchmark travels to the tasks in blocks of about so many characters (some 150 MB as windows), a pass for each.
BLOCK_CHARS = 8_000_000


class Windows:
    """Word windows of benchmark items, as sorted fixed-width keys."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window, self.vocabulary = window, {}
        self.ids = sorted({i for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.ids)}
        prefixes, lengths, where = [], [], []
        for item, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.uint32)
            n = min(len(words), window)
            if n:
                rows = np.zeros((len(words) - n + 1, window), np.uint32)
                rows[:, :n] = np.lib.stride_tricks.sliding_window_view(words, n)
                prefixes.append(rows)
                lengths.append(np.full(len(rows), n))
                where.append(np.stack([np.full(len(rows), number.get(item, -1)), np.arange(len(rows))], axis=1))
        low = np.concatenate(prefixes) if prefixes else np.zeros((0, window), np.uint32)
        self.lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.where = np.concatenate(where) if where else np.zeros((0, 2), np.int64)
        self.shortest = int(self.lengths.min()) if len(low) else window
        high = np.where(np.arange(window) < self.lengths[:, None], low, np.uint32(0xFFFFFFFF))
        self.low, self.high = _keys(low.astype(">u4")), _keys(high.astype(">u4"))


def _keys(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort like the rows."""
    return np.ascontiguousarray(rows).view(f"S{4 * rows.shape[1]}").ravel()


class SuffixArray:
    """Sorted suffixes of one shard, each by its first ``window`` words up to the first 0."""

    def __init__(self, numbers: np.ndarray, window: int, shortest: int):
        padded = np.concatenate([numbers, np.zeros(window, numbers.dtype)])
        stops = np.flatnonzero(padded == 0)
        run = stops[np.searchsorted(stops, np.arange(len(numbers)))] - np.arange(len(numbers))
        places = np.flatnonzero(run >= shortest)
        rows = padded[places[:, None] + np.arange(window)].astype(">u4")
        rows[np.arange(window) >= run[places][:, None]] = 0
        keys = _keys(rows) if len(rows) else np.zeros(0, f"S{4 * window}")
        order = np.argsort(keys, kind="stable")
        self.places, self.keys = places[order], keys[order]

    def search(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(number of the window, place) of every occurrence."""
        if not len(self.keys) or not len(windows.low):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begin = np.searchsorted(self.keys, windows.low, side="left")
        counts = np.searchsorted(self.keys, windows.high, side="right") - begin
        total = int(counts.sum())
        which = np.repeat(np.arange(len(counts)), counts)
        inner = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
        return which, self.places[begin[which] + inner]


def longest_matches(which: np.ndarray, place: np.ndarray, windows: Windows) -> np.ndarray:
    """Rows (item, item_start, place, length): windows that follow one another on a diagonal joined."""
    item, at = windows.where[which].T if len(which) else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((place, place - at, item))
    item, at, place, n = item[order], at[order], place[order], windows.lengths[which][order]
    fresh = np.ones(len(item), bool)
    fresh[1:] = (item[1:] != item[:-1]) | (np.diff(place - at) != 0) | (np.diff(place) != 1)
    first = np.flatnonzero(fresh)
    last = np.concatenate([first[1:], [len(item)]])[: len(first)] - 1
    length = place[last] + n[last] - place[first] if len(first) else np.zeros(0, np.int64)
    return np.stack([item[first], at[first], place[first], length], axis=1)


def match_shard(texts: list[str | None], before: list[list[tuple[int, int]]], windows: Windows) -> list[tuple]:
    """(n_words, hit runs, items, matches) of each text of a shard; ``before``: runs that earlier blocks hit."""
    words = [words_of(t) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate([[0], np.cumsum(counts + 1)])  # a 0 after each text keeps matches inside it
    numbers = np.zeros(starts[-1], np.uint32)
    for k, w in enumerate(words):
        numbers[starts[k] : starts[k] + counts[k]] = list(map(windows.vocabulary.get, w, itertools.repeat(0)))
    which, place = SuffixArray(numbers, windows.window, windows.shortest).search(windows)
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, place, 1)
    np.add.at(edge, place + windows.lengths[which], -1)
    for k, runs in enumerate(before):
        for a, b in runs:
            edge[starts[k] + a] += 1
            edge[starts[k] + b] -= 1
    hit = np.concatenate([[False], np.cumsum(edge) > 0])
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    runs, matches = turns.reshape(-1, 2), longest_matches(which, place, windows)
    of_run, of_match = (np.searchsorted(starts, x, side="right") - 1 for x in (runs[:, 0], matches[:, 2]))
    out = [(int(n), [], [], []) for n in counts]
    for k, (a, b) in zip(of_run.tolist(), runs.tolist(), strict=True):
        out[k][1].append((a - int(starts[k]), b - int(starts[k])))
    for k, (item, at, p, n) in zip(of_match.tolist(), matches.tolist(), strict=True):
        name = windows.ids[item] if item >= 0 else None
        out[k][3].append((name, at, p - int(starts[k]), n))
        if name is not None and name not in out[k][2][-1:]:
            out[k][2].append(name)
    return out


def benchmark_blocks(benchmark: DataFrame, id_column: str, text_column: str, block_chars: int) -> tuple[DataFrame, int]:
    """The distinct items with the number of their block, and the number of blocks of about ``block_chars`` characters.

    A block is fetched by ``where("part = k")``; an item longer than a block makes a larger one.
    """
    rows = benchmark.select(
        benchmark[id_column].alias("item"), F.coalesce(benchmark[text_column].cast("string"), F.lit("")).alias("text")
    ).distinct()
    chars = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n = -(-chars // block_chars) or 1
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return (written(dealt, "benchmark") if n > 1 else dealt), n


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    name: str = "contamination",
) -> DataFrame:
    """The rows of ``docs`` with a struct column ``name``:

    n_words, n_hit (words inside an occurrence of a benchmark window), items (ids with such windows, sorted), runs
    (hit word ranges, end exclusive), matches (longest verbatim matches: item, item_start, doc_start, length).

    A window is ``window`` consecutive words of an item; a shorter item with words is one window.  Null and empty
    texts have no words and match nothing.  Items with a null id hit words but are named by null in matches and not
    at all in items; repeated items are named once.  Repeated rows are judged alike.  All columns are kept; one of
    the same name is replaced.  An empty benchmark matches nothing, empty ``docs`` stay empty.
    """
    item = benchmark.schema[item_column].dataType
    run = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end")])
    match = T.StructType(
        [T.StructField("item", item)] + [T.StructField(n, T.IntegerType()) for n in ("item_start", "doc_start", "length")]
    )
    kind = T.StructType(
        [
            T.StructField("n_words", T.LongType()),
            T.StructField("runs", T.ArrayType(run)),
            T.StructField("items", T.ArrayType(item)),
            T.StructField("matches", T.ArrayType(match)),
        ]
    )
    state = free_name(docs, "matches")
    out = docs
    blocks, count = benchmark_blocks(benchmark, item_column, item_text_column, block_chars)
    for k in range(count):
        if k:
            # Done with the block before: neither driver nor tasks hold more than one.
            out = written(out, "matches")
        found = _column_function([tuple(r) for r in blocks.where(F.col("part") == k).select("item", "text").collect()], window, kind)
        text = out[text_column].cast("string")
        if k == 0:
            out = out.withColumn(state, found(text, F.lit(None).cast("array<struct<start:int,end:int>>")))
            continue
        more = free_name(out, "more")
        out = out.withColumn(more, found(text, F.col(f"{state}.runs"))).withColumn(
            state,
            F.struct(
                F.col(f"{more}.n_words").alias("n_words"),
                F.col(f"{more}.runs").alias("runs"),
                F.array_union(f"{state}.items", f"{more}.items").alias("items"),
                F.concat(f"{state}.matches", f"{more}.matches").alias("matches"),
            ),
        ).drop(more)
    hit = F.aggregate(f"{state}.runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    result = F.struct(
        F.col(f"{state}.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.array_sort(F.array_distinct(f"{state}.items")).alias("items"),
        F.col(f"{state}.runs").alias("runs"),
        F.col(f"{state}.matches").alias("matches"),
    )
    return out.withColumn(name, result).drop(state)


def _column_function(block: list[tuple], window: int, kind: T.StructType):
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        windows = Windows(block, window)
        for texts, before in batches:
            texts = texts.tolist()
            before = [[] if b is None else [(r["start"], r["end"]) for r in b] for b in before]
            rows, shard, size = [], 0, 0
            for i, text in enumerate(texts):
                size += len(text or "")
                if size >= SHARD_CHARS or i == len(texts) - 1:
                    rows += match_shard(texts[shard : i + 1], before[shard : i + 1], windows)
                    shard, size = i + 1, 0
            yield pd.DataFrame(rows, columns=[f.name for f in kind.fields])

    # "Non-deterministic" keeps the planner from evaluating it once more for a filter on its result.
    return F.pandas_udf(found, kind).asNondeterministic()


def is_contaminated(n_words, n_hit):
    """Hit words make up a twentieth of the words at least."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose benchmark words make up a twentieth or more; columns as before."""
    name = free_name(docs, "contamination")
    judged = with_matches(docs, benchmark, name=name, **options)
    return judged.where(~is_contaminated(F.col(f"{name}.n_words"), F.col(f"{name}.n_hit"))).drop(name)
