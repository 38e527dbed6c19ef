"""The prefix trie of conversations: every shared beginning as one node, with aggregates over its subtree.

A conversation becomes a path of 16-byte keys (hashes of role and text), so its texts are shuffled nowhere.  Paths are
dealt to shards by ranges of (path, id); where the paths of the splitters run is the skeleton.  A node off the skeleton
lies in one shard only: between two paths with a common beginning there is no splitter without it.  Each task walks its
sorted paths with a stack of open nodes and finishes these nodes alone.  Nodes on the skeleton get one partial row from
each shard that touches them, which are added up, first by node and then along the skeleton to its root.  Copies of one
conversation, or conversations with one first turn, are many rows on a skeleton path and so are spread over shards.
"""

from __future__ import annotations

import bisect
import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import written

KEY_BYTES = 16
#: Conversations and turns of a shard, on average.
SHARD_TURNS = 2_000_000
#: Most shards, and most turns of a splitter's path that count: together they bound the skeleton.
MOST_SHARDS, SPLITTER_TURNS = 4_000, 256
#: Rows read per splitter to choose it.  The choice moves rows between shards and changes no result.
SAMPLES = 32
#: Ids of one end that travel in one row.
CHUNK_IDS = 4_096
#: A word of a turn's text: a run of characters that are not white space in ASCII.
WORD = r"[^\x20\x09-\x0D]+"

NODE, PARTIAL, ENDS = 0, 1, 2


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of a hash of role and text as 32 hex digits; null counts as empty."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY_BYTES)


def own_turns(turns: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """id and ``turns``, an array of (hex key, words) in order of the turn: null first, ties by key."""
    text = turns[text_column].cast("string")
    rows = turns.where(turns[id_column].isNotNull()).select(
        turns[id_column].cast("long").alias("id"),
        F.struct(
            turns[turn_column].isNotNull().alias("known"),
            turns[turn_column].cast("long").alias("turn"),
            turn_key(turns[role_column], text).alias("key"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("words"),
        ).alias("t"),
    )
    gathered = rows.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return gathered.select("id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["words"].alias("words"))).alias("turns"))


def rebuilt_turns(own: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of their family's first one: crc32(id) % ``most`` of them, or all there
    are.  Up to ``family`` conversations share a beginning, which is at most ``most`` - 1 turns."""
    base = F.col("id") - F.col("id") % family
    heads = own.where(F.col("id") % family == 0).select(F.col("id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("id").cast("string").cast("binary")) % most).cast("int")
    joined = own.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    take = F.slice(F.coalesce("head", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("id", F.concat(take, rest).alias("turns"))


def _splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """(path, id) of ``shards`` - 1 rows about evenly apart, from SAMPLES rows each; long paths are cut."""
    if shards < 2:
        return []
    rows = paths.count()
    share = min(1.0, shards * SAMPLES / max(rows, 1))
    drawn = F.pmod(F.xxhash64("id", F.lit("splitter")), F.lit(1 << 30)) < int(share * (1 << 30))
    path = F.substring("path", 1, KEY_BYTES * SPLITTER_TURNS)
    whole = F.octet_length("path") <= KEY_BYTES * SPLITTER_TURNS
    seen = paths.where(drawn).select(path.alias("path"), F.when(whole, F.col("id")).otherwise(-(1 << 63)).alias("id"))
    sample = [(bytes(r["path"]), r["id"]) for r in seen.orderBy("path", "id").limit(2 * shards * SAMPLES).collect()]
    picked = [sample[i * len(sample) // shards] for i in range(1, shards)] if sample else []
    return sorted(set(picked))


class Skeleton:
    """The trie of the splitters' paths, kept as the sorted splitters: the paths next to a path share most with it."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters, self.paths = splitters, [p for p, _ in splitters]

    def shard(self, path: bytes, number: int) -> int:
        return bisect.bisect_right(self.splitters, (path, number))

    def depth(self, path: bytes) -> int:
        """Turns of the longest beginning of a path that is on the skeleton (the root always is)."""
        at = bisect.bisect_left(self.paths, path)
        near = self.paths[max(at - 1, 0) : at + 1]
        return max((shared(path, p) for p in near), default=0)


def shared(a: bytes, b: bytes) -> int:
    """Number of turns in which two paths agree."""
    return len(os.path.commonprefix([a, b])) // KEY_BYTES


_WALKED = pa.schema(
    [
        ("kind", pa.int32()), ("shard", pa.int64()), ("enter", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()),
        ("words", pa.int64()), ("ends", pa.string()), ("path", pa.binary()),
    ]
)
_WALKED_SQL = (
    "kind int, shard long, enter long, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, "
    "words long, ends string, path binary"
)
_EMPTY_SHA = hashlib.sha256().hexdigest()


class _Node:
    """An open node: aggregates of what has been seen below it."""

    __slots__ = ("enter", "words", "least", "members", "children", "leaves", "saved", "ends", "chunk", "local")

    def __init__(self, enter: int, words: int, local: bool):
        self.enter, self.words, self.local = enter, words, local
        self.least, self.members, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.ends, self.chunk = None, []

    def add(self, least: int | None, members: int) -> None:
        self.members += members
        if least is not None and (self.least is None or least < self.least):
            self.least = least


def _emit(rows: Iterator[tuple], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _WALKED, strict=True)], schema=_WALKED)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _WALKED, strict=True)], schema=_WALKED)


def _walk(skeleton: Skeleton):
    """Nodes of sorted shards.  A node on the skeleton hands nothing to its parent; the reduction does that."""

    def close(stack: list[_Node], path: bytes, shard: int) -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        if not node.local:
            at = path[: depth * KEY_BYTES]
            yield from flush(node, at, depth, shard)
            yield PARTIAL, shard, node.enter, depth, node.least, node.members, node.children, node.leaves, node.saved, node.words, None, at
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.members - 1) * node.words
        up = stack[-1]
        up.add(node.least, node.members)
        up.children, up.leaves, up.saved = up.children + 1, up.leaves + leaves, up.saved + saved
        above = None if up.local else path[: (depth - 1) * KEY_BYTES]
        ends = node.ends.hexdigest() if node.ends else _EMPTY_SHA
        yield NODE, shard, node.enter, depth, node.least, node.members, node.children, leaves, saved, node.words, ends, above

    def flush(node: _Node, at: bytes, depth: int, shard: int) -> Iterator[tuple]:
        if node.chunk:
            yield ENDS, shard, node.enter, depth, node.chunk[0], len(node.chunk), 0, 0, 0, 0, ",".join(map(str, node.chunk)), at
            node.chunk = []

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        stack, before, current, enter = [], b"", None, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("shard", "path", "id", "words"))
            for shard, path, number, words in zip(*columns, strict=True):
                keep = shared(before, path) if shard == current else -1
                while stack and len(stack) - 1 > keep:
                    yield from close(stack, before, current)
                on, before, current = skeleton.depth(path), path, shard
                while len(stack) - 1 < len(words):
                    depth = len(stack)
                    stack.append(_Node(enter, words[depth - 1] if depth else 0, depth > on))
                    enter += 1
                end = stack[-1]
                end.add(number, 1)
                if end.local:
                    if end.ends is None:
                        end.ends = hashlib.sha256(str(number).encode())
                    else:
                        end.ends.update(f",{number}".encode())
                else:
                    end.chunk.append(number)
                    if len(end.chunk) >= CHUNK_IDS:
                        yield from flush(end, path, len(words), shard)
        while stack:
            yield from close(stack, before, current)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _emit(nodes(batches))

    return look


def _with_parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A local node's ``words`` becomes its parent's conv_id where that is local.  Nodes come in the order in which they
    were entered, so the parent is the last one a level higher."""
    line, current = [], None
    for batch in batches:
        parents = []
        for kind, shard, depth, conv, above in zip(
            *(batch.column(c).to_pylist() for c in ("kind", "shard", "depth", "conv_id", "path")), strict=True
        ):
            if kind != NODE:
                parents.append(None)
                continue
            if shard != current:
                line, current = [], shard
            line[depth:] = []
            line.extend([None] * (depth - len(line)))
            parents.append(line[depth - 1] if above is None else None)
            line.append(conv)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(parents, pa.int64())], names=[*batch.schema.names, "parent_conv_id"]
        )


_ROLLED = T.StructType([T.StructField("path", T.BinaryType()), T.StructField("ends_sha256", T.StringType())])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per node from its chunks of ids in ascending order."""
    current = digest = None
    done = []
    for batch in batches:
        for path, ids in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if digest is None or path != current:
                if digest is not None:
                    done.append((current, digest.hexdigest()))
                current, digest = path, hashlib.sha256(ids.encode())
            else:
                digest.update(f",{ids}".encode())
    if digest is not None:
        done.append((current, digest.hexdigest()))
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([d for _, d in done])], names=["path", "ends_sha256"])


def _skeleton_nodes(walked: DataFrame) -> DataFrame:
    """Skeleton nodes from the partial rows of all shards: sums by node, then along the skeleton up to the root."""
    near = walked.where(F.col("kind") == PARTIAL).groupBy("path", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.max("words").alias("words"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
    )
    near = written(near, "skeleton")
    above = lambda df: df.withColumn("up", F.explode(F.sequence(F.lit(0), F.col("depth").cast("int")))).withColumn(
        "node", F.expr(f"substring(path, 1, up * {KEY_BYTES})")
    )
    members = above(near).groupBy("node").agg(F.min("conv_id").alias("least"), F.sum("n_convs").alias("members"))
    below = near.where("depth > 0").groupBy(F.expr(f"substring(path, 1, (cast(depth as int) - 1) * {KEY_BYTES})").alias("node")).agg(
        F.count(F.lit(1)).alias("more")
    )
    own = near.join(members, near["path"] == members["node"]).drop("node").join(below, F.col("path") == below["node"], "left").drop("node")
    children = F.col("n_children") + F.coalesce("more", F.lit(0))
    own = own.withColumns(
        {
            "n_children": children,
            "own_leaves": F.col("n_leaves") + (children == 0).cast("long"),
            "own_saved": F.col("saved") + (F.col("members") - 1) * F.col("words"),
        }
    )
    own = written(own.select("path", "depth", "least", "members", "n_children", "own_leaves", "own_saved"), "skeleton")
    rolled = above(own).groupBy("node").agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens"))
    chunks = walked.where(F.col("kind") == ENDS).select("path", "conv_id", "ends")
    ends = chunks.repartition("path").sortWithinPartitions("path", "conv_id").select("path", "ends").mapInArrow(_ends, _ROLLED)
    out = own.join(rolled, own["path"] == rolled["node"]).drop("node").join(ends, "path", "left")
    parent = own.select(F.col("path").alias("above"), F.col("least").alias("parent_conv_id"))
    up = F.when(F.col("depth") > 0, F.expr(f"substring(path, 1, (cast(depth as int) - 1) * {KEY_BYTES})"))
    return out.join(parent, up == F.col("above"), "left").select(
        "path", F.col("least").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY_SHA)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """Columns id and turns (array of hex key and words) to one row per node: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = conversations.select(
        F.unhex(F.array_join(F.col("turns.key"), "")).alias("path"), "id", F.col("turns.words").alias("words")
    )
    paths = written(paths, "paths")
    if shards is None:
        total = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
        shards = min(MOST_SHARDS, max(1, -(-total // SHARD_TURNS), min(total // 1_000, paths.sparkSession.sparkContext.defaultParallelism)))
    skeleton = Skeleton(_splitters(paths, shards))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dealt = [skeleton.shard(p, i) for p, i in zip(batch.column("path").to_pylist(), batch.column("id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(dealt, pa.int32()), *batch.columns], names=["shard", *batch.schema.names])

    n = len(skeleton.splitters) + 1
    dealt = paths.mapInArrow(deal, "shard int, path binary, id long, words array<long>")
    ordered = dealt.repartitionById(n, "shard").sortWithinPartitions("shard", "path", "id")
    entered = ordered.mapInArrow(_walk(skeleton), _WALKED_SQL).sortWithinPartitions("shard", "enter")
    walked = written(entered.mapInArrow(_with_parents, f"{_WALKED_SQL}, parent_conv_id long"), "walked")
    spine = written(_skeleton_nodes(walked), "spine")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # The skeleton has at most MOST_SHARDS x SPLITTER_TURNS nodes and mostly a few per shard.
    tops = F.broadcast(spine.select(F.col("path").alias("above"), F.col("conv_id").alias("top")))
    local = walked.where(F.col("kind") == NODE).withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    local = local.join(tops, F.col("path") == F.col("above"), "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "top"))
    return local.select(columns).unionByName(spine.select(columns))


def conversation_trie(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    rebuild: bool = False,
    shards: int | None = None,
) -> DataFrame:
    """One row per distinct sequence of first turns (role, text), the empty one included, with aggregates of its subtree.

    Null roles and texts are empty; a null turn comes first, equal turns are in order of a hash; repeated rows are turns
    of their own.  Rows with a null id belong to no conversation.  ``rebuild`` first gives each conversation the
    beginning of its family's (``rebuilt_turns``).  Without conversations there are no nodes.  A conversation's keys
    (40 bytes a turn) are held by one task; its texts never are.  Other columns are not read.
    """
    own = own_turns(turns, id_column, turn_column, role_column, text_column)
    return trie(rebuilt_turns(written(own, "turns")) if rebuild else own, shards)
