import hashlib
import random
import re
import zlib

import pytest

from tickloom.llm import prefix_trie
from tickloom.llm.prefix_trie import conversation_trie


def rebuild(paths):
    out = {}
    for c, own in paths.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = paths.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        childless = lambda p: not any(q[:-1] == p and q for q in nodes)
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(path))))
        out.append(
            (
                min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(1 for q in nodes if q and q[:-1] == path),
                sum(map(childless, below)), sum((len(nodes[p]) - 1) * words(p) for p in below), hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return out


KINDS = "conv_id long, turn long, role string, text string"


def made(seed, n=70):
    draw = random.Random(seed)
    rows = []
    for c in range(n):
        copy = c % 3 == 0
        for turn in range(3 if copy else draw.randint(1, 6)):
            text = ["hot start", "b c  d", "e"][turn] if copy else draw.choice(["a b", "a\tb c", "", "é 中 x", None])
            rows.append((c, turn, draw.choice(["user", None]) if not copy else "user", text))
    return rows


def paths_of(rows):
    out = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


def key(r):
    return tuple("" if x is None else str(x) for x in r)


@pytest.mark.parametrize(("seed", "shards", "again"), [(1, 1, False), (2, 7, True), (3, 40, False), (4, 3, True)])
def test_same_as_brute_force(spark, seed, shards, again, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 2)
    rows = made(seed)
    frame = spark.createDataFrame(rows, KINDS).selectExpr("*", "'x' as id", "'y' as path", "'z' as shard", "1 as depth").repartition(5)
    paths = paths_of(rows)
    want = brute(rebuild(paths) if again else paths)
    got = conversation_trie(frame, rebuild=again, shards=shards).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_long_paths_and_short_splitters(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPLITTER_TURNS", 2)
    rows = [(c, t, "user", f"same {min(t, c % 4 + 2)}" if t < 40 else f"own {c}") for c in range(12) for t in range(60)]
    got = conversation_trie(spark.createDataFrame(rows, KINDS), shards=5).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(paths_of(rows))))


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, None, "user", "first"), (None, 0, "user", "no id"), (60, 3, "user", "x " * 9_000)]
    got = sorted(map(key, conversation_trie(spark.createDataFrame(rows, KINDS), shards=4).collect()))
    paths = {1: [("user", "first"), ("", ""), ("", "")], 2: [("user", "first")], 60: [("user", "x " * 9_000)]}
    assert got == sorted(map(key, brute(paths)))
    # A conversation without turns of its own beyond the family's, and an absent first one: turnless, at the root.
    alone = [(c, 0, "user", "a") for c in range(41, 60)]
    assert sorted(map(key, conversation_trie(spark.createDataFrame(alone, KINDS), rebuild=True).collect())) == sorted(map(key, brute(rebuild(paths_of(alone)))))
    assert conversation_trie(spark.createDataFrame([], KINDS), rebuild=True).count() == 0
