import hashlib
import math
import random

import numpy as np
import pytest

from tickloom.llm import ball_kmeans


def brute(rows, parts, entries, rounds):
    """Plain Python: every part against every entry."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(rounds):
        own = [[near(v, p)[1] for p in range(parts)] for _, v, _ in kept]
        for p in range(parts):
            for j in range(len(first)):
                members = [cut(v, p) for (_, v, _), a in zip(kept, own, strict=True) if a[p] == j]
                if members:
                    books[p][j] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for i, v, label in kept:
        found = [near(v, p) for p in range(parts)]
        error = sum(d for d, _ in found)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{j:02x}" for _, j in found), error, label, digest))
    return [(i, c, e, sums[label], d, label) for i, c, e, label, d in out]


def rows_of(n, seed, dims=12):
    draw = random.Random(seed)
    middles = [[draw.uniform(-1, 1) for _ in range(dims)] for _ in range(6)]
    return [(i, [float(np.float32(c + draw.gauss(0, 0.1))) for c in draw.choice(middles)], draw.choice([0, 1, None])) for i in range(n)]


def key(r):
    return tuple(str(x) for x in r)


@pytest.mark.parametrize(("entries", "rounds", "few"), [(8, 2, 20_000), (3, 5, 20_000), (64, 1, 0)])
def test_same_as_brute_force(spark, monkeypatch, entries, rounds, few):
    monkeypatch.setattr(ball_kmeans, "FEW_LABELS", few)
    monkeypatch.setattr(ball_kmeans, "HOT_SHARE", 0.4)
    rows = rows_of(150, entries)
    rows += [rows[3], rows[3], (None, rows[5][1], 7), (500, None, 1), (501, [None] + rows[0][1][1:], 1)]
    rows += [(502, [float("nan")] + rows[0][1][1:], 1), (503, rows[0][1][:-1] + [float("-inf")], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'x' as id", "'y' as code", "1 as x", "2 as n")
    got = ball_kmeans.encode_vectors(frame, parts=4, entries=entries, rounds=rounds).collect()
    assert sorted(map(key, got)) == sorted(map(key, brute(rows, 4, entries, rounds)))


def test_odd_vectors(spark):
    kinds = "vec_id long, embedding array<float>, label int"
    rows = [(1, [1.0, 2.0], 3), (2, [1.5, -2.0], 3), (3, [1.0], 3), (4, [], 4), (5, [1e30, -1e30], None), (6, None, None)]
    got = {r["vec_id"]: r for r in ball_kmeans.encode_vectors(spark.createDataFrame(rows, kinds), parts=2).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and got[1]["code"] == "0000" and got[5]["error"] == 0
    assert got[3]["code"] is None and got[3]["label_error"] == 0 and got[4]["label_error"] is None
    assert ball_kmeans.encode_vectors(spark.createDataFrame([], kinds)).count() == 0
    assert ball_kmeans.encode_vectors(spark.createDataFrame([(4, [], 4)], kinds)).collect()[0]["code"] is None


def test_rings_skip_most_distances():
    draw = np.random.default_rng(1)
    middles = draw.integers(-20_000, 20_000, (64, 4))
    x = middles[draw.integers(0, 64, 5_000)] + draw.integers(-300, 300, (5_000, 4))
    before, far = ball_kmeans.nearest_of_all(x, middles)
    moved = middles + draw.integers(-20, 20, (64, 4))
    radius = np.zeros(64, np.int64)
    np.maximum.at(radius, before, np.sqrt(far).astype(np.int64) + 1)
    radius += np.sqrt(((moved - middles) ** 2).sum(axis=1)).astype(np.int64) + 1
    order, dist = ball_kmeans.Codebooks(moved[None], radius[None]).neighbours()
    best, least, computed = ball_kmeans.nearest_by_balls(x, before, moved, order[0], dist[0])
    want, d = ball_kmeans.nearest_of_all(x, moved)
    assert (best == want).all() and (least == d).all()
    assert computed < 0.1 * 64 * len(x)


def test_ties_go_to_the_lower_entry():
    entries = np.array([[4, 0], [0, 0], [4, 0], [8, 0]])
    order, dist = ball_kmeans.Codebooks(entries[None], np.full((1, 4), 100)).neighbours()
    for before in range(4):
        x = np.array([[2, 0], [6, 0], [4, 0]])
        best, _, _ = ball_kmeans.nearest_by_balls(x, np.full(3, before), entries, order[0], dist[0])
        assert best.tolist() == [0, 0, 0]
