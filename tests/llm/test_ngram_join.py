import collections
import itertools

import pytest

from tickloom.llm import ngram_join
from tickloom.llm.common import words_of


def grams(text):
    w = words_of(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else None


def brute(rows):
    """Class (least row of the component) and links of each row, by all pairs."""
    sets = [grams(t) for _, t in rows]
    root, links = list(range(len(rows))), collections.Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = sets[a], sets[b]
        alike = (rows[a][1] or "") == (rows[b][1] or "") if x is None or y is None else 5 * len(x & y) >= 4 * len(x | y)
        if alike:
            links[a] += 1
            links[b] += 1
            p, q = top(a), top(b)
            root[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(rows))], links


@pytest.fixture(scope="module")
def families(spark):
    """Families of near copies at many distances, copies, and short texts."""
    rows = []
    for family in range(4):
        base = [f"f{family}w{k * 7 % 61}" for k in range(120)]
        for edit in range(25):
            words = list(base)
            for k in range(edit % 6):
                words[(edit * 13 + k * 29) % 120] = f"e{edit}x{k}"
            rows.append((len(rows), " ".join(words)))
        rows.append((len(rows), " ".join(base).upper() + "!"))
    rows += [(len(rows) + k, t) for k, t in enumerate(["a b", "A, b", "", None, "***", "***", "!!"])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [256, 4])
def test_links_and_classes(families, block):
    rows, frame = families
    classes, links = brute(rows)
    got = {r["doc_id"]: r for r in ngram_join.near_classes(frame, block=block).collect()}
    assert len(got) == len(rows)
    assert [got[i]["class_id"] for i, _ in rows] == classes
    assert [got[i]["n_links"] for i, _ in rows] == [links[i] for i, _ in rows]


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(f"n{k:03}", f"n{k + 1:03}") for k in range(60)] + [("x", "y"), ("x", "x")], "a string, b string")
    roots = {r["node"]: r["root"] for r in ngram_join.components(edges).collect()}
    assert {roots[f"n{k:03}"] for k in range(61)} == {"n000"} and roots["y"] == "x"


def test_one_of_each_stays(odd_docs, no_docs, families):
    rows, frame = families
    kept = sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(frame).collect())
    assert kept == sorted(set(brute(rows)[0]))
    out = ngram_join.keep_one_of_each(odd_docs)
    assert out.columns == odd_docs.columns
    ids = collections.Counter(r["doc_id"] for r in out.collect())
    assert set(ids) == {0, 2, 3, 4, 5, 6, 8, 10, 11, None}  # 1 and the null row are as empty as 0, 7 as 6, 9 as 8
    assert max(ids.values()) == 1
    assert ngram_join.keep_one_of_each(no_docs).count() == 0


def test_repeated_rows_of_one_id(spark):
    """Copies under one id, or none, beside a near copy of theirs."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(7, base)] * 300 + [(None, base)] * 300 + [(9, base + " more")]
    got = ngram_join.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 601 and {r["class_id"] for r in got} == {7}
    assert {(r["doc_id"], r["n_links"]) for r in got} == {(7, 600), (None, 600), (9, 600)}
