import hashlib

import numpy as np
import pytest

from tickloom.llm import fingerprint, minhash


@pytest.mark.parametrize("bucket", [4_000_000, 20_000])
def test_edited_and_next(docs, texts, bucket):
    got = {r["doc_id"]: r for r in fingerprint.compare_with_next(docs, bucket_chars=bucket).collect()}
    ids = sorted(texts)
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, following = texts[i], ids[(k + 1) % len(ids)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + texts[following][:cut]
        r = got[i]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(text)
        a, b, c = minhash.signatures([text, edited, texts[following]], 128)
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprint.printed(np.stack([a, b]))
        same = lambda x, y: float(((x & 0xFFFF) == (y & 0xFFFF)).mean())
        assert (r["near_edited"], r["near_next"]) == (same(a, b), same(a, c))
        assert r["fingerprint"] == got[following]["fingerprint"] or r["near_next"] < 1


def test_likeness_estimates_jaccard():
    base = [f"w{k}" for k in range(2000)]
    other = base[:1500] + [f"v{k}" for k in range(500)]
    a, b = minhash.signatures([" ".join(base), " ".join(other)], 128)
    assert abs((a == b).mean() - 1496 / (1996 * 2 - 1496)) < 0.12


def test_long_texts_in_parts_agree():
    text = " ".join(f"w{k}" for k in range(3 * minhash.STEP))
    whole = minhash.signatures([text], 8)[0]
    grams, starts = minhash.shingles(*minhash.hashed_words([text]), 5)
    halves = [minhash.minima(grams[a:b], np.array([0, b - a]), 8)[0] for a, b in ((0, 5000), (5000, len(grams)))]
    assert (whole == np.minimum(*halves)).all()


def test_odd_rows(odd_docs, no_docs, spark):
    rows = fingerprint.compare_with_next(odd_docs, bucket_chars=1000).collect()
    assert len(rows) == odd_docs.count()
    print_of = {r["doc_id"]: r["fingerprint"] for r in rows if r["doc_id"] is not None}
    assert print_of[0] == print_of[1] == "f" * 512 and print_of[8] == print_of[9] and print_of[3] != print_of[4]
    assert fingerprint.compare_with_next(no_docs).count() == 0
    one = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string")
    assert fingerprint.compare_with_next(one).first()["near_next"] == 1.0


def test_near_pairs(docs, texts):
    found = {(r["query"], r["id"]) for r in fingerprint.near_pairs(docs.where("doc_id % 50 = 0"), docs).collect()}
    from tests.llm.test_ngram_join import grams

    sets = {i: grams(t) for i, t in texts.items()}
    want = {(q, i) for q in texts if q % 50 == 0 and sets[q] for i in texts if sets[i] and 5 * len(sets[q] & sets[i]) >= 4 * len(sets[q] | sets[i])}
    assert want <= found | {(q, i) for q, i in want if texts[q] == texts[i]} and {(q, i) for q, i in found if sets[q]} <= want


def test_copies_make_no_pairs_of_nodes(spark):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(k, base.upper() if k % 2 else base) for k in range(600)] + [(600, base + " x"), (601, "none of it at all here"), (None, ""), (602, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    some = frame.where("doc_id % 50 = 0 or doc_id is null")
    pairs, asking, asked = fingerprint.near_nodes(some, frame)
    assert pairs.count() == 5 and asking.count() == some.count() and asked.count() == len(rows)
    found = [tuple(r) for r in fingerprint.near_pairs(some, frame).select("query", "id").collect()]
    want = {(q, i) for q in range(0, 601, 50) for i in range(601)} | {(None, None), (None, 602)}
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("block", [256, 3])
def test_near_texts_of_families(spark, block):
    """A family of different near copies and one of copies, against all pairs of whole sets."""
    from tests.llm.test_ngram_join import grams

    rows = []
    for k in range(120):
        words = [f"w{j}" for j in range(100)]
        for e in range(k % 4):
            words[(k * 13 + 31 * e) % 100] = f"e{k}x{e}"
        rows.append((k, " ".join(words)))
    rows += [(200 + k, "The same, again and again: nothing new!" if k % 2 else "the same again and again nothing new") for k in range(101)]
    rows += [(400, None), (401, ""), (None, ""), (450, "***"), (451, "***"), (500, "alone with its words here")] * 2
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, key string, bucket string")
    got = fingerprint.near_texts(frame.where("doc_id % 50 = 0"), frame, block=block).collect()
    kinds = {}
    for i, t in rows:
        kinds.setdefault(tuple(minhash.hashed_words([t])[0].tolist()) or (t or ""), []).append((i, t))
    want = set()
    for asked in kinds.values():
        queries = [i for i, _ in asked if i is not None and i % 50 == 0]
        for other in kinds.values():
            x, y = grams(asked[0][1]), grams(other[0][1])
            jaccard = len(x & y) / len(x | y) if x and y else float(other is asked)
            if queries and jaccard >= 0.8:
                want.add((min(queries), len(queries), min(i for i, _ in other if i is not None), len(other), round(jaccard, 9)))
    assert {(r["query_id"], r["n_queries"], r["match_id"], r["n_matches"], round(r["jaccard"], 9)) for r in got} == want
    assert len(got) == len(want)


def test_near_texts_of_odd_rows(odd_docs, no_docs):
    assert fingerprint.near_texts(no_docs, odd_docs).count() == fingerprint.near_texts(odd_docs, no_docs).count() == 0
    rows = {r["query_id"]: r for r in fingerprint.near_texts(odd_docs, odd_docs).collect()}
    assert rows[0]["n_queries"] == rows[0]["n_matches"] == 3  # ids 0, 1 and null
    assert rows[8]["match_id"] == 8 and rows[8]["n_matches"] == 2
