import collections
import math

import numpy as np
import pytest

from tickloom.llm import lm_score
from tickloom.llm.common import words_of


def brute(rows, order, exclude_self, backoff=0.4):
    texts = [words_of(t) for _, t in rows]
    grams = lambda w: [tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)]
    counts = collections.Counter(g for w in texts for g in grams(w))
    total, out = sum(map(len, texts)), []
    for w in texts:
        own = collections.Counter(grams(w)) if exclude_self else collections.Counter()
        n, score = total - (len(w) if exclude_self else 0), 0.0
        for k in range(len(w)):
            factor = 1.0
            for context in range(min(k, order - 1), -1, -1):
                g = tuple(w[k - context : k + 1])
                c = counts[g] - own[g]
                if context == 0:
                    score += math.log(factor * max(c, 0.5) / max(n, 1))
                    break
                if c > 0:
                    score += math.log(factor * c / (counts[g[:-1]] - own[g[:-1]]))
                    break
                factor *= backoff
        out.append((len(w), score))
    return out


@pytest.mark.parametrize(("order", "exclude_self", "chunk"), [(3, True, 16_000_000), (3, True, 50_000), (2, False, 100_000), (1, True, 100_000)])
def test_scores(spark, texts, order, exclude_self, chunk):
    rows = [(i, t) for i, t in texts.items()][:80] + [(1000, None), (1001, "***"), (1002, "a b a b a b a"), (None, "a b")]
    rows.append(rows[3])
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as chunk", "'y' as id")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["log_score"]) for r in lm_score.backoff_scores(frame, order=order, exclude_self=exclude_self, chunk_chars=chunk).collect())
    want = sorted((i if i is not None else -1, n, s) for (i, _), (n, s) in zip(rows, brute(rows, order, exclude_self), strict=True))
    assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
    assert all(abs(g[2] - w[2]) < 1e-8 * max(1, abs(w[2])) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize(("order", "exclude_self"), [(3, True), (2, False)])
def test_plain_form(spark, texts, order, exclude_self):
    rows = [(i, t) for i, t in texts.items()][:40] + [(1000, None), (1001, "***"), (1002, "a b a b a b a"), (None, "a b")]
    rows.append(rows[3])
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as row", "'y' as id")
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_words"])
    plain = sorted(lm_score.plain_scores(frame, order, exclude_self=exclude_self).collect(), key=key)
    packed = sorted(lm_score.backoff_scores(frame, order, exclude_self=exclude_self, chunk_chars=50_000).collect(), key=key)
    assert list(map(key, plain)) == list(map(key, packed))
    assert all(abs(a["log_score"] - b["log_score"]) < 1e-8 * max(1, abs(b["log_score"])) for a, b in zip(plain, packed, strict=True))
    assert lm_score.plain_scores(frame.where("false")).count() == 0


def test_equal_rows_are_dealt_to_several_chunks(spark):
    frame = spark.createDataFrame([(1, "same text again")] * 400 + [(2, "other words")], "doc_id long, text string").repartition(16)
    rows = lm_score.backoff_scores(frame, chunk_chars=500).collect()
    assert len(rows) == 401 and len({r["log_score"] for r in rows if r["doc_id"] == 1}) == 1


def test_odd_rows(odd_docs, no_docs):
    rows = lm_score.backoff_scores(odd_docs, chunk_chars=10_000).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["mean_log_score"] is None and r["log_score"] == 0 for r in rows if r["n_words"] == 0)
    assert lm_score.backoff_scores(no_docs).count() == 0


@pytest.mark.parametrize("bits", [9, 20, 34, 47, 48])
@pytest.mark.parametrize("n", [1, 2, 3000])
def test_packed_hashes_come_back(bits, n):
    values = np.unique(np.random.default_rng(bits).integers(0, 1 << bits, n).astype(np.uint64))
    values[-1] = (1 << bits) - 1  # the longest step there is, where there is one value
    raw = lm_score._pack(values)
    assert (lm_score._unpack(raw) == values).all() and lm_score._packed_size(raw) == len(values)
    edge = np.array([0, 0xFFFE, 0xFFFE + 0xFFFF, (1 << 48) - 1], np.uint64)
    assert (lm_score._unpack(lm_score._pack(edge)) == edge).all()
    spread = np.arange(1, 100_001, dtype=np.uint64) << np.uint64(31)
    assert len(lm_score._pack(spread)) == 5 + 4 * len(spread)
