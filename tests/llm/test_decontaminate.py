import random

from tickloom.llm import decontaminate
from tickloom.llm.common import words_of


def brute(text, items, window=13):
    words, hit, found = words_of(text), set(), set()
    for item, other in items:
        w = words_of(other)
        n = min(window, len(w))
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in grams:
                hit.update(range(k, k + n))
                found.add(item)
    return len(words), len(hit), sorted(found)


def test_random_texts(spark):
    random.seed(5)
    word = lambda: random.choice("ab cd ef gh ij é x1".split())
    items = [(k, " ".join(word() for _ in range(random.choice((0, 1, 3, 5, 14, 20))))) for k in range(12)]
    items += [items[5], (None, "zz zz zz"), (77, None)]
    texts = [" ".join(word() for _ in range(random.choice((0, 2, 9, 40)))) for _ in range(60)] + ["zz zz zz", items[9][1] + " x", None]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for window, block in ((5, 1 << 20), (13, 1 << 20), (5, 60)):
        out = decontaminate.with_matches(frame, bench, window=window, block_chars=block).collect()
        for r in out:
            c = r["contamination"]
            named = [x for x in items if x[0] is not None]
            n, n_hit, found = brute(texts[r["doc_id"]], items, window)
            assert (c["n_words"], c["n_hit"]) == (n, n_hit)
            assert c["items"] == brute(texts[r["doc_id"]], named, window)[2]
            words = words_of(texts[r["doc_id"]])
            of = {}
            for k, t in items:
                of.setdefault(k, words_of(t))
            for m in c["matches"]:
                a = words[m["doc_start"] : m["doc_start"] + m["length"]]
                assert a == of[m["item"]][m["item_start"] : m["item_start"] + m["length"]]


def test_odd_rows(odd_docs, no_docs, spark):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, ""), (None, None)], "item_id long, text string")
    kept = decontaminate.decontaminate(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert kept.count() == odd_docs.count() - 4
    assert decontaminate.decontaminate(no_docs, bench).count() == 0
    assert decontaminate.decontaminate(odd_docs, bench.where("false")).count() == odd_docs.count()
