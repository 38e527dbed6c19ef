import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import quality, queries, toxicity


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(2)
    n, balance = 20_000, 0.2
    y = (rng.random(n) < balance).astype(int)
    votes = np.full((n, 4), toxicity.ABSTAIN)
    for j, (hit, false) in enumerate([(0.8, 0.02), (0.6, 0.01), (0.7, 0.05)]):
        votes[:, j] = np.where(rng.random(n) < np.where(y == 1, hit, false), toxicity.TOXIC, toxicity.ABSTAIN)
    votes[:, 3] = np.where((votes[:, :3] == toxicity.TOXIC).any(axis=1), toxicity.ABSTAIN, toxicity.CLEAN)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # a voter that repeats the first
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = toxicity.fit_label_model(patterns, counts.astype(float))
    assert model.correlation[0, 4] > 0.9 and model.weights[0] < model.weights[1]
    p = model.posterior(patterns)[inverse.ravel()]
    assert abs(model.balance - balance) < 0.06
    assert ((p > 0.5) == (y == 1)).mean() > 0.93


def test_linear_model_learns_soft_targets():
    hits = [[0], [0, 1], [1], []] * 50
    w, b = toxicity.fit_linear(hits, np.array([0.9, 0.9, 0.1, 0.1] * 50), np.zeros(2), 0.0)
    assert w[0] > 2 and abs(w[1]) < 0.5 and b < 0


def test_classifier_is_trained_on_posteriors_alone(docs, labels, monkeypatch):
    fitted, targets = [], []
    fit_model, fit_linear = toxicity.fit_label_model, toxicity.fit_linear
    monkeypatch.setattr(toxicity, "fit_label_model", lambda patterns, *rest: fitted.append((m := fit_model(patterns, *rest), patterns)) or m)
    monkeypatch.setattr(toxicity, "fit_linear", lambda hits, target, *rest: targets.append(target) or fit_linear(hits, target, *rest))
    toxicity.fit_toxicity(docs, labels)
    (model, patterns), (target,) = fitted[0], targets
    assert len(target) and np.isin(np.round(target, 9), np.round(model.posterior(patterns), 9)).all()


def test_rare_pure_terms_are_mined(spark):
    toxic = [(f"zorkle a{k} b{k} word" if k < 10 else f"scum c{k} d{k} word", 1) for k in range(1200)]
    clean = [(f"kind e{k} f{k} word" + " mixed" * (k % 3 == 0), 0) for k in range(1200)]
    mixed = [(f"mixed g{k} h{k}", 1) for k in range(10)]
    labelled = spark.createDataFrame(toxic + clean + mixed, "t string, y int")
    assert [t for t in toxicity.mine_terms(labelled, "t", "y") if not t.endswith("*")] == ["scum", "zorkle"]


def test_toxicity_on_held_out_rows(spark, docs, labels):
    scored = queries.toxicity_scores(spark, "/root/testdata/sf0.01")
    judged = scored.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rows = judged.where("held_out").select("predicted", "toxic").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.6 * sum(r["toxic"] for r in rows) and hit >= 0.9 * sum(r["predicted"] for r in rows)
    assert scored.where("score is null or score < 0 or score > 1").count() == 0


def test_labels_of_held_out_rows_do_not_matter(docs, labels):
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    flipped = flipped.withColumn("quality", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs, flipped)
    assert (a.terms, a.bias) == (b.terms, b.bias)
    x, y = quality.fit_quality(docs, labels), quality.fit_quality(docs, flipped)
    assert np.array_equal(x.weights, y.weights)


def test_toxicity_odd_rows(odd_docs, no_docs, labels):
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    nothing = labels.where("false")
    assert toxicity.drop_toxic(odd_docs, nothing).count() == odd_docs.count()
    assert toxicity.drop_toxic(no_docs, nothing).count() == 0
    rows = [(k, "you are an idiot and a loser, pathetic scum" if k % 10 == 0 else f"a kind word {k}") for k in range(400)]
    some = odd_docs.sparkSession.createDataFrame(rows, "doc_id long, text string")
    assert [r[0] for r in toxicity.drop_toxic(some, nothing).collect()] == [k for k in range(400) if k % 10]


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    judged = queries.quality_judgements(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = judged.where("held_out").select("keep", "quality").collect()
    bad = [r for r in rows if not r["keep"]]
    assert sum(r["quality"] == 0 for r in bad) >= 0.95 * len(bad)
    assert sum(not r["keep"] for r in rows if r["quality"] == 0) >= 0.9 * sum(r["quality"] == 0 for r in rows)


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "a", 0.95)] * 400 + [("big", "b", 0.9)] * 100 + [("poor", "a", 0.2)] * 300 + [("small", "a", 0.05)] * 2 + [(None, None, 0.8)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    out, mean = quality.path_posteriors(scored, "p", "host", "path")
    of = {(r["g_host"], r["g_path"]): r for r in out.collect()}
    assert len(of) == 5 and abs(mean - (sum(p for *_, p in rows) + 1) / (len(rows) + 2)) < 1e-9
    assert of["big", "a"]["path_probability"] > 0.85 and of["poor", "a"]["path_probability"] < 0.4
    assert 0.3 < of["small", "a"]["path_probability"] < mean  # two bad documents count for little
    assert of[None, None]["host_probability"] > 0


def test_quality_odd_rows(odd_docs, no_docs, labels):
    kept = quality.keep_good(odd_docs, labels.where("false"))
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    judged = quality.with_quality(odd_docs, labels).collect()
    assert len(judged) == odd_docs.count() and all(0 <= r["judgement"]["probability"] <= 1 for r in judged)
    assert quality.keep_good(no_docs, labels).count() == 0


def brute_quality(rows, model):
    """Host and path posteriors and the final odds by plain loops over (id, text, host, path)."""
    import math

    logit = [float(model.logits(np.array([quality.signals(t)], float))[0]) for _, t, _, _ in rows]
    p = [1 / (1 + math.exp(-x)) for x in logit]
    paths, hosts = {}, {}
    for (_, _, h, q), x in zip(rows, p, strict=True):
        paths.setdefault((h, q), []).append(x)
        hosts.setdefault(h, []).append(x)
    n = len(rows)
    mean = min(max((sum(p) + 1) / (n + 2), 1e-6), 1 - 1e-6)
    between = sum(sum(v) ** 2 / len(v) for v in hosts.values()) / n - mean**2
    k_host = quality.strength(between, mean, len(hosts) / n)
    host = {h: (sum(v) + k_host * mean) / (len(v) + k_host) for h, v in hosts.items()}
    away = sum(len(v) * (sum(v) / len(v) - sum(hosts[h]) / len(hosts[h])) ** 2 for (h, _), v in paths.items()) / n
    k_path = quality.strength(away, mean, len(paths) / n)
    path = {(h, q): (sum(v) + k_path * host[h]) / (len(v) + k_path) for (h, q), v in paths.items()}
    odds = lambda x: math.log(x / (1 - x))
    out = []
    for (i, _, h, q), x in zip(rows, logit, strict=True):
        final = 1 / (1 + math.exp(-(x + odds(path[h, q]) - odds(mean))))
        out.append((i, 1 / (1 + math.exp(-x)), host[h], path[h, q], final))
    return out


def test_quality_equals_plain_loops(spark, docs, labels):
    odd = spark.createDataFrame([(None, None, None, None), (9_000_001, "", "src0", None), (9_000_002, "one word", "lonely", "xx")], "doc_id long, text string, source string, lang string")
    frame = docs.select("doc_id", "text", "source", "lang").unionByName(odd)
    frame = frame.unionByName(frame.where("doc_id < 5"))
    model = quality.fit_quality(frame, labels)
    rows = [tuple(r) for r in frame.select("doc_id", "text", "source", "lang").collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    want = sorted(brute_quality(rows, model), key=key)
    got = sorted(((r["doc_id"], *r["judgement"]) for r in quality.with_quality(frame, labels).collect()), key=key)
    assert [r[0] for r in got] == [r[0] for r in want]
    for g, w in zip(got, want, strict=True):
        assert np.allclose(g[1:5], w[1:], atol=1e-9) and g[5] == (g[4] >= 0.5)
    kept = quality.keep_good(frame, labels).count()
    assert kept == sum(w[4] >= 0.5 for w in want) and 0 < kept < len(rows)
    assert len({(g[2], g[3]) for g in got}) > 10
