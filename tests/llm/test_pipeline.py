import corpus_pipeline
from tests.llm.test_decontaminate import brute
from tests.llm.test_ngram_join import brute as all_pairs
from tests.llm.test_packing import check_pieces


def test_stages_against_brute_force(spark, sf, docs, tmp_path):
    frame, seen = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, frame, sf).write.parquet(path)
        seen.append((name, frame, spark.read.parquet(path)))
        frame = seen[-1][2]
    assert [n for n, *_ in seen] == ["quality classifier", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "packing"]
    for _, before, after in seen[:-1]:
        assert after.columns == docs.columns and after.exceptAll(before).count() == 0 and 0 < after.count() < before.count()
    rows_of = lambda f: sorted((r["doc_id"], r["text"]) for r in f.collect())
    _, before, after = seen[2]
    rows = rows_of(before)
    classes = all_pairs(rows)[0]
    assert [i for i, _ in rows_of(after)] == sorted({rows[c][0] for c in classes})
    _, before, after = seen[3]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    clean = []
    for i, t in rows_of(before):
        n, hit, _ = brute(t, items)
        if not (hit and 20 * hit >= n):
            clean.append(i)
    assert [i for i, _ in rows_of(after)] == clean
    _, before, after = seen[4]
    pieces = check_pieces(after.collect(), None, 1024)
    assert sorted(pieces) == sorted(r["doc_id"] for r in before.select("doc_id").collect())


def test_run_and_odd_rows(spark, sf, odd_docs, no_docs):
    for frame in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, sf)
            assert out.columns == frame.columns
            out.count()
    assert corpus_pipeline.run(spark, sf).count() > 0
