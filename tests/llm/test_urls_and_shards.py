import zlib

from tickloom.llm import queries, sharding, url_filter


def test_terms_need_free_edges():
    automaton = url_filter._automaton(("bet", "free", "porn"))
    found = lambda u: url_filter.found_terms(u, automaton)
    assert found("free-bet.com") == {"free", "bet"}
    assert found("freebet.com/alphabet") == set()
    assert found("http://x/porn") == {"porn"}
    assert found("") == set()


def test_verdicts(spark):
    urls = [
        None, "", "no scheme casino", "http://a.org/x", "http://A.Example.ORG/es/", "http://example.org/en/12?x", "http://evil.com/fr/",
        "http://evil.com/de/1", "https://free-bets.example.net", "https://free.example.net/free?free", "http://adult-x.example.net/#x",
        "http://norg/", "http://org", "http://notexample.org/es/", "ftp://x.net/:///a b",
    ]
    pages = spark.createDataFrame([(i, u, "h", "x") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages.union(pages), queries.URL_RULES).collect()}
    verdict = [(rows[i]["rule"], rows[i]["verdict"]) for i in range(len(urls))]
    assert verdict == [
        (None, "allow"), (None, "allow"), (None, "block"), ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
        ("com/fr/", "allow"), ("com/de/", "block"), (None, "block"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"),
        ("org/", "allow"), (None, "allow"),
    ]
    assert (rows[4]["host"], rows[4]["path"]) == ("a.example.org", "/es/") and (rows[0]["host"], rows[0]["path"]) == ("", "")
    assert url_filter.judge_urls(pages.where("false"), queries.URL_RULES).count() == 0


def test_curve_visits_neighbours():
    for d, bits in ((2, 3), (3, 3), (4, 2)):
        points = {}
        for code in range(1 << d * bits):
            point = [code >> bits * k & (1 << bits) - 1 for k in range(d)]
            points[sharding.curve_index(point, bits)] = point
        assert sorted(points) == list(range(1 << d * bits))
        for k in range(1, len(points)):
            assert sum(abs(a - b) for a, b in zip(points[k], points[k - 1], strict=True)) == 1


def check_law(rows, n, shards):
    """Shards differ by a row at most, slots have no gap, and the order of the curve is kept."""
    by = {k: sorted(r["slot"] for r in rows if r["shard"] == k) for k in range(shards)}
    sizes = [len(v) for v in by.values()]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(v == list(range(len(v))) for v in by.values())
    order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order)


def test_shards(docs, odd_docs, no_docs, tmp_path):
    for frame, spread in ((docs, 256), (docs, 3), (odd_docs, 2)):
        out = sharding.hilbert_shards(frame, ["lang", "source", "n_chars"], spread=spread)
        check_law(out.collect(), frame.count(), 8)
    assert set(odd_docs.columns) <= set(out.columns)
    assert sharding.hilbert_shards(no_docs, ["lang", "n_chars"]).count() == 0
    path = str(tmp_path / "out")
    sharding.write_shards(sharding.hilbert_shards(docs, ["lang", "source", "n_chars"]), path)
    back = docs.sparkSession.read.parquet(path)
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 8


def test_filters_skip_shards(spark):
    """A filter on any dimension reads fewer of 32 files, by their least and greatest values, than of rows in any order."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.hilbert_shards(docs, ["lang", "source", "n_chars"], n_shards=32, bits=5).collect()
    lengths = sorted(r["n_chars"] for r in rows)
    wanted = {
        "lang": [(v, v) for v in {r["lang"] for r in rows}],
        "source": [(v, v) for v in {r["source"] for r in rows}],
        "n_chars": [(lengths[k * len(rows) // 10], lengths[(k + 1) * len(rows) // 10 - 1]) for k in range(10)],
    }
    files = {}
    for r in rows:
        files.setdefault(r["shard"], []).append(r)
    for c, ranges in wanted.items():
        ends = [(min(r[c] for r in f), max(r[c] for r in f)) for f in files.values()]
        read = sum(sum(lo <= high and hi >= low for lo, hi in ends) for low, high in ranges) / len(ranges)
        assert read < 0.75 * len(files), (c, read)


def test_steps_follow_rows(spark):
    rows = [(k, v, float(k % 100) if k % 7 else None) for k, v in enumerate(["en"] * 900 + ["es"] * 30 + ["fr"] * 30 + ["de"] * 40)]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, x double")
    (lang, x), n = sharding.quantised(frame, ["lang", "x"], 4)
    got = frame.select("lang", "x", lang.alias("a"), x.alias("b")).collect()
    steps = {r["lang"]: r["a"] for r in got}
    assert n == 1000 and len(set(steps.values())) == 4 and sorted(steps, key=steps.get) == ["de", "en", "es", "fr"]
    sizes = [sum(r["b"] == k and r["x"] is not None for r in got) for k in range(16)]
    assert max(sizes) < 1.5 * min(sizes) and all(r["b"] == 0 for r in got if r["x"] is None)


def test_shard_query(spark, sf, texts):
    for r in queries.hilbert_shards(spark, sf).collect():
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
