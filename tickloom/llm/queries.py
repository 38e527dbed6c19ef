"""The registered queries of this subpackage and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import (
    ball_kmeans, chat_format, decontaminate, fingerprint, html_extract, lm_score, ngram_join, packing, prefix_trie, quality, sharding,
    toxicity, url_filter,
)
from tickloom.llm.common import table


def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 1,024."""
    return with_digest(packing.pack(table(spark, sf_dir, "documents")))


def with_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def _url_sql() -> str:
    """The same verdicts: one expression per rule and per term."""
    fits = [
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}={r.verdict}'"
        for r in sorted(URL_RULES, key=lambda r: -len(r.text))
    ]
    term = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')"
    strict = ", ".join(f"CASE WHEN {term(t)} THEN '{t}' END" for t in sorted(url_filter.STRICT_TERMS))
    soft = ", ".join(f"CASE WHEN {term(t)} THEN '{t}' END" for t in sorted(url_filter.SOFT_TERMS))
    weight = " + ".join(f"CASE WHEN {term(t)} THEN {w} ELSE 0 END" for t, w in sorted(url_filter.SOFT_TERMS.items()))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), '{upper}', '{lower}') AS low,
    CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u),
h AS (
  SELECT page_id, host, path, CASE {" ".join(fits)} END AS fit,
    concat_ws(' ', {strict}) AS strict_terms, concat_ws(' ', {soft}) AS soft_terms,
    CAST({weight} AS INTEGER) AS soft_weight
  FROM p)
SELECT page_id, host, path, split_part(fit, '=', 1) AS rule,
  coalesce(split_part(fit, '=', 2), CASE WHEN strict_terms <> '' OR soft_weight >= {url_filter.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  strict_terms, soft_terms, soft_weight
FROM h"""


def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of eight shards along a curve over language, source and length."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").withColumns(
        {
            "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
            "text_crc32": F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8")),
        }
    )
    return sharding.hilbert_shards(docs, ["lang", "source", "n_chars"], bits=5, salt=("text_crc32",)).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "curve",
    )


def benchmark_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document stands in the benchmark."""
    docs = decontaminate.with_matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = "contamination"
    items = F.array_sort(F.transform(f"{c}.items", lambda i: i.cast("string")))
    return docs.select(
        "doc_id",
        F.col(f"{c}.n_words").alias("n_words"),
        F.col(f"{c}.n_hit").alias("n_hit"),
        F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        decontaminate.is_contaminated(F.col(f"{c}.n_words"), F.col(f"{c}.n_hit")).alias("contaminated"),
    )


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

_MATCHES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT DISTINCT r, i, n, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned from rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity_score(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def quality_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every document is good, by its text and by its site."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    judged = quality.with_quality(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "judgement.*")


def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-copy class of every document, and how many documents it is linked to."""
    return ngram_join.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def fingerprint_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts that are near those of the documents whose id is divisible by 50."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprint.near_texts(docs.where("doc_id % 50 = 0"), docs)


def backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff scores of every document under the trigram counts of all others."""
    return lm_score.backoff_scores(table(spark, sf_dir, "documents"))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    texts = html_extract.extract_main_text(table(spark, sf_dir, "pages"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A code of 16 bytes for every embedding, and what it loses."""
    return ball_kmeans.encode_vectors(table(spark, sf_dir, "embeddings"))


def _codes_sql(rounds: int = ball_kmeans.ROUNDS) -> str:
    """The same codes by comparing every part with every entry, for vectors of 64 components."""
    width, parts, entries = 4, ball_kmeans.PARTS, ball_kmeans.ENTRIES
    comps = range(1, width + 1)
    distance = " + ".join(f"(p.x{i} - e.x{i}) * (p.x{i} - e.x{i})" for i in comps)
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
  SELECT r, part, m % {entries} AS e, m // {entries} AS d
  FROM (SELECT p.r, part, min(({distance}) * {entries} + e.e) AS m FROM p JOIN e{k} e USING (part) GROUP BY p.r, part))""")
        if k < rounds:
            moved = ", ".join(f"coalesce(n.x{i}, e.x{i}) AS x{i}" for i in comps)
            means = ", ".join(f"CAST(floor(CAST(sum(x{i}) AS DOUBLE) / count(*)) AS BIGINT) AS x{i}" for i in comps)
            steps.append(f"""e{k + 1} AS MATERIALIZED (
  SELECT e.part, e.e, {moved}
  FROM e{k} e LEFT JOIN (SELECT part, e, {means} FROM p JOIN a{k} USING (r, part) GROUP BY part, e) n USING (part, e))""")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT r, part, {", ".join(f"v[part * {width} + {i}] AS x{i}" for i in comps)}
  FROM k, (SELECT unnest(range({parts})) AS part)),
e0 AS MATERIALIZED (
  SELECT part, e, {", ".join(f"x{i}" for i in comps)}
  FROM p JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM k ORDER BY vec_id, v LIMIT {entries}) USING (r)),
{", ".join(steps)},
c AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
books AS (
  SELECT sha256(string_agg(concat_ws(',', {", ".join(f"x{i}" for i in comps)}), ',' ORDER BY part, e)) AS codebooks_sha256 FROM e{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256, label
FROM k JOIN c USING (r), books"""


def formatted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from every conversation's formatted text, and from that of one which says control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat_format.read_back(chat_format.format_conversations(turns.unionByName(extra)), in_order=True)


_FORMATTED_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS said,
    replace(replace(replace(replace(role, '\', '\\'), chr(10), '\' || chr(10)), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS who
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(who) + length(said) + length('<turn>' || '</turn>') + 2) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared beginning of conversations, once each family has its first turns in common."""
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"), rebuild=True)


_CRC32_SQL = """(SELECT list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 1, 2, 3, 4, 5, 6, 7]),
      lambda v, k: xor(v >> 1, (v & 1) * 3988292384))))"""

_TRIE_SQL = rf"""
WITH own AS (
  SELECT conv_id,
    list({{'k': CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''),
      'w': len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))}} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, conv_id - conv_id % 20 AS base, xor({_CRC32_SQL}, 4294967295) % 4 AS h FROM own),
paths AS MATERIALIZED (
  SELECT h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) AS turns
  FROM h LEFT JOIN own b ON b.conv_id = h.base),
steps AS MATERIALIZED (
  SELECT conv_id, d, len(turns) AS n, CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w,
    md5(CAST(list_transform(turns[1:d], lambda t: sha256(t.k)) AS VARCHAR)) AS node,
    CASE WHEN d > 0 THEN md5(CAST(list_transform(turns[1:d - 1], lambda t: sha256(t.k)) AS VARCHAR)) END AS parent
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM paths)),
nodes AS MATERIALIZED (
  SELECT node, parent, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own_saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = n), '')) AS ends_sha256
  FROM steps GROUP BY node, parent, d),
kids AS (SELECT parent AS node, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT s.node, count(*) FILTER (k.node IS NULL) AS n_leaves, sum(u.own_saved) AS saved_tokens
  FROM nodes u JOIN steps s ON s.conv_id = u.conv_id AND s.d <= u.depth LEFT JOIN kids k ON k.node = u.node GROUP BY s.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
  b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b USING (node) LEFT JOIN kids k USING (node) LEFT JOIN nodes p ON p.node = n.parent"""


QUERIES = {
    "op1_pack_sequences": pack_sequences,
    "op2_url_verdicts": url_verdicts,
    "op3_hilbert_shards": hilbert_shards,
    "op4_benchmark_matches": benchmark_matches,
    "op5_main_texts": main_texts,
    "op6_quality_judgements": quality_judgements,
    "op7_fingerprints": fingerprints,
    "fingerprint_neighbours": fingerprint_neighbours,
    "op8_backoff_scores": backoff_scores,
    "op9_ngram_jaccard": ngram_jaccard,
    "op10_toxicity_scores": toxicity_scores,
    "op11_vector_codes": vector_codes,
    "op12_formatted_conversations": formatted_conversations,
    "op13_conversation_trie": conversation_trie,
}

SQL: dict[str, str] = {
    "op2_url_verdicts": _url_sql(),
    "op4_benchmark_matches": _MATCHES_SQL,
    "op11_vector_codes": _codes_sql(),
    "op12_formatted_conversations": _FORMATTED_SQL,
    "op13_conversation_trie": _TRIE_SQL,
}
