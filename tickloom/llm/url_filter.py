"""URL verdicts: host rules, else a weighted vocabulary found by an Aho-Corasick automaton.

One automaton over all terms reads a url once.  A hit counts only where no ASCII letter or digit touches it.  A url
is blocked for one strict term, or when its distinct soft terms weigh enough together.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import lower_ascii

STRICT_TERMS = (
    "adult", "casino", "casinos", "escort", "escorts", "hentai", "nsfw", "porn", "porno", "sexcam", "spam", "viagra",
    "warez", "xxx",
)
#: Soft terms and their weights; a url is blocked at SOFT_LIMIT, counted over distinct terms.
SOFT_TERMS = {
    "ads": 1, "bet": 1, "bets": 1, "betting": 1, "bingo": 1, "bonus": 1, "cheap": 1, "click": 1, "coupon": 1,
    "crack": 1, "dating": 1, "deals": 1, "farm": 1, "free": 1, "gambling": 1, "jackpot": 1, "keygen": 1, "loan": 1,
    "loans": 1, "lottery": 1, "nude": 1, "payday": 1, "pharma": 1, "pill": 1, "pills": 1, "poker": 1, "prize": 1,
    "replica": 1, "sex": 1, "sexy": 1, "slots": 1, "torrent": 1, "track": 1, "tracker": 1, "win": 1, "winner": 1,
}
SOFT_LIMIT = 2


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that fits, the longest first, as struct(rule, verdict); null where none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


@functools.lru_cache(maxsize=4)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for term in terms:
        out.add_word(term, term)
    out.make_automaton()
    return out


def _touches(c: str) -> bool:
    return c.isascii() and c.isalnum()


def found_terms(url: str, automaton) -> set[str]:
    """Distinct terms of the automaton in the url that no ASCII letter or digit touches."""
    out = set()
    for end, term in automaton.iter(url):
        begin = end - len(term) + 1
        if (begin == 0 or not _touches(url[begin - 1])) and (end + 1 == len(url) or not _touches(url[end + 1])):
            out.add(term)
    return out


def term_hits(strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = tuple(SOFT_TERMS)):
    """A column function: distinct strict and soft terms of a url, each sorted."""
    strict, soft = tuple(sorted(strict)), tuple(sorted(set(soft) - set(strict)))
    kind = T.StructType([T.StructField(n, T.ArrayType(T.StringType())) for n in ("strict", "soft")])

    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, is_strict = _automaton(strict + soft), frozenset(strict)
        for urls in batches:
            found = [sorted(found_terms(u, automaton)) for u in urls]
            yield pd.DataFrame(
                {"strict": [[t for t in f if t in is_strict] for f in found], "soft": [[t for t in f if t not in is_strict] for f in found]}
            )

    return F.pandas_udf(hits, kind)


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    strict: tuple[str, ...] = STRICT_TERMS,
    soft: dict[str, int] | None = None,
    soft_limit: int = SOFT_LIMIT,
    url_column: str = "url",
    id_column: str = "page_id",
) -> DataFrame:
    """id, host, path, rule, verdict (``allow`` or ``block``), strict_terms, soft_terms, soft_weight per row.

    The longest fitting rule decides (``rule`` names it), else the vocabulary.  Null, empty and malformed urls have an
    empty host and path; terms are sought in the whole url, so one without ``://`` is still judged.  Repeated rows
    give repeated results, an empty table an empty one; other columns are not read.  Nothing is shuffled.
    """
    weights = SOFT_TERMS if soft is None else soft
    url = pages[url_column].cast("string")
    judged = pages.select(
        pages[id_column],
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        term_hits(strict, tuple(weights))(lower_ascii(F.coalesce(url, F.lit("")))).alias("hits"),
    )
    weight = sum((F.when(F.array_contains("hits.soft", t), w).otherwise(0) for t, w in sorted(weights.items())), F.lit(0))
    judged = judged.withColumn("fit", longest_rule(F.col("host"), F.col("path"), rules)).withColumn("weight", weight)
    blocked = (F.size("hits.strict") > 0) | (F.col("weight") >= soft_limit)
    return judged.select(
        id_column,
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.array_join("hits.strict", " ").alias("strict_terms"),
        F.array_join("hits.soft", " ").alias("soft_terms"),
        F.col("weight").cast("int").alias("soft_weight"),
    )
