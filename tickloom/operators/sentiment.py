"""Lexicon sentiment of texts and of groups of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.constants import (
    AFTER_BUT, BEFORE_BUT, BOOST, BOOSTERS, CAPITALS, DAMPENERS, EXCLAMATION, FINANCE_LEXICON, MANY_QUESTIONS, MOST_EXCLAMATIONS,
    NEGATED, NEGATIONS, QUESTION,
)
from tickloom.functions.blocks import spread, with_ordinal
from tickloom.session import materialise

# Normalisation constant and label thresholds.
ALPHA = 15.0
THRESHOLD = 0.05
DECAY = 0.3

SHARES = ["compound", "positive", "negative", "neutral"]


def tokens(text: Column) -> Column:
    """Runs of letters of any script, apostrophes inside included."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}++(?:'\p{L}++)*+"), 0)


def finance_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FINANCE_LEXICON.items()), "term string, valence double")


def frequent_terms(texts: DataFrame, size: int = 200) -> DataFrame:
    """A lexicon from the corpus: its most frequent terms with valences from -2 to 2 by rank."""
    counts = spread(texts.select("text")).select(F.explode(tokens(F.lower("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c"))
    top = counts.orderBy(F.col("c").desc(), "term").limit(size)
    # At most ``size`` rows meet here.
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("c"), "term"))).alias("all"))
    ranked = ranked.select(F.posexplode("all").alias("r", "s"))
    return ranked.select(F.col("s.term").alias("term"), (((F.col("r") % 9) - 4) * 0.5).alias("valence"))


def label(compound: Column) -> Column:
    return F.when(compound >= THRESHOLD, "Bullish").when(compound <= -THRESHOLD, "Bearish").otherwise("Neutral")


#: A lexicon of up to so many terms becomes literals in the plan; a larger one is joined.
FEW_TERMS = 2_000


def _literal_valence(terms: dict[str, float]):
    """Valence of a term, null where the lexicon has none: one look-up for all terms, then one per distinct valence."""
    by_value: dict[float, list[str]] = {}
    for term, value in terms.items():
        by_value.setdefault(value, []).append(term)

    def look(term: Column) -> Column:
        found = F.lit(None).cast("double")
        for value, group in sorted(by_value.items(), key=lambda x: len(x[1])):
            found = F.when(term.isin(group), F.lit(float(value))).otherwise(found)
        return F.when(term.isin(list(terms)), found)

    return look


def with_valences(texts: DataFrame, lexicon: DataFrame, name: str = "_v") -> DataFrame:
    """Add the valence of every token of ``_low`` (null: not in the lexicon, whose terms are unique).

    A small lexicon, by its counted size, is a look-up inside the row, so nothing is shuffled.  A larger one is joined
    by term; the tokens of a row then meet again by the row's number.
    """
    rows = lexicon.select("term", F.col("valence").cast("double")).limit(FEW_TERMS + 1).collect()
    if len(rows) <= FEW_TERMS:
        look = _literal_valence({r["term"]: r["valence"] for r in rows})
        return texts.withColumn(name, F.transform("_low", look) if rows else F.transform("_low", lambda t: F.lit(None).cast("double")))
    numbered = materialise(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    words = numbered.select("_row", F.posexplode("_low").alias("_at", "term"))
    found = words.join(lexicon.select("term", F.col("valence").cast("double")), "term", "left")
    cells = F.array_sort(F.collect_list(F.struct("_at", "valence")))
    back = found.groupBy("_row").agg(F.transform(cells, lambda c: c["valence"]).alias(name))
    return numbered.join(back, "_row", "left").withColumn(name, F.coalesce(name, F.array().cast("array<double>"))).drop("_row")


#: Words that change the valence of what follows them; so does any word with "n't" in it.
ALTERING = [*BOOSTERS, *DAMPENERS, *NEGATIONS, "least"]


def _raises(word: Column) -> Column:
    return F.when(word.isin(BOOSTERS), BOOST).when(word.isin(DAMPENERS), -BOOST).otherwise(0.0)


def _negates(word: Column) -> Column:
    return word.isin(NEGATIONS) | F.contains(word, F.lit("n't"))


def _contribution(v: Column, i: Column) -> Column:
    """What token ``i`` adds: its valence after capitals and the three tokens before it.

    Few tokens follow an altering word, and only these go through the rules for what stands before them.
    """
    before = lambda array, d: F.get(array, i.cast("int") - d)
    sign = lambda x: F.when(x < 0, -1.0).otherwise(1.0)
    loud = F.when(F.col("_diff") & F.get("_caps", i.cast("int")), CAPITALS * sign(v)).otherwise(0.0)
    altered = lambda d: F.coalesce(before("_alters", d), F.lit(False))

    def nearer(value: Column, d: Column) -> Column:
        word = before("_low", d)
        boost = _raises(word)
        counts = altered(d) & before("_v", d).isNull()
        step = boost * sign(value) + F.when((boost != 0) & before("_caps", d) & F.col("_diff"), CAPITALS * sign(value)).otherwise(0.0)
        raised = value + step * F.element_at(F.array(F.lit(1.0), F.lit(0.95), F.lit(0.9)), d)
        close = (before("_low", 1), before("_low", 2))
        so = F.when(d == 2, close[0].isin("so", "this")).when(d == 3, close[0].isin("so", "this") | close[1].isin("so", "this")).otherwise(False)
        doubt = F.when(d == 2, close[0] == "doubt").when(d == 3, (close[0] == "doubt") | (close[1] == "doubt")).otherwise(False)
        factor = (
            F.when((word == "never") & so, 1.25)
            .when((word == "without") & doubt, 1.0)
            .when(_negates(word), NEGATED)
            .otherwise(1.0)
        )
        return F.when(counts, raised * factor).otherwise(value)

    plain = v + loud
    value = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), plain, nearer)
    least = (before("_low", 1) == "least") & before("_v", 1).isNull() & ~F.coalesce(before("_low", 2).isin("at", "very"), F.lit(False))
    value = F.when(F.coalesce(least, F.lit(False)), value * NEGATED).otherwise(value)
    value = F.when(altered(1) | altered(2) | altered(3), value).otherwise(plain)
    # A word that raises or lowers others, or is in no lexicon, is neutral itself.
    return F.when(v.isNull() | (altered(0) & (_raises(before("_low", 0)) != 0)), F.lit(0.0)).otherwise(value * _side(i))


def _side(i: Column) -> Column:
    """Weight of token ``i`` by the side of the first "but" it stands on."""
    return F.when(F.col("_but") < 0, 1.0).when(i < F.col("_but"), BEFORE_BUT).when(i > F.col("_but"), AFTER_BUT).otherwise(1.0)


def score_texts(texts: DataFrame, lexicon: DataFrame, keys: list[str]) -> DataFrame:
    """Compound score and shares of every row; a text without tokens, or null, is neutral.

    A token counts with its valence, changed by what stands around it: capitals among other words, words that raise or
    lower (up to three before it, the nearer the more), negations, a "but" that halves what comes before it, and
    exclamation and question marks of the text.  A row is one fold over its own tokens, so large tables are not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marks = lambda mark: F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    texts = spread(texts.select(*keys, "text"))
    df = texts.select(*keys, tokens(text).alias("_tok"), marks("!").alias("_bangs"), marks("?").alias("_asks"))
    df = df.withColumn("_low", F.transform("_tok", F.lower))
    df = with_valences(df, lexicon)
    df = df.withColumns(
        {
            "_alters": F.transform("_low", lambda t: t.isin(ALTERING) | F.contains(t, F.lit("n't"))),
            "_caps": F.transform("_tok", lambda t, i: (t != F.get("_low", i)) & (t == F.upper(t))),
            "_but": F.array_position("_low", "but") - 1,
        }
    )
    df = df.withColumn("_diff", F.exists("_caps", lambda c: c) & F.exists("_caps", lambda c: ~c))
    df = df.withColumn("_all", F.transform("_v", _contribution)).withColumn("_c", F.filter("_all", lambda c: c != 0))
    total = lambda pick: F.aggregate("_c", F.lit(0.0), lambda acc, c: acc + pick(c))
    bangs = F.least(F.col("_bangs"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION
    asks = F.when(F.col("_asks") > 3, MANY_QUESTIONS).when(F.col("_asks") > 1, F.col("_asks") * QUESTION).otherwise(0.0)
    sums = df.select(
        *keys, (bangs + asks).alias("_loud"), total(lambda c: c).alias("_s"),
        total(lambda c: F.when(c > 0, c + 1).otherwise(0.0)).alias("_p"), total(lambda c: F.when(c < 0, 1 - c).otherwise(0.0)).alias("_n"),
        (F.size("_all") - F.size("_c")).alias("_z"),
    )
    loud, zero = F.col("_loud"), F.lit(0.0)
    sums = sums.withColumns(
        {
            "_s": F.col("_s") + F.when(F.col("_s") > 0, loud).when(F.col("_s") < 0, -loud).otherwise(zero),
            "_p": F.col("_p") + F.when(F.col("_p") > F.col("_n"), loud).otherwise(zero),
            "_n": F.col("_n") + F.when(F.col("_p") < F.col("_n"), loud).otherwise(zero),
        }
    )
    total = F.col("_p") + F.col("_n") + F.col("_z")
    share = lambda c, empty: F.when(total > 0, F.round(F.col(c) / total, 3)).otherwise(F.lit(empty))
    out = sums.select(
        *keys,
        F.round(F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + ALPHA), 4).alias("compound"),
        share("_p", 0.0).alias("positive"), share("_n", 0.0).alias("negative"), share("_z", 1.0).alias("neutral"),
    )
    return out.withColumns({"label": label(F.col("compound")), "confidence": F.abs("compound")})


def recency_sentiment(scores: DataFrame, group: str, order: str, weights: str | None = None) -> DataFrame:
    """Weighted mean of the scores of a group; by default e^(-0.3 i), newest first.

    Positions come from ``with_ordinal``, so a group of any size is summed by
    mergeable aggregates.  Cutting its ranges reads the rows more than once, so
    the scores are computed once and written before.
    """
    if weights is None:
        scores = materialise(scores.select(group, order, *SHARES), "scores")
        scores = with_ordinal(scores, group, F.col(order).cast("bigint"), order, "_i", newest_first=True)
        scores = scores.withColumn("_w", F.exp(-DECAY * F.col("_i")))
    else:
        scores = scores.withColumn("_w", F.col(weights))
    total = F.sum("_w")
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    out = scores.groupBy(group).agg(*[(F.sum(F.col(c) * F.col("_w")) / total).alias(c) for c in SHARES])
    return out.withColumns({"label": label(F.col("compound")), "confidence": F.abs("compound")})


def bull_bear_split(scores: DataFrame) -> DataFrame:
    pct = F.floor((F.col("compound") + 1.0) / 2.0 * 100)
    bullish = F.greatest(F.lit(0), F.least(F.lit(100), pct)).cast("int")
    return scores.withColumn("bullish_pct", bullish).withColumn("bearish_pct", 100 - F.col("bullish_pct"))
