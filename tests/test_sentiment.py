"""The published rules on single sentences, and against a plain loop over tokens."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.constants import BOOSTERS, DAMPENERS, NEGATIONS
from tickloom.operators import sentiment

LEXICON = {"bullish": 3.0, "crash": -3.5, "rally": 2.5, "fraud": -4.0, "stable": 0.5, "more": 1.0, "mixed": 0.0}


def brute(text):
    tokens = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*", text or "")
    low = [t.lower() for t in tokens]
    loud = [t.isupper() for t in tokens]
    some = any(loud) and not all(loud)
    boost = lambda w: 0.293 if w in BOOSTERS else -0.293 if w in DAMPENERS else 0.0
    scores = []
    for i, w in enumerate(low):
        v = LEXICON.get(w)
        if v is None or boost(w):
            scores.append(0.0)
            continue
        if loud[i] and some:
            v += 0.733 if v >= 0 else -0.733
        for d, scale in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i < d or low[i - d] in LEXICON:
                continue
            step = boost(low[i - d]) * (-1 if v < 0 else 1)
            if step and loud[i - d] and some:
                step += -0.733 if v < 0 else 0.733
            v += step * scale
            between = low[i - d + 1 : i][-2:]
            if low[i - d] == "never" and d > 1 and {"so", "this"} & set(between):
                v *= 1.25
            elif low[i - d] == "without" and d > 1 and "doubt" in between:
                pass
            elif low[i - d] in NEGATIONS or "n't" in low[i - d]:
                v *= -0.74
        if i > 0 and low[i - 1] == "least" and (i < 2 or low[i - 2] not in ("at", "very")):
            v *= -0.74
        scores.append(v)
    if "but" in low:
        at = low.index("but")
        scores = [s * (0.5 if k < at else 1.5 if k > at else 1) for k, s in enumerate(scores)]
    asks = (text or "").count("?")
    emphasis = min((text or "").count("!"), 4) * 0.292 + (0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0)
    total = sum(scores)
    total += emphasis if total > 0 else -emphasis if total < 0 else 0
    pos, neg, neu = sum(s + 1 for s in scores if s > 0), sum(1 - s for s in scores if s < 0), sum(s == 0 for s in scores)
    pos, neg = pos + (emphasis if pos > neg else 0), neg + (emphasis if pos < neg else 0)
    whole = pos + neg + neu
    return [total / math.sqrt(total * total + 15), *((pos / whole, neg / whole, neu / whole) if whole else (0.0, 0.0, 1.0))]


def lexicon(spark):
    return spark.createDataFrame(list(LEXICON.items()), "term string, valence double")


def texts():
    draw = random.Random(5)
    words = [*LEXICON, *LEXICON, "not", "never", "so", "this", "without", "doubt", "very", "VERY", "hardly", "but", "least", "at", "don't", "the", "RALLY", "Crash", "été", "x1", "?", "!", "more"]
    out = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 14))) for _ in range(400)]
    return [*out, None, "", "!!!", "RALLY CRASH", "never so bullish", "without a doubt bullish", "least bullish", "at least bullish", "isn't bullish?? ???"]


@pytest.mark.parametrize("few", [2_000, 0])
def test_same_as_a_loop_over_tokens(spark, monkeypatch, few):
    monkeypatch.setattr(sentiment, "FEW_TERMS", few)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "text_id long, text string").repartition(4)
    got = {r["text_id"]: r for r in sentiment.score_texts(df, lexicon(spark), ["text_id"]).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        mine = [got[i][c] for c in sentiment.SHARES]
        assert abs(mine[0] - want[0]) < 6e-5 and all(abs(a - b) < 6e-4 for a, b in zip(mine[1:], want[1:], strict=True)), (text, mine, want)


def test_rules_point_the_right_way(spark):
    score = {}
    lines = ["bullish", "not bullish", "very bullish", "slightly bullish", "BULLISH times", "bullish!", "bullish but crash", "crash but bullish", "not very bullish", "never so bullish"]
    rows = sentiment.score_texts(spark.createDataFrame([(t, t) for t in lines], "k string, text string"), lexicon(spark), ["k"]).collect()
    score = {r["k"]: r["compound"] for r in rows}
    assert score["not bullish"] < 0 < score["slightly bullish"] < score["bullish"] < score["very bullish"]
    assert score["BULLISH times"] > score["bullish"] and score["bullish!"] > score["bullish"]
    assert score["bullish but crash"] < 0 < score["crash but bullish"] and score["not very bullish"] < 0 < score["never so bullish"]


def test_no_shuffle_for_a_small_lexicon(spark):
    df = spark.createDataFrame([(1, "a rally")], "text_id long, text string")
    plan = sentiment.score_texts(df, lexicon(spark), ["text_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    empty = sentiment.score_texts(df, lexicon(spark).where("false"), ["text_id"]).first()
    assert (empty["compound"], empty["neutral"]) == (0.0, 1.0)


def test_every_text_is_scored_once(spark):
    scored = spark.sparkContext.accumulator(0)

    def count(text):
        scored.add(1)
        return text

    df = spark.createDataFrame([(i, "g", t) for i, t in enumerate(texts())], "text_id long, grp string, text string")
    df = df.repartition(spark.sparkContext.defaultParallelism).withColumn("text", F.udf(count, "string")("text"))
    scores = sentiment.score_texts(df, lexicon(spark), ["text_id", "grp"])
    assert sentiment.recency_sentiment(scores, "grp", "text_id").count() == 1
    assert scored.value == len(texts())


def test_every_token_is_lowered_once(spark):
    df = spark.createDataFrame([(1, "a rally")], "text_id long, text string")
    plan = sentiment.score_texts(df, lexicon(spark), ["text_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lower(") == 1
