"""Toxicity by weak supervision.

Voters (lexicons, mined word beginnings, patterns) vote or abstain on every document.  A generative label model is
fitted by expectation maximisation to the counts of vote patterns: a class balance, what each voter votes in each
class, and, from what is left of pairs of voters given the class, how far they repeat one another; correlated voters
weigh less.  A linear classifier over term presences is trained on the posterior labels and scores all texts.

What is collected: the terms of which about ``MAX_LABELLED_ROWS`` labelled rows hold enough, the counts of at most
3**voters patterns, and the hits of at most ``MAX_TRAINING_ROWS`` rows.  Everything else stays in Spark.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import free_name, hashed_words, shingles

#: Insults by theme; each list is one voter.
LEXICONS = {
    "wits": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "stupid", "dumb", "imbecile", "cretin", "clown", "fool"),
    "worth": ("loser", "losers", "worthless", "pathetic", "useless", "failure", "nobody"),
    "disgust": ("scum", "trash", "garbage", "disgusting", "filth", "vermin", "pig", "revolting"),
}
FIXED_TERMS = tuple(sorted({t for terms in LEXICONS.values() for t in terms}))
INSULTED = re.compile(r"\b(?:you|he|she|they|u)(?:'re|'s| are| is| r)? (?:an? |such an? |so )?(?:" + "|".join(FIXED_TERMS) + r")\b")
#: Bounds on what is fetched for fitting.
MAX_LABELLED_ROWS = 40_000
MAX_TRAINING_ROWS = 40_000
#: Different toxic texts that a mined term needs: with fewer even a pure term is not surely toxic.
SUPPORT = 4
PREFIXES = (4, 5, 6, 7)
ABSTAIN, CLEAN, TOXIC = 0, 1, 2
VOTERS = (*LEXICONS, "mined_words", "mined_beginnings", "insulted", "several", "nothing_found")

_WORDS = re.compile(r"[^\W_]+")


def terms_of(text: str | None) -> set[str]:
    """Distinct words (lower case), and the beginnings of longer ones, marked by a final ``*``."""
    words = set(_WORDS.findall((text or "").lower()))
    out = set(words)
    for n in PREFIXES:
        out.update([w[:n] + "*" for w in words if len(w) > n])
    return out


@dataclass
class ToxicityModel:
    """Terms with weights, the bias, and what the label model found."""

    terms: dict[str, float]
    bias: float
    accuracies: dict[str, float] = field(default_factory=dict)
    correlations: dict[tuple[str, str], float] = field(default_factory=dict)
    balance: float = 0.0


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


# --- voters -----------------------------------------------------------------------------------------------------


def votes_of(text: str | None, terms: set[str], mined: frozenset[str]) -> list[int]:
    """One vote per voter of VOTERS."""
    hits = [bool(terms.intersection(words)) for words in LEXICONS.values()]
    found = terms & mined
    words, begun = any(not t.endswith("*") for t in found), any(t.endswith("*") for t in found)
    insulted = any(hits) and INSULTED.search((text or "").lower()) is not None
    several = sum(hits) + len(found) >= 3
    out = [TOXIC if h else ABSTAIN for h in (*hits, words, begun, insulted, several)]
    out.append(ABSTAIN if any(out) else CLEAN)
    return out


def _votes_and_hits(mined: list[str], terms: list[str]):
    mined_set, number = frozenset(mined), {t: k for k, t in enumerate(terms)}
    kind = T.StructType([T.StructField("votes", T.ArrayType(T.IntegerType())), T.StructField("hits", T.ArrayType(T.IntegerType()))])
    known = frozenset(terms)

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            votes, hits = [], []
            for text in texts:
                found = terms_of(text)
                votes.append(votes_of(text, found, mined_set))
                hits.append([number[t] for t in found & known])
            yield pd.DataFrame({"votes": votes, "hits": hits})

    return F.pandas_udf(look, kind)


# --- mining terms from labelled rows ----------------------------------------------------------------------------


def _sketched_terms(known: list[str] | None = None):
    """Terms of a text (those known), and one minimum hash of its word pairs, so that near copies count about once."""
    kind = T.StructType([T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("sketch", T.LongType())])
    only = None if known is None else frozenset(known)

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            grams, starts = shingles(*hashed_words(texts.tolist()), 2)
            least = [int(grams[a:b].min() >> np.uint64(1)) if b > a else 0 for a, b in itertools.pairwise(starts.tolist())]
            terms = [sorted(terms_of(t) if only is None else terms_of(t) & only) for t in texts]
            yield pd.DataFrame({"terms": terms, "sketch": least})

    return F.pandas_udf(look, kind)


def wilson_lower(k: int, n: int, z: float = 1.96) -> float:
    """Lower end of the 95 % Wilson interval of the share of k in n."""
    p = k / n
    return (p + z**2 / (2 * n) - z * math.sqrt(p * (1 - p) / n + z**2 / (4 * n * n))) / (1 + z**2 / n)


def mine_terms(labelled: DataFrame, text: str, label: str) -> list[str]:
    """Terms that stand in more toxic than clean labelled texts with 95 % confidence, the surest first.

    A term counts once per sketch, in clean texts as in toxic ones.  The support does not grow with the table, so more
    rows find rarer terms.  All terms that pass are returned; the labelled rows bound their number.
    """

    def counted(y: int, known: list[str] | None = None) -> DataFrame:
        seen = labelled.where(F.col(label) == y).select(_sketched_terms(known)(F.col(text)).alias("t"))
        seen = seen.select(F.explode("t.terms").alias("term"), F.col("t.sketch").alias("sketch"))
        return seen.groupBy("term").agg(F.count_distinct("sketch").alias("n"))

    in_toxic = {r["term"]: r["n"] for r in counted(1).where(F.col("n") >= SUPPORT).collect()}
    if not in_toxic:
        return []
    in_clean = {r["term"]: r["n"] for r in counted(0, sorted(in_toxic)).collect()}
    sure = {t: wilson_lower(k, k + in_clean.get(t, 0)) for t, k in in_toxic.items()}
    return sorted((t for t, p in sure.items() if p >= 0.5), key=lambda t: (-sure[t], t))


# --- the label model --------------------------------------------------------------------------------------------


@dataclass
class LabelModel:
    """Class balance and vote tables by expectation maximisation over counts of vote patterns."""

    balance: float
    tables: np.ndarray  # voter, class, vote
    weights: np.ndarray  # voter
    correlation: np.ndarray  # voter, voter

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        logs = np.log(np.array([1 - self.balance, self.balance]))[None, :]
        for j in range(patterns.shape[1]):
            logs = logs + self.weights[j] * np.log(self.tables[j][:, patterns[:, j]]).T
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(axis=1)


def fit_label_model(patterns: np.ndarray, counts: np.ndarray, known: np.ndarray | None = None, steps: int = 100) -> LabelModel:
    """``known``: per pattern the counts of rows whose class 0 or 1 is known; they are part of ``counts``."""
    n, voters = patterns.shape
    known = np.zeros((n, 2)) if known is None else known
    free = np.maximum(counts - known.sum(axis=1), 0)
    model = LabelModel(0.1, np.empty((voters, 2, 3)), np.ones(voters), np.eye(voters))
    for j in range(voters):  # to begin with a vote speaks for its class
        model.tables[j] = [[0.6, 0.3, 0.1], [0.45, 0.05, 0.5]]
    for fit in range(2):
        for _ in range(steps):
            p = model.posterior(patterns)
            mass = np.stack([free * (1 - p) + known[:, 0], free * p + known[:, 1]])
            total = mass.sum(axis=1)
            before = model.balance
            model.balance = float(np.clip((total[1] + 1) / (total.sum() + 10), 1e-4, 0.9))
            for j in range(voters):
                for v in range(3):
                    model.tables[j][:, v] = (mass[:, patterns[:, j] == v].sum(axis=1) + 0.1) / (total + 0.3)
            if abs(before - model.balance) < 1e-9:
                break
        if fit == 0:
            model.correlation = _residual_correlation(model, patterns, mass)
            model.weights = 1 / (1 + np.abs(model.correlation - np.eye(voters)).sum(axis=1))
    return model


def _residual_correlation(model: LabelModel, patterns: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """How pairs of voters go together beyond what their class explains; about 0 where the class explains all."""
    voters = patterns.shape[1]
    said = (patterns != ABSTAIN).astype(float)
    covariance = np.zeros((voters, voters))
    for c in (0, 1):
        away = said - (1 - model.tables[:, c, ABSTAIN])[None, :]
        covariance += (away * mass[c][:, None]).T @ away
    scale = np.sqrt(np.maximum(np.diag(covariance), 1e-12))
    out = covariance / (scale[:, None] * scale[None, :] + 1.0)
    np.fill_diagonal(out, 1)
    return out


# --- the classifier ---------------------------------------------------------------------------------------------


def fit_linear(hits: list[list[int]], target: np.ndarray, prior: np.ndarray, bias: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression on term presences with soft targets; weights are pulled to ``prior``."""
    rows = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
    columns = np.fromiter(itertools.chain.from_iterable(hits), np.int64, len(rows))
    w, b, n = prior.copy(), bias, max(len(hits), 1)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(rows, weights=w[columns], minlength=len(hits)) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        gw = np.bincount(columns, weights=error[rows], minlength=len(w)) / n + 2e-5 * (w - prior)
        gb = error.sum() / n + 1e-5 * (b - bias)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.999 * vw + 0.001 * gw**2
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w = w - 0.05 * (mw / c1) / (np.sqrt(vw / c2) + 1e-9)
        b = b - 0.05 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(b)


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    max_labelled_rows: int = MAX_LABELLED_ROWS,
    max_training_rows: int = MAX_TRAINING_ROWS,
) -> ToxicityModel:
    """Mine terms from labelled rows, fit the label model to the votes on all rows, train the classifier.

    Held-out rows (see ``held_out``) take no part.  Rows with a null id, label or text are never labelled examples;
    ids labelled both ways count as toxic.  Without labels the fixed lexicons alone vote; an empty table gives a model
    of the prior weights.
    """
    rows = docs.select(docs[id_column].alias("i"), docs[text_column].cast("string").alias("t")).where(~held_out(F.col("i")))
    gold = (
        labels.select(labels[id_column].alias("i"), labels[label_column].cast("int").alias("y"))
        .where("i is not null and y in (0, 1)")
        .where(~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
    )
    known_rows = gold.count()
    share = min(1.0, max_labelled_rows / max(known_rows, 1))
    chosen = gold.where(F.pmod(F.xxhash64("i"), F.lit(1_000_003)) < int(share * 1_000_003))
    labelled = rows.join(F.broadcast(chosen), "i").where("t is not null")  # max_labelled_rows ids at most, about
    mined = mine_terms(labelled, "t", "y")
    terms = sorted({*mined, *FIXED_TERMS})

    look = _votes_and_hits(mined, terms)
    votes = rows.select("i", look(F.col("t")).getField("votes").alias("votes")).join(gold, "i", "left")  # texts stay
    counted = votes.groupBy("votes").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1")
    )
    table = counted.collect()  # 3**len(VOTERS) patterns at most
    prior = np.array([4.0 if t in FIXED_TERMS else 2.0 for t in terms])
    if not table:
        return ToxicityModel(dict(zip(terms, prior.tolist(), strict=True)), -4.0)
    patterns = np.array([r["votes"] for r in table])
    known = np.array([[r["n0"], r["n1"]] for r in table], float)
    model = fit_label_model(patterns, np.array([r["n"] for r in table], float), known)
    total = sum(r["n"] for r in table)
    part = min(1.0, max_training_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("i", F.lit(7)), F.lit(1_000_003)) < int(part * 1_000_003))
    drawn = sample.select(look(F.col("t")).alias("l")).select("l.votes", "l.hits").collect()
    w, b = prior, -4.0
    if drawn:
        target = model.posterior(np.array([r["votes"] for r in drawn]))
        w, b = fit_linear([r["hits"] for r in drawn], target, prior, -4.0)
    pairs = itertools.combinations(range(len(VOTERS)), 2)
    return ToxicityModel(
        dict(zip(terms, w.tolist(), strict=True)),
        b,
        {v: float(model.tables[j, 1, TOXIC] / max(model.tables[j, :, TOXIC].sum(), 1e-12)) for j, v in enumerate(VOTERS)},
        {(VOTERS[a], VOTERS[c]): float(model.correlation[a, c]) for a, c in pairs},
        model.balance,
    )


def toxicity_score(text: Column, model: ToxicityModel) -> Column:
    """Probability that a text is toxic; null counts as empty, and an empty text has the bias alone."""
    weights, bias = model.terms, model.bias
    known = frozenset(weights)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            z = np.array([bias + sum(weights[t] for t in sorted(terms_of(x) & known)) for x in texts], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    # "Non-deterministic" keeps the planner from evaluating it once more for a filter on its result.
    return F.pandas_udf(score, "double").asNondeterministic()(text.cast("string"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; columns as before, repeated rows judged alike."""
    model = fit_toxicity(docs, labels, **columns)
    name = free_name(docs, "toxicity")
    scored = docs.withColumn(name, toxicity_score(docs[columns.get("text_column", "text")], model))
    return scored.where(F.col(name) < threshold).drop(name)
