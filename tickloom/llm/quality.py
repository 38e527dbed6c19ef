"""Document quality by hierarchical empirical Bayes.

A logistic classifier over text signals gives every document a probability of being good.  Grouped sums of these give
hosts (here: ``source``) and paths within them (here: ``lang``) posteriors: a path is shrunk towards its host and a
host towards the corpus, by strengths estimated from how much hosts and paths differ beyond chance.  A document's
final odds are its own evidence times the odds of its path.  The driver sees a bounded sample of labelled rows for
the fit and two rows of sums; host and path tables stay in Spark.
"""

from __future__ import annotations

import math
import operator
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import free_name, written
from tickloom.llm.toxicity import held_out

#: Bound on the labelled rows fetched for the fit.
MAX_LABELLED_ROWS = 40_000
#: Shrinkage strengths are kept inside these, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 20.0, 1e6

_LETTERS, _UPPERS, _DIGITS = (x.encode() for x in (string.ascii_letters, string.ascii_uppercase, string.digits))
_MARKS = string.punctuation.encode()
#: Marks that seldom end a word of prose.
_ODD_END = re.compile(rb"[#$%&*+/<=>@\\\[\]^_`{|}~](?=\s|$)")

SIGNALS = (
    "length", "short", "token_length", "odd_ends", "bars", "shouts", "upper", "digits", "marks", "variety", "echo",
    "top_share", "repeated_lines", "not_alphabetic",
)


def signals(text: str | None) -> list[float]:
    """Shares and logarithms that describe a text; an empty one has zeros except for ``short``."""
    text = text or ""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0, 1.0] + [0.0] * (len(SIGNALS) - 2)
    raw = text.encode("utf-8", "replace")
    size, held = len(raw), lambda kind: len(raw) - len(raw.translate(None, kind))
    counts = Counter(tokens)
    lines = [x for x in text.split("\n") if x]
    return [
        math.log1p(n),
        1 / (1 + n),
        math.log(sum(map(len, tokens)) / n),
        len(_ODD_END.findall(raw)) / n,
        counts["|"] / n,
        raw.count(b"!!") / n,
        held(_UPPERS) / (held(_LETTERS) or 1),
        held(_DIGITS) / size,
        held(_MARKS) / size,
        math.log(len(counts)) / math.log(n) if n > 1 else 1.0,
        sum(map(operator.eq, tokens, tokens[1:])) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        1 - sum(map(str.isalpha, tokens)) / n,
    ]


def _expanded(rows: np.ndarray) -> np.ndarray:
    """Signals, their square roots where they are shares, so that small shares count."""
    return np.concatenate([rows, np.sqrt(np.abs(rows[:, 3:]))], axis=1)


@dataclass
class QualityModel:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((_expanded(rows) - self.centre) / self.scale @ self.weights + self.bias, -12, 12)


def fit_logistic(rows: np.ndarray, target: np.ndarray, ridge: float = 1.0, steps: int = 30) -> QualityModel:
    """Newton steps with a ridge; without rows of both classes the model knows the share of good rows alone."""
    x = _expanded(rows) if len(rows) else np.zeros((0, 2 * len(SIGNALS) - 3))
    good = (target.sum() + 1) / (len(target) + 2)
    if not 0 < target.sum() < len(target):
        width = x.shape[1]
        return QualityModel(np.zeros(width), np.ones(width), np.zeros(width), math.log(good / (1 - good)))
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.concatenate([(x - centre) / scale, np.ones((len(x), 1))], axis=1)
    w = np.zeros(z.shape[1])
    w[-1] = math.log(good / (1 - good))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (target - p) - penalty * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return QualityModel(centre, scale, w[:-1], float(w[-1]))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    max_labelled_rows: int = MAX_LABELLED_ROWS,
) -> QualityModel:
    """The document classifier, from at most about ``max_labelled_rows`` labelled rows that are not held out.

    Null ids and labels are left out; an id with both labels counts as bad.
    """
    gold = (
        labels.select(labels[id_column].alias("i"), labels[label_column].cast("int").alias("y"))
        .where("i is not null and y in (0, 1)")
        .where(~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.min("y").alias("y"))
    )
    share = min(1.0, max_labelled_rows / max(gold.count(), 1))
    chosen = gold.where(F.pmod(F.xxhash64("i"), F.lit(1_000_003)) < int(share * 1_000_003))
    rows = docs.select(docs[id_column].alias("i"), docs[text_column].cast("string").alias("t"))
    rows = rows.join(F.broadcast(chosen), "i")  # max_labelled_rows ids at most, about
    drawn = rows.select("y", _signals_of(F.col("t")).alias("x")).collect()
    x = np.array([r["x"] for r in drawn], float).reshape(-1, len(SIGNALS))
    return fit_logistic(x, np.array([r["y"] for r in drawn], float))


def _signals_of(text: Column) -> Column:
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([signals(t) for t in texts])

    return F.pandas_udf(look, "array<double>")(text)


def document_logit(text: Column, model: QualityModel) -> Column:
    """Log odds that a text is good, from the text alone."""

    def look(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows = np.array([signals(t) for t in texts], float).reshape(-1, len(SIGNALS))
            yield pd.Series(model.logits(rows))

    # "Non-deterministic" keeps the planner from evaluating it once more for a filter on its result.
    return F.pandas_udf(look, "double").asNondeterministic()(text)


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(between: float, mean: float, noise_share: float) -> float:
    """Documents that a group's own share must outweigh, by moments of the beta-binomial."""
    spread = between - noise_share * mean * (1 - mean)
    if not spread > 0:
        return MOST_STRENGTH
    return float(np.clip(mean * (1 - mean) / spread - 1, LEAST_STRENGTH, MOST_STRENGTH))


def path_posteriors(scored: DataFrame, probability: str, host: str, path: str) -> tuple[DataFrame, float]:
    """(host, path, host_probability, path_probability) by two rounds of shrinkage, and the corpus mean."""
    p = F.col(probability)
    paths = scored.groupBy(F.col(host).alias("g_host"), F.col(path).alias("g_path")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("good")
    )
    paths = written(paths, "paths")  # the texts are read once for it
    hosts = paths.groupBy("g_host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    n, good, groups, squares = hosts.agg(
        F.sum("host_n"), F.sum("host_good"), F.count(F.lit(1)), F.sum(F.col("host_good") ** 2 / F.col("host_n"))
    ).first()
    n, good = n or 0, good or 0.0
    mean = min(max((good + 1) / (n + 2), 1e-6), 1 - 1e-6)
    k_host = strength((squares or 0.0) / max(n, 1) - mean**2, mean, (groups or 0) / max(n, 1))
    shrunk = hosts.withColumn("host_probability", (F.col("host_good") + k_host * mean) / (F.col("host_n") + k_host))
    both = paths.join(shrunk, paths["g_host"].eqNullSafe(shrunk["g_host"])).drop(shrunk["g_host"])
    away = F.col("good") / F.col("n") - F.col("host_good") / F.col("host_n")
    groups, squares = both.agg(F.count(F.lit(1)), F.sum(F.col("n") * away**2)).first()
    k_path = strength((squares or 0.0) / max(n, 1), mean, (groups or 0) / max(n, 1))
    out = both.select(
        "g_host",
        "g_path",
        "host_probability",
        ((F.col("good") + k_path * F.col("host_probability")) / (F.col("n") + k_path)).alias("path_probability"),
    )
    return out, mean


def with_quality(
    docs: DataFrame,
    labels: DataFrame,
    name: str = "judgement",
    host_column: str = "source",
    path_column: str = "lang",
    threshold: float = 0.5,
    text_column: str = "text",
    **columns,
) -> DataFrame:
    """The rows of ``docs`` with a struct ``name``: document, host, path, probability (of being good), keep.

    Null hosts and paths are groups of their own; null texts count as empty; repeated rows are judged alike.  All
    columns are kept, one of the same name is replaced.  Without usable labels the classifier knows only a prior of a
    half and keeps everything; an empty table stays empty.
    """
    model = fit_quality(docs, labels, text_column=text_column, **columns)
    docs = docs.drop(name)
    logit, chance = free_name(docs, "logit"), free_name(docs, "chance")
    scored = docs.withColumn(logit, document_logit(docs[text_column].cast("string"), model))
    groups, mean = path_posteriors(
        scored.select(host_column, path_column, (1 / (1 + F.exp(-F.col(logit)))).alias(chance)), chance, host_column, path_column
    )
    # As a table its size is known when the join is planned: a small one is broadcast and the texts stay where they are.
    groups = written(groups.select([F.col(c).alias(free_name(docs, c)) for c in groups.columns]), "posteriors")
    g_host, g_path, host_p, path_p = groups.columns
    prior = math.log(mean / (1 - mean))
    joined = scored.join(
        groups, scored[host_column].eqNullSafe(F.col(g_host)) & scored[path_column].eqNullSafe(F.col(g_path)), "left"
    )
    final = F.col(logit) + _logit(F.col(path_p)) - F.lit(prior)
    probability = 1 / (1 + F.exp(-final))
    judgement = F.struct(
        (1 / (1 + F.exp(-F.col(logit)))).alias("document"),
        F.col(host_p).alias("host"),
        F.col(path_p).alias("path"),
        probability.alias("probability"),
        (probability >= threshold).alias("keep"),
    )
    return joined.withColumn(name, judgement).drop(logit, *groups.columns)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that are more likely bad than good; columns as before."""
    name = free_name(docs, "judgement")
    return with_quality(docs, labels, name=name, **options).where(F.col(f"{name}.keep")).select(docs.columns)
