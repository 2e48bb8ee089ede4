"""Toxicity classifier with counterfactual regularisation.

Logistic regression over hashed words. Sentences of the labelled texts that name a group of people are copied with
the name of another group of the same kind, and the fit pays for every change of the score between the two. So a
mention of a group, which says nothing about toxicity by itself, gets no weight of its own even where such mentions
are more common in toxic texts.

Labels are read from a bounded sample (``MOST_ROWS``, ``MOST_BYTES``); scores cover every whole text.

Edge cases: null and empty texts get the score of no evidence (the intercept); null labels are not learned from; rows
with a null id are scored, and neither held out nor learned from; without both labels the score is the share of
label 1, or 0.0 without any; repeated rows are scored alike; an empty table gives no rows.
"""
from __future__ import annotations

import re
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textmodel import Sample, descend, margin_column, sampled, screen, sigmoid

MOST_ROWS, MOST_BYTES = 8_000, 24 << 20
THRESHOLD = 0.7

#: Names of groups that may stand for each other, by kind.
IDENTITIES = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("mothers", "fathers"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "indigenous"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "locals", "refugees"), ("mexican", "american", "chinese", "african", "european", "arab"),
    ("old", "young"), ("disabled", "deaf", "blind"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "deutsche"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "français"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "españoles"),
)


def counterfactuals(text: str | None, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> list[tuple[str, str]]:
    """(sentence, the same with another group) for each sentence of a text that names groups."""
    others = {a: b for kind in identities for a, b in permutations(kind, 2) if (kind.index(a) + 1) % len(kind) == kind.index(b)}
    names = re.compile(r"(?<!\w)(" + "|".join(map(re.escape, others)) + r")(?!\w)")
    out = []
    for sentence in re.split(r"(?<=[.!?])\s+|\n+", (text or "").lower()):
        swapped = names.sub(lambda m: others[m[0]], sentence)
        if swapped != sentence:
            out.append((sentence, swapped))
    return out


def fit(texts: list[str | None], labels: list[int], penalty: float = 10.0, identities: tuple[tuple[str, ...], ...] = IDENTITIES) -> tuple[np.ndarray, float]:
    """(weights by feature, intercept)."""
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        share = min(max(float(y.mean()) if len(y) else 0.0, 1e-6), 1 - 1e-6)
        return np.zeros(1 << 20, np.float32), float(np.log(share / (1 - share)))
    pairs = [p for t in texts for p in counterfactuals(t, identities)]
    used = screen(texts, [y], 3.5)
    x, left, right = Sample(texts, used), Sample([a for a, _ in pairs], used), Sample([b for _, b in pairs], used)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    m = max(1, len(pairs))

    def gradient(w: np.ndarray) -> np.ndarray:
        wrong = weight * (sigmoid(x.times(w[1:]) + w[0]) - y) / x.n
        change = penalty * (left.times(w[1:]) - right.times(w[1:])) / m
        return np.concatenate([[wrong.sum()], x.back(wrong) + left.back(change) - right.back(change)])

    steep = (x.curvature() + 1) * weight.max() / 4 + 2 * penalty * (left.curvature() + right.curvature()) * (len(pairs) > 0)
    lasso = np.full(len(x.used) + 1, 1e-4)
    lasso[0] = 0
    w = descend(np.zeros(len(x.used) + 1), gradient, 1 / steep, lasso, 500)
    return x.spread(w[1:]), float(w[0])


def train(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[np.ndarray, float]:
    """Fit on a bounded sample of the labelled rows of ``docs`` for which ``learn`` (over doc_id) holds."""
    known = labels.select(F.col("doc_id"), F.col("toxic").alias("label")).filter(learn & F.col("label").isNotNull())
    rows = sampled(docs, known, MOST_ROWS, MOST_BYTES).toPandas()
    rows = rows.sort_values(["doc_id", "text", "label"], na_position="first")
    return fit([t if isinstance(t, str) else None for t in rows["text"]], [int(v) for v in rows["label"]])


def score(text: Column, model: tuple[np.ndarray, float]) -> Column:
    return 1 / (1 + F.exp(-(margin_column(text, model[0]) + F.lit(model[1]))))


def keep_civil(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = THRESHOLD) -> DataFrame:
    """Pipeline form: the rows that score below the threshold."""
    return docs.filter(score(docs["text"], train(docs, labels, learn)) < threshold)
