"""Quality classifier: ordinal regression with a cumulative logit link on graded ratings.

P(grade >= k) = sigmoid(w.x - threshold_k): one weight vector over hashed text (words, word beginnings and the
manner of writing) for all grades and rising thresholds.
The outputs are the expected grade and the probability of a grade of at least ``cut``, by which rows are selected.

Grades are read from a bounded sample (``MOST_ROWS``, ``MOST_BYTES``); scores cover every whole text.

Edge cases: null and empty texts get the score of no evidence; null ratings are not learned from; rows with a null id
are scored, and neither held out nor learned from; with one grade only, that grade is expected everywhere, and 0
without any; repeated rows are scored alike; an empty table gives no rows.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textmodel import BITS, Sample, descend, margin_column, sampled, screen, sigmoid

MOST_ROWS, MOST_BYTES = 8_000, 24 << 20


def fit(texts: list[str | None], grades: list[int]) -> tuple[np.ndarray, list[float], list[int]]:
    """(weights by feature, rising thresholds, grades in order)."""
    levels = sorted(set(grades)) or [0]
    if len(levels) == 1:
        return np.zeros(1 << BITS, np.float32), [], levels
    y = np.searchsorted(levels, np.array(grades))
    at_least = [(y >= k).astype(float) for k in range(1, len(levels))]
    x = Sample(texts, screen(texts, at_least, 3.5, style=True), style=True)
    cuts = len(at_least)

    def thresholds(w: np.ndarray) -> np.ndarray:
        """The first as it is, each further one by a positive step, so that they stay in order."""
        return np.cumsum(np.concatenate([w[:1], np.logaddexp(0, w[1:cuts])]))

    def gradient(w: np.ndarray) -> np.ndarray:
        """Of the mean negative log-likelihood of the grades."""
        z = x.times(w[cuts:])
        upper = np.vstack([np.ones(x.n), *(sigmoid(z - t) for t in thresholds(w)), np.zeros(x.n)])
        rows = np.arange(x.n)
        low, high = upper[y, rows], upper[y + 1, rows]
        p = np.maximum(low - high, 1e-9)
        slope_low, slope_high = low * (1 - low) / p / x.n, high * (1 - high) / p / x.n
        d_z = slope_high - slope_low
        d_t = np.array([slope_low[y == k].sum() - slope_high[y == k - 1].sum() for k in range(1, cuts + 1)])
        below = np.cumsum(d_t[::-1])[::-1]
        return np.concatenate([below[:1], below[1:] * sigmoid(w[1:cuts]), x.back(d_z)])

    start = np.zeros(cuts + len(x.used))
    shares = np.clip([a.mean() for a in at_least], 1e-6, 1 - 1e-6)
    first = -np.log(shares / (1 - shares))
    start[0], start[1:cuts] = first[0], np.log(np.expm1(np.maximum(np.diff(first), 1e-3)))
    lasso = np.full(len(start), 1e-4)
    lasso[:cuts] = 0
    w = descend(start, gradient, 1 / (x.curvature() + 2), lasso, 500)
    return x.spread(w[cuts:]), thresholds(w).tolist(), levels


def train(docs: DataFrame, ratings: DataFrame, learn: Column) -> tuple[np.ndarray, list[float], list[int]]:
    """Fit on a bounded sample of the rows of ``docs`` that have a ``grade`` in ``ratings`` and for which ``learn`` holds."""
    known = ratings.select("doc_id", "grade").filter(learn & F.col("grade").isNotNull())
    rows = sampled(docs, known, MOST_ROWS, MOST_BYTES).toPandas()
    rows = rows.sort_values(["doc_id", "text", "grade"], na_position="first")
    return fit([t if isinstance(t, str) else None for t in rows["text"]], [int(v) for v in rows["grade"]])


def grades(docs: DataFrame, model: tuple[np.ndarray, list[float], list[int]], cut: int, most: float = 0.5) -> DataFrame:
    """``docs`` as struct ``row`` with expected_grade, tail_probability (of a grade of at least ``cut``) and selected
    (that probability is at least ``most``)."""
    weights, thresholds, levels = model
    d = docs.select(F.struct(*docs.columns).alias("row"), margin_column(docs["text"], weights, style=True).alias("z"))
    tails = [1 / (1 + F.exp(F.lit(t) - F.col("z"))) for t in thresholds]
    expected = F.lit(float(levels[0]))
    for tail, low, high in zip(tails, levels, levels[1:]):
        expected = expected + tail * (high - low)
    above = [tail for tail, level in zip(tails, levels[1:]) if level >= cut]
    tail = F.lit(1.0) if levels[0] >= cut else above[0] if above else F.lit(0.0)
    return d.select("row", expected.alias("expected_grade"), tail.alias("tail_probability"), (tail >= most).alias("selected"))
