import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreweave.llm import quality, toxicity
from loreweave.llm.common import remainder
from loreweave.llm.textmodel import margins, sigmoid

R = random.Random(2)
WORDS = [f"word{i}" for i in range(200)]


def sentence(n, *extra):
    w = [R.choice(WORDS) for _ in range(n)] + list(extra)
    R.shuffle(w)
    return " ".join(w) + "."


def labelled(n=600):
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, sentence(R.choice([5, 60]), *(["vile", "grubby"] if toxic and i % 12 else []), *(["women"] if i % 12 == 0 or i % 37 == 0 else [])), int(toxic)))
    return rows


def test_counterfactuals():
    got = toxicity.counterfactuals("Women like tea. Nothing here.\nA deaf man")
    assert got == [("women like tea.", "men like tea."), ("a deaf man", "a blind woman")]
    assert toxicity.counterfactuals(None) == []


def test_neutral_mentions_get_no_weight():
    rows = labelled()
    texts, labels = [t for _, t, _ in rows], [y for *_, y in rows]
    scores = {}
    for penalty in (0.0, 100.0):
        weights, bias = toxicity.fit(texts, labels, penalty=penalty)
        probe = pa.array(["women like tea", "men like tea", "a vile remark", None, ""], pa.string())
        scores[penalty] = toxicity.sigmoid(margins(probe, weights) + bias)
    assert abs(scores[100.0][0] - scores[100.0][1]) < 0.2 * abs(scores[0.0][0] - scores[0.0][1])
    assert scores[100.0][2] > 0.7 and scores[100.0][3] == scores[100.0][4] < 0.7


def test_train_and_keep(spark, docs):
    rows = labelled()
    d = docs([(i, t) for i, t, _ in rows] + [(None, "a vile text"), (9000, None), (9001, ""), (9002, "word1 " * 50_000 + "vile grubby")])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9001, None)], "doc_id bigint, toxic int")
    kept = toxicity.keep_civil(d, labels, remainder(F.col("doc_id"), 3) != 1)
    assert kept.columns == d.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    wrong = sum((i in ids) == bool(y) for i, _, y in rows if i % 12)
    assert wrong <= 6 and {9000, 9001} <= ids and 9002 not in ids and None not in ids
    assert toxicity.keep_civil(docs([]), labels, F.lit(True)).count() == 0
    one = labels.withColumn("toxic", F.lit(0))
    assert toxicity.keep_civil(d, one, F.lit(True)).count() == d.count()


def test_gradient_of_the_ordinal_model_fits_held_out_grades():
    rows = []
    for i in range(900):
        g = i % 3
        rows.append((sentence(30, *(["good"] * (g > 0)), *(["fine", "superb"][: g - 1] if g > 1 else [])), g))
    weights, thresholds, levels = quality.fit([t for t, _ in rows[:600]], [g for _, g in rows[:600]])
    assert levels == [0, 1, 2] and thresholds == sorted(thresholds)
    z = margins(pa.array([t for t, _ in rows[600:]]), weights, style=True)
    expected = sum(sigmoid(z - t) for t in thresholds)
    means = [np.mean([e for e, (_, g) in zip(expected, rows[600:]) if g == k]) for k in range(3)]
    assert means[0] < 0.4 < 0.7 < means[1] < 1.3 < 1.6 < means[2]
    assert quality.fit([], []) [1:] == ([], [0]) and quality.fit(["a", "b"], [3, 3])[1:] == ([], [3])


def test_grades(spark, docs):
    d = docs([(1, "good"), (2, None), (None, ""), (1, "good")])
    model = (np.zeros(1 << 20, np.float32), [-1.0, 0.5], [0, 1, 2])
    got = quality.grades(d, model, cut=1).collect()
    p = 1 / (1 + np.exp(-1.0))
    assert len(got) == 4 and all(r.tail_probability == pytest.approx(p) and r.selected and r.row["key"] is None for r in got)
    assert got[0].expected_grade == pytest.approx(p + 1 / (1 + np.exp(0.5)))
    assert quality.grades(d, (model[0], [], [3]), cut=1).select("expected_grade", "tail_probability").distinct().collect()[0][:] == (3.0, 1.0)
    assert quality.grades(docs([]), model, cut=1).count() == 0
