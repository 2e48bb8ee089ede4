import re

import corpus_pipeline as cp
import pytest
from test_decontaminate import brute as hits
from test_jaccard import shingles
from test_mixing import fill

from loreweave.llm.common import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, function in cp.STAGES:
        out.append(stage(function(spark, out[-1], SF), "test-" + name.replace(" ", "-")))
    return out


def test_columns(steps):
    assert [name for name, _ in cp.STAGES][0] == "toxicity" and len(cp.STAGES) == 5
    assert all(d.columns == steps[0].columns for d in steps[:5])


def test_toxicity_agrees_with_labels(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.join(steps[0].select("doc_id"), "doc_id").collect()}
    kept = {r.doc_id for r in steps[1].select("doc_id").collect()}
    assert sum((i in kept) == bool(y) for i, y in known.items()) <= 0.1 * len(known)


def test_later_stages_against_brute_force(spark, steps):
    rows = [sorted(((r.doc_id, r.text, r.source) for r in d.collect()), key=lambda r: r[0]) for d in steps[1:5]]
    first = {}
    for i, t, _ in rows[0]:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert [r[0] for r in rows[1]] == sorted(first.values())
    sets, group = {i: shingles(t) for i, t, _ in rows[1]}, {}
    for i, s in sets.items():
        near = [j for j in sets if j < i and s and 10 * len(s & sets[j]) >= 8 * len(s | sets[j])]
        joined = {group[j] for j in near}
        group[i] = min(joined, default=i)
        group.update({k: group[i] for k, g in group.items() if g in joined})
    assert [r[0] for r in rows[2]] == sorted(set(group.values()))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [eval(x) for x in hits([r[:2] for r in rows[2]], items)]  # noqa: S307 - own strings
    assert [r[0] for r in rows[3]] == sorted(x[0] for x in clean if not x[-1])
    sizes = {}
    for _, t, s in rows[3]:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    taken = {r.source: r.n for r in steps[5].groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert all(abs(taken[s] - t) <= 1 for s, t in fill(sizes, (3, 1, 2), 1.5, 2).items())


def test_run_is_the_stages(spark, steps):
    assert sorted(map(str, cp.run(spark, SF).collect())) == sorted(map(str, steps[5].collect()))
