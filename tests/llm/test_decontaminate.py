import random
import re

from loreweave.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for n, (i, text) in enumerate(docs):
        w, hit, ids = words(text), set(), set()
        for item, t in items:
            x = words(t)
            k = min(13, len(x))
            wins = {tuple(x[s : s + k]) for s in range(len(x) - k + 1)} if k else set()
            for s in range(len(w) - k + 1 if k else 0):
                if tuple(w[s : s + k]) in wins:
                    hit.update(range(s, s + k))
                    ids.add(str(item))
        out[n] = (i, len(w), len(hit), len(ids), ",".join(sorted(ids)), bool(hit) and 20 * len(hit) >= len(w))
    return sorted(map(str, out.values()))


def case():
    r = random.Random(3)
    vocabulary = ["the", "of", "and", "a"] * 20 + [f"w{i}" for i in range(30)] + ["Äpfel", "étè", "日本"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, text(r.choice([3, 9, 13, 14, 40]))) for i in range(12)] + [(50, "the"), (51, None), (52, "!!"), (53, text(30)), (9, "the of the of the of the of the of the of the of the")]
    items += [items[0], (54, items[3][1])]
    docs = [(i, text(r.choice([0, 5, 60, 200]))) for i in range(30)]
    docs += [(100 + i, text(r.choice([0, 20, 400])) + " " + t.upper() + "; " + text(r.choice([0, 3]))) for i, (_, t) in enumerate(items) if t]
    long = words(items[-1][1])
    docs += [(200, " ".join(long[2:])), (201, None), (202, ""), (None, items[3][1]), (None, None), (3, docs[3][1]), (3, "other text " + items[4][1]), (203, text(30_000) + " " + items[15][1])]
    return docs, items


def test_against_brute_force(spark, docs):
    data, items = case()
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = dc.judge(docs(data), dc.find(docs(data), b)).collect()
    assert sorted(str((r.row["doc_id"], r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated)) for r in got) == brute(data, items)
    kept = dc.keep_clean(docs(data), b)
    assert kept.columns == docs([]).columns and kept.count() == sum(not r.contaminated for r in got)


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.judge(docs([]), dc.find(docs([]), none)).count() == 0
    assert [r.contaminated for r in dc.judge(docs([(1, "a b")]), dc.find(docs([(1, "a b")]), none)).collect()] == [False]


def test_proximity(spark, docs):
    item = "zeta eta the of and a the of and a the of"
    d = docs([(1, "zeta " + "x " * 5 + "eta"), (2, "eta " + "x " * 80 + "zeta"), (3, "eta zeta"), (4, None)])
    _, windows = dc.item_windows(spark.createDataFrame([(1, item)], "item_id bigint, text string"))
    counts = dc.term_counts(d, windows).withColumn("n", dc.F.expr("if(n = 0, 1000, n)"))
    pairs = dc.anchors(windows, counts)
    index = dc.build_index(d, pairs.select(dc.F.explode(dc.F.array("term1", "term2")).alias("term")).distinct())
    assert sorted((r.doc_id, r["first"], r["last"]) for r in dc.proximity(index, pairs, span=10).collect()) == [(1, 0, 6), (3, 0, 1)]
