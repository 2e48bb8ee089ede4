import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loreweave.llm import langid
from loreweave.llm.bytewords import column_bytes
from loreweave.llm.common import remainder

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ör", "en"], "cc": ["ción", "que", "os", "la"]}


def text(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.choice([1, 2, 3]))) for _ in range(n))


def bits(grams, data):
    """Code length by walking the contexts of each byte, from the longest known one down."""
    data, total = b"\n" * 3 + data, 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            context = int.from_bytes(data[i - k : i], "big")
            follow = grams[0] if k == 0 else grams[k].get(context)
            if follow is None:
                continue
            n, distinct = int(follow.sum()), int((follow > 0).sum())
            if follow[data[i]]:
                total += math.log2((n + distinct) / follow[data[i]])
                break
            total += math.log2((n + distinct) / distinct)
        else:
            total += 8
    return total


def test_tables_equal_the_walk():
    r = random.Random(1)
    grams = langid.count_grams([(lang, text(r, lang, 40)) for lang in SYLLABLES for _ in range(5)])
    t = langid.Tables(grams)
    texts = [text(r, "aa", 9), text(r, "bb", 7) + " XYZ 日本", "", "q", "\x00\x01", text(r, "cc", 30)]
    data, offsets = column_bytes(pa.array(texts))
    want = [[bits(grams[lang], s.encode()) for lang in t.languages] for s in texts]
    assert np.allclose(t.bits(data, offsets), want, rtol=1e-5, atol=1e-3)


def test_held_out_accuracy_and_edges(spark, docs):
    r = random.Random(4)
    rows = [(i, text(r, lang, r.choice([3, 20, 200])), lang) for i, lang in enumerate(list(SYLLABLES) * 60)]
    odd = [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 !?", "aa"), (None, text(r, "bb", 9), "bb"), (1003, text(r, "cc", 9), None), (1004, text(r, "aa", 60_000), None), (1005, "日本", None)]
    d = docs(rows + odd + rows[:2])
    tables = langid.train(d, remainder(F.col("doc_id"), 4) != 2)
    got = d.select("doc_id", "lang", langid.predict(spark, F.col("text"), tables).alias("p")).collect()
    assert all(r.p.lang == r.lang for r in got if r.doc_id is None or r.doc_id < 1000)
    by = {r.doc_id: r.p for r in got}
    assert [(by[i].lang, by[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by[1003].lang == "cc" and by[1004].lang == "aa" and by[1005].lang in SYLLABLES and all(0 <= r.p.score <= 1 for r in got)
    assert langid.train(d, F.lit(False)) is None and langid.train(docs([]), F.lit(True)) is None
    assert {r.p.lang for r in d.select(langid.predict(spark, F.col("text"), None).alias("p")).collect()} == {"und"}


def test_sample_is_bounded(spark, docs):
    d = docs([(i, "ab " * 100, "aa") for i in range(400)])
    assert 10 < langid.sample(d, F.lit(True), most_bytes=12_000).count() < 90
