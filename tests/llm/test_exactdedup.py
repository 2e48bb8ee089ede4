import hashlib
import re

from loreweave.llm import exactdedup


def rows():
    big = "long text " * 30_000
    base = [(i, f"text {i % 40}  end", "en", "s") for i in range(300)]
    return base + [(400, None), (399, ""), (401, big), (402, big + " "), (None, "text 1 end"), (None, "alone"), (7, "text 7\tend"), (7, "text 7 end"), (3, "text 3 end"), (500, "  "), (501, " ")]


def brute(data):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in data]
    first, size = {}, {}
    for r, n in zip(data, norm):
        size[n] = size.get(n, 0) + 1
        if n not in first or (r[0] is not None and (first[n] is None or r[0] < first[n])):
            first[n] = r[0]
    return norm, first, size


def test_assign(spark, docs):
    data = rows()
    d = docs(data)
    for capacity in (4, 4096):
        index = exactdedup.build_index(d, capacity=capacity)
        got = exactdedup.assign(exactdedup.digest(d), index).collect()
        norm, first, size = brute(data)
        sha = [hashlib.sha256(n.encode()).hexdigest() for n in norm]
        want = sorted(str((r[0], first[n], size[n], s)) for r, n, s in zip(data, norm, sha))
        assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
        assert sorted(r.text_sha256 for r in got if r.kept) == sorted(set(sha))
        buckets = index.groupBy("depth", "prefix").count().collect()
        assert all(b["count"] <= capacity for b in buckets) and (capacity > 4 or len(buckets) > 8)


def test_collisions_are_chained(spark, docs, monkeypatch):
    """With a key of one value for all texts, entries form one chain and rows still find their own."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exactdedup.F, "xxhash64", lambda *_: F.lit(7).cast("bigint"))
    data = [(i, f"t {i % 3}") for i in range(9)]
    index = exactdedup.build_index(docs(data))
    assert sorted(r.chain for r in index.collect()) == [1, 2, 3]
    assert {r.doc_id: r.keep_id for r in exactdedup.assign(exactdedup.digest(docs(data)), index).collect()} == {i: i % 3 for i in range(9)}


def test_keep_first(spark, docs):
    data = rows()
    kept = exactdedup.exact_dedup(docs(data))
    assert kept.columns == docs([]).columns
    norm, first, _ = brute(data)
    assert sorted(str((r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""))) for r in kept.collect()) == sorted(str((first[n], n)) for n in first)
    assert exactdedup.exact_dedup(docs([])).count() == 0
