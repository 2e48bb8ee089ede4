import re

import pytest

from loreweave.llm import mixing


def fill(sizes, weights, share, most):
    """Targets by dealing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in full]
        if not open_:
            return full
        level = (total - sum(full.values())) / sum(w[s] for s in open_)
        above = [s for s in open_ if level * w[s] >= most * sizes[s]]
        if not above:
            return {**full, **{s: level * w[s] for s in open_}}
        full.update({s: most * sizes[s] for s in above})


def corpus():
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), "en", "hot" if i % 3 else f"s{i % 9}") for i in range(400)]
    return rows + [(900, None, "en", "hot"), (901, "", "en", None), (902, "a\tb\x0bc d  e", "en", None), (None, "x y", "en", "s0"), (5, rows[5][1], "en", rows[5][3]), (5, rows[5][1], "en", rows[5][3])]


def test_targets_and_taken(spark, docs):
    rows = corpus()
    got = mixing.mix(docs(rows)).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = fill(sizes, (3, 1, 2), 1.5, 2)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        s = r.row["source"]
        assert r["size"] == count(r.row["text"]) and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s]) and r.copies * r["size"] <= r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs(rows).repartition(7)).select("row.doc_id", "size", "taken")
    assert sorted(map(str, again.collect())) == sorted(str(x) for x in mixing.mix(docs(rows)).select("row.doc_id", "size", "taken").collect())


def test_inclusion_follows_odds(spark, docs):
    """Over many seeds a document with twice the preference takes about twice the copies."""
    d = docs([(i, "one two three four", "en", "a", None, None, None, None, 2.0 if i < 50 else 1.0) for i in range(100)])
    d = d.unionByName(docs([(1000 + i, "one two three four", "en", "b") for i in range(100)]))
    high = low = 0
    for seed in range(3):
        for r in mixing.mix(d, share=0.25, weights=(1, 1), preference="label", seed=seed).filter("row.source = 'a'").collect():
            high, low = (high + r.taken, low) if r.row["doc_id"] < 50 else (high, low + r.taken)
    assert 1.5 < high / low < 2.7


def filled(sizes, likings, target, most):
    """Expected copies by bisection of the level."""
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(most, mid * p) for n, p in zip(sizes, likings)) < target else (low, mid)
    return [min(most, low * p) for p in likings]


def test_inclusion_meets_its_probability(spark, docs):
    """400 sources of the same documents are 400 draws: whole copies are certain, and the share of draws in which a
    document gets one more is its fraction, within three standard errors; equal probabilities would fail."""
    likings, words, draws = [1.0] * 20 + [2.0] * 20 + [4.0] * 20 + [16.0] * 4, 5, 400
    rows = [(s * 100 + i, "one two three four five", "en", f"s{s:03}", None, None, None, None, p) for s in range(draws) for i, p in enumerate(likings)]
    got = mixing.mix(docs(rows).repartition(4), share=0.6, weights=(1,), preference="label").collect()
    want = filled([words] * len(likings), likings, 0.6 * words * len(likings), 2)
    more = [0] * len(likings)
    for r in got:
        i = r.row["doc_id"] % 100
        assert r.expected == pytest.approx(want[i], abs=1e-6) and r.copies == int(want[i] + 1e-9) and r.taken <= 10
        more[i] += (r.taken - r.copies * words) / words
    groups = {p: [i for i, q in enumerate(likings) if q == p] for p in set(likings)}
    for p, members in groups.items():
        part, n = want[members[0]] % 1, draws * len(members)
        assert abs(sum(more[i] for i in members) / n - part) <= 3 * (part * (1 - part) / n) ** 0.5 + 0.01
    assert want[-1] == 2 and len({round(w, 6) for w in want}) == 4


def test_a_source_fills_up_within_its_limits(spark, docs):
    """What documents at their limit leave goes to the others, down to the last word."""
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "en", "a", None, None, None, None, float(1 + i % 9) ** 3) for i in range(200)]
    got = mixing.mix(docs(rows), share=1.7, weights=(1,), preference="label").collect()
    assert abs(sum(r.taken for r in got) - got[0].target) <= 1 and all(r.taken <= 2 * r["size"] for r in got)
    assert abs(sum(r.expected * r["size"] for r in got) - got[0].target) < 1e-6


def test_empty(spark, docs):
    assert mixing.mix(docs([])).count() == 0
    assert [r.taken for r in mixing.mix(docs([(1, None, "en", None), (2, " \n", "en", "a")])).collect()] == [0, 0]
