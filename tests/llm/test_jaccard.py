import random
import re
from itertools import combinations

from loreweave.llm import jaccard


def shingles(t, n=5):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows):
    s = [shingles(t) for _, t in rows]
    links, near = [0] * len(rows), {i: {i} for i in range(len(rows))}
    for i, j in combinations(range(len(rows)), 2):
        if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]):
            links[i], links[j] = links[i] + 1, links[j] + 1
            whole = near[i] | near[j]
            for k in whole:
                near[k] = whole
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(str((rows[i][0], low(rows[k][0] for k in near[i]), len(near[i]), links[i])) for i in range(len(rows)))


def case(n_copies=60):
    r = random.Random(5)
    text = lambda n: [f"W{r.randrange(400)}" for _ in range(n)]
    rows, at = [], 0
    for size in (3, 6, 8, 30, 120, 300):
        base = text(size)
        for _ in range(n_copies if size == 120 else 8):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = f"x{r.randrange(9)}"
            rows.append((at, " ".join(w) + r.choice(["", "!", " ."])))
            at += 1
    rows += [(at + i, " ".join(text(90))) for i in range(40)]
    passage = " ".join(text(60))
    rows += [(500 + i, passage + " " + " ".join(text(40))) for i in range(20)]
    rows += [(800, None), (801, ""), (802, "?!"), (803, None), (None, rows[0][1]), (None, "only here"), (3, rows[3][1]), (2, "one two three"), (2, "four five six")]
    rows += [(900, " ".join(text(20_000)))]
    return rows + [(901, rows[-1][1] + " tail")]


def test_against_brute_force(spark, docs, monkeypatch):
    rows = case()
    want = brute(rows)
    for nodes in (1024, 7):
        monkeypatch.setattr(jaccard, "BLOCK_NODES", nodes)
        got = jaccard.classes(docs(rows)).collect()
        assert sorted(str((r.doc_id, r.class_id, r.class_size, r.n_links)) for r in got) == want


def test_keep_one(spark, docs):
    rows = case(10)
    rows += [rows[1], rows[1]]
    kept = jaccard.keep_one(docs(rows))
    assert kept.columns == docs([]).columns
    got = kept.collect()
    s = [shingles(r.text) for r in got if shingles(r.text)]
    assert sum(not shingles(t) for _, t in rows) == len(got) - len(s)
    classes = {c.split(",")[1] for c in brute(rows)}
    assert all(10 * len(a & b) < 8 * len(a | b) for a, b in combinations(s, 2)) or len(s) <= len(classes)
    assert jaccard.keep_one(docs([])).count() == 0 and jaccard.classes(docs([])).count() == 0


def test_pruning_keeps_what_the_posterior_allows():
    least = jaccard.least_matches(0.8, 1e-6)
    assert len(least) == jaccard.HASHES // jaccard.STEP and least == sorted(least) and 0 < least[-1] < 0.8 * jaccard.HASHES
