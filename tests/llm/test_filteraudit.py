import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from loreweave.llm import bytescan, filteraudit
from loreweave.llm.bytewords import chunks

SPACE = r"[\x20\x09-\x0D]"


def scan(texts, block, piece):
    """(text, word, entry) of all words, and the counts of each text."""
    words, totals = [], []
    m = bytescan.machine(bytescan.SPACES, b"#$")
    for first, end, data, offsets in chunks(pa.array(texts, pa.string()), piece):
        reader, table = bytescan.Reader(m, data, offsets, block), bytescan.SpanTable(data, max(block, 4))
        for s in reader.blocks():
            ids = table.insert(s.start, s.length, s.text, s.hash)
            words += [(int(t) + first, bytes(data[a : a + n]).decode(), (first, int(i))) for t, a, n, i in zip(s.text, s.start, s.length, ids)]
        totals += zip(reader.points.tolist(), reader.capitals.tolist(), reader.symbols.tolist(), reader.ink.tolist())
    return words, totals


def test_machine_on_random_texts_in_blocks_of_any_size():
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice("ab A\n\t#é中") for _ in range(r.choice([0, 1, 5, 30, 100]))) for _ in range(r.randint(0, 12))]
        want = [(i, w) for i, t in enumerate(texts) for w in re.split(f"{SPACE}+", t) if w]
        for piece, block in ((7, 1), (64, 3), (1 << 18, 8), (64, 1000)):
            words, totals = scan(texts, block, piece)
            assert [w[:2] for w in words] == want
            entry = {}
            assert all(entry.setdefault(w[2], w[:2]) == w[:2] for w in words) and len(entry) == len(set(want))
            assert totals == [(len(t), t.count("A"), t.count("#"), len(re.sub(SPACE, "", t))) for t in texts]


def test_equal_hashes_are_settled_by_the_bytes():
    data = np.frombuffer(b"aabbaacc", np.uint8)
    start, n = np.array([0, 2, 4, 6]), np.full(4, 2)
    table = bytescan.SpanTable(data)
    ids = table.insert(start, n, np.zeros(4, np.int32), np.full(4, 7, np.uint64))
    assert table.n == 3 and ids[0] == ids[2] and len(set(ids.tolist())) == 3


def test_long_text_in_blocks():
    word = "x" * 700_000
    text = f"{word} {word}y {word}\n" + "Ab cd " * 200_000
    got = filteraudit.counts(pa.array([None, text, ""]))
    assert got.tolist() == [[0, 400_003, 0], [0, 4, 0], [0, 200_000, 0], [0, len(text), 0], [0, 0, 0]]


def brute(rows, labels):
    low = {}
    for i, t, s in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    out, of = {}, {}
    for i, t, s in rows:
        t, words = t or "", [w for w in re.split(f"{SPACE}+", t or "") if w]
        least = low.get(t)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": least is not None and (i is None or least < i),
        }
        of.setdefault(s or "", []).append(({k for k, v in fails.items() if v}, *(any(x[j] == 1 for x in labels if x[0] == i and i is not None) for j in (1, 2))))
    for part, docs in of.items():
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                here = [d for d in docs if f in d[0] and not d[0] & set(order[:step])]
                out[part, "".join(order), step + 1] = [
                    sum(not d[0] & set(order[: step + 1]) for d in docs), len(here), sum(f in d[0] for d in docs) - len(here),
                    sum(d[0] == {f} for d in docs), sum(d[1] for d in here), sum(d[2] for d in here),
                ]
    share = {}
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_against_brute_force(spark, docs):
    r = random.Random(5)
    rows = []
    for i in range(60):
        n = r.choice([0, 5, 199, 200, 201, 300])
        words = [f"w{r.randrange(r.choice([20, 100, 5000]))}" + r.choice(["", "", "$"] if i % 3 == 0 else [""]) for _ in range(n)]
        text = " ".join(w.upper() if i % 4 == 0 and j % 9 == 0 else w for j, w in enumerate(words))
        rows.append((r.choice([None, i, i, i]), text, r.choice(["a", "b", None, ""])))
    rows += [(100 + i, rows[7][1], "hot") for i in range(40)] + [(3, rows[3][1], "a"), (3, rows[3][1], "a"), (None, None, "a"), (200, None, None), (201, "", "a")]
    rows += [(300, "é|\t B", "b"), (301, "Long " * 100_000, "b")]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 140, 3)] + [(3, None, 1), (None, 1, 1), (9, 0, 0)]
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    d = docs([(i, t, "en", s) for i, t, s in rows]).repartition(3)
    got = filteraudit.report(d, lab).collect()
    assert {(x.part, x.filter_order, x.step): tuple(x)[3:] for x in got} == brute(rows, labels) and len(got) == 600 * len({s or "" for _, _, s in rows})
    assert filteraudit.report(d.limit(0), lab).count() == 0
