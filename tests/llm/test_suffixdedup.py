import hashlib
import random

from loreweave.llm import suffixdedup as sd


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    seen, out, later, last = set(), [], set(), object()
    for i, t in order:
        if i != last:
            seen |= later
            later, last = set(), i
        b = (t or "").encode()
        mask = bytearray(len(b))
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                mask[p : p + 50] = b"\1" * 50
            later.add(b[p : p + 50])
        kept = bytes(c for c, m in zip(b, mask) if not m)
        spans = sum(m and not (p and mask[p - 1]) for p, m in enumerate(mask))
        out.append(str((i, len(b), sum(mask), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


def case():
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdeéñ ") for _ in range(n))
    parts = [text(n) for n in (49, 50, 51, 75, 200, 700)]
    rows = []
    for i in range(120):
        rows.append((r.randrange(200), text(r.choice([0, 10, 90])) + "".join(r.choice(parts)[r.choice([0, 0, 3]) :] + text(r.choice([0, 1, 30])) for _ in range(r.choice([0, 1, 3])))))
    rows += [(300, parts[5] * 3), (301, "z" * 5000), (302, "z" * 49), (303, "z" * 50), (304, "ab" * 3000), (305, "x" + "ab" * 100), (306, None), (307, ""), (None, parts[4]), (None, parts[4])]
    return rows + [(308, text(200_000) + parts[3]), rows[3], rows[3]]


def test_against_brute_force(spark, docs):
    rows = case()
    want = brute(rows)
    for size, entries in ((2_000, 500), (1 << 24, 1 << 20)):
        got = sd.remove_seen(docs(rows), size=size, entries=entries).collect()
        assert sorted(str((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in got) == want
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark, docs):
    assert sd.remove_seen(docs([])).count() == 0
    assert [(r.n_bytes, r.n_removed) for r in sd.remove_seen(docs([(1, None)])).collect()] == [(0, 0)]


def test_levels_merge_like_a_counter():
    import numpy as np

    levels = sd.Levels()
    for i in range(11):
        new = np.array([i * 10, i * 10 + 5], np.uint64)
        assert not levels.scan(new).any()
        levels.add(new)
    assert [n for n, _ in levels.levels] == [8, 2, 1]
    assert levels.scan(np.arange(0, 110, 5, dtype=np.uint64)).all()


def test_named_suffixes_do_not_depend_on_pieces(monkeypatch):
    """Texts of all lengths name the same suffixes, in whatever pieces they are read."""
    import numpy as np
    import pyarrow as pa

    r = random.Random(5)
    rows = ["".join(r.choice("abcé ") for _ in range(n)) for n in (0, 49, 50, 51, 300, 5000)] + ["z" * 900, "ab" * 700, "", "x" * 50]
    texts, found = pa.array(rows, pa.string()), []
    for stride in (1 << 20, 1000, 64, 7):
        monkeypatch.setattr(sd, "STRIDE", stride)
        s = sd.Suffixes(texts, np.arange(len(rows)))
        found.append([x.tolist() for x in (s.key, s.context, s.low, s.high, s.doc)])
    assert found[0] == found[1] == found[2] == found[3] and len(found[0][0]) > 300
