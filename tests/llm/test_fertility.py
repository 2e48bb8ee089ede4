import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import fertility

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enc():
    return fertility.Encoder(fertility.Files())


def plain(text, enc):
    """The counts of a text and its entropy, each word encoded by itself."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    parts = [w[i : i + 256] for w in words for i in range(0, len(w), 256)]
    tokens = [t for p in parts for t in enc.pieces.encode(p)]
    n = Counter(tokens)
    out = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_pieces": len(tokens),
        "n_ranks": sum(len(enc.ranks.encode_ordinary(" " + p)) for p in parts), "n_fallback": sum(enc.pieces.is_byte(t) for t in tokens),
    }
    return out, -sum(c / len(tokens) * math.log2(c / len(tokens)) for c in n.values())


def cases():
    r = random.Random(2)
    names = [f"wörd{i}" for i in range(40)]
    rows = [" ".join(r.choice(names[: r.choice([2, 40])]) for _ in range(r.choice([1, 7, 8, 9, 16, 50, 300]))) for _ in range(40)]
    rows += ["a b c d e f g h a b c d e f g h", "x " * 30, "one line\none line\n \n \n one line\n\n\n", None, "", "\t\n", "  　x ", "中文字" * 300]
    rows += ["\x01\U0001f600𓀀 <b>#1|&", "y" * 1000 + " " + "y" * 256 + " " + "y" * 257, "مرحبا بالعالم", "привет мир", "1 2 3"]
    return rows


def test_counts_against_word_by_word_encoding(enc, monkeypatch):
    texts = cases()
    for piece, known in ((1 << 18, 1 << 18), (16, 50)):
        monkeypatch.setattr(fertility, "PIECE", piece)
        monkeypatch.setattr(fertility, "KNOWN", known)
        out, bits, script = fertility.measures(pa.array(texts, pa.string()), enc)
        for i, text in enumerate(texts):
            want, h = plain(text, enc)
            assert {k: int(v[i]) for k, v in out.items()} == want and abs(bits[i] - h) < 1e-9
    named = dict(zip(texts, (fertility.NAMES[s] for s in script)))
    assert [named[t] for t in ("中文字" * 300, "مرحبا بالعالم", "привет мир", "1 2 3", None)] == ["han", "arabic", "cyrillic", "none", "none"]


def test_windows_in_blocks_of_any_size():
    r = random.Random(4)
    for _ in range(50):
        texts = [[r.randrange(3) for _ in range(r.choice([0, 5, 12, 40]))] for _ in range(5)]
        ids, bounds = np.array([x for t in texts for x in t], np.int32), np.cumsum([0, *map(len, texts)])
        want = []
        for t in texts:
            w = [tuple(t[i : i + 4]) for i in range(len(t) - 3)]
            c = Counter(w)
            want.append(len({j for i, x in enumerate(w) if c[x] > 1 for j in range(i, i + 4)}))
        for block in (1, 3, 7, 1000):
            assert fertility.repeated(ids, bounds, 4, block).tolist() == want


def brute_bands(rows):
    """Bands of lists of figures by group: bin of the value a quarter, and three quarters, up in order."""
    out = {}
    for g in {r["g"] for r in rows}:
        for name, (scale, least, low, high) in fertility.FIGURES.items():
            bins = sorted(math.floor(r[name] * scale) for r in rows if r["g"] == g)
            q1, q3 = (bins[math.ceil(Fraction(k * len(bins), 4)) - 1] for k in (1, 3))
            a, b = q1 / scale, (q3 + 1) / scale
            reach = fertility.REACH * max(b - a, least)
            out[g, name] = (a - reach if low else -math.inf, b + reach if high else math.inf)
    return out


def test_report_against_brute_force(spark, docs, enc):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    junk = " ".join(f"{w}$$$" for w in rows[0][1].split())
    rows += [(10_000 + i, t, r, "x") for i, (t, r) in enumerate(zip(cases(), ["en", None] * 40))] + [(20_000, junk, rows[0][2], "x"), rows[3], (None, rows[4][1], "en", "x")]
    got = [r.asDict() for r in fertility.report(docs(rows).repartition(3)).collect()]
    assert len(got) == len(rows)
    want = []
    for i, t, lang, _ in rows:
        c, h = plain(t, enc)
        n = max(1, c["n_pieces"])
        f = {"chars_per_piece": c["word_chars"] / n, "chars_per_rank": c["word_chars"] / max(1, c["n_ranks"]), "fallback_share": c["n_fallback"] / n, "evenness": h / math.log2(n) if c["n_pieces"] > 1 else 0.0}
        script = fertility.NAMES[fertility.measures(pa.array([t], pa.string()), enc)[2][0]]
        want.append({**c, **f, "doc_id": i, "g": (lang, script, int(math.log2(n))), "base_failed": c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]})
    limits = brute_bands([w for w in want if not w["base_failed"]])
    for w in want:
        w["outside"] = "" if w["base_failed"] else ",".join(n for n in fertility.FIGURES if not limits[w["g"], n][0] <= w[n] <= limits[w["g"], n][1])
        w["kept"] = not w["base_failed"] and not w["outside"]
    keys = ("doc_id", *fertility.COUNTS, "base_failed", "outside", "kept")
    assert sorted(str([g[k] for k in keys]) for g in got) == sorted(str([w[k] for k in keys]) for w in want)
    of = {g["doc_id"]: g for g in got}
    assert "chars_per_rank" in of[20_000]["outside"] and not of[20_000]["kept"]
    assert sum(g["kept"] for g in got if not g["base_failed"]) > 0.85 * sum(not g["base_failed"] for g in got)
    assert fertility.report(docs(rows).limit(0)).count() == 0
