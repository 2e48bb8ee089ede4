import hashlib
import random
import re

import pytest

from loreweave.llm import fillmiddle
from loreweave.llm.fillmiddle import Frames


def texts():
    r = random.Random(3)
    out = ["".join(r.choice(["a", "é", "中", "\U0001f600", "\n", " ", "<", "P", ">"]) for _ in range(r.choice([1, 5, 40, 300]))) for _ in range(60)]
    return out + ["", "\n", "\n\n\n", "x", "x\n", "<P>\na\nb", "a\n<S>", "<M", "<<P\n>S\n", "é" * 500 + "\n" + "z\n" * 500, "no end", "\r\n\r\n"]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 1 << 16])
def test_frames_cut_find_and_read(size):
    r = random.Random(size)
    for text in texts():
        data = text.encode()
        pieces, at = [], 0
        while at < len(data):
            n = r.choice([1, 3, 50, 1000])
            pieces.append(data[at : at + n])
            at += n
        f = Frames.pack(pieces, size)
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert f.n_units == len(units) and f.size == len(data) and len(f.ends) == -(-len(data) // size)
        assert b"".join(f.read(0, f.size)) == data
        for k in range(len(units) + 1) if units else ():
            head = "".join(units[:k])
            assert f.cut(k) == (len(head.encode()), len(head))
        for _ in range(10):
            a, b = sorted((r.randint(0, len(data)), r.randint(0, len(data))))
            assert b"".join(f.read(a, b)) == data[a:b]
            word = r.choice([b"<P>", b"P", b"\n", b"zz", data[a : a + 3] or b"q"])
            assert f.find(word, a) == data.find(word, a)


def test_only_the_frame_of_a_cut_is_decompressed(monkeypatch):
    text = "".join(f"line {i}\n" for i in range(50_000))
    f = Frames.pack([text.encode()])
    read = []
    monkeypatch.setattr(Frames, "frame", lambda self, i, own=Frames.frame: read.append(i) or own(self, i))
    at, points = f.cut(31_234)
    assert text[:points].count("\n") == 31_234 and at == points and len(read) == 1 and len(f.ends) > 5
    list(f.read(at, at + 10))
    assert len(set(read)) <= 2


def brute(doc_id, text, rate=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text, text
    spm = h4 % 100 < spm
    return doc_id, n, "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}", text


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("size,rate", [(5, 100), (1 << 16, 40)])
def test_transform_against_brute_force(spark, docs, monkeypatch, size, rate):
    monkeypatch.setattr(fillmiddle, "FRAME", size)
    rows = [(i, t, "en", "x") for i, t in enumerate(texts())] + [(None, "a\nb\nc"), (None, None), (3, texts()[3]), (3, texts()[3]), (900, "long line é\n" * 20_000)]
    d = docs(rows).repartition(3)
    planned = fillmiddle.plan(fillmiddle.store(d, size), rate=rate)
    got = fillmiddle.outputs(planned, size).withColumn("output", fillmiddle.render("output_frames")).collect()
    want = [brute(r[0], r[1], rate) for r in rows]
    assert sorted(str((r.doc_id, r.n_units, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in got) == sorted(str(w[:6]) for w in want)
    assert sorted(r.output_sha256 + r.restored_sha256 for r in got) == sorted(sha(w[5]) + sha(w[6]) for w in want)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fillmiddle.transform(d.limit(0)).count() == 0
