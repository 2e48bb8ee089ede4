import hashlib
import random
import re

from pyspark.sql import functions as F

from loreweave.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(t):
    t = t or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    joined = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(k == n for _, k, _ in spans) for n in range(3)), hashlib.sha256(joined.encode()).hexdigest(), spans


def case():
    r = random.Random(6)
    parts = ["password: ", "PassWd = '", "token", "=", ":", "api_key\"", "apikey =", "secret=", " ", "AKIA", "AKIAAKIA", "0123456789abcdef", "deadbeef", "ABCDEFGHIJKLMNOP1", "é", "日本 ", "x.y/z", "\n", "toKen", "12345", "123456", "ſecret=abcdefgh", "K"]
    rows = [(i, "".join(r.choice(parts) for _ in range(r.choice([2, 9, 40])))) for i in range(400)]
    return rows + [(500, None), (501, ""), (502, "secret=token: abcdefgh"), (None, "token=abcdef"), (503, "lorem " * 100_000 + "token = 'abcdef'"), rows[0], rows[0]]


def test_patterns_against_brute_force(spark, docs):
    rows = case()
    got = docs(rows).select("doc_id", "text", secrets.find(F.col("text"), b"").alias("f")).collect()
    for r in got:
        count, sha, spans = brute(r.text)
        assert ((r.f.n_assign, r.f.n_access, r.f.n_hex), r.f.base_sha256) == (count, sha)
        assert {f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans} <= set(r.f.spans.split(",")) | {""}
    assert docs([]).select(secrets.find(F.col("text"), b"")).count() == 0


def test_novel_strings(spark, docs):
    r = random.Random(8)
    noise = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32))
    name = "DefaultHttpClientConfigurationFactory2"
    rows = [(1, f"auth header Bearer {noise} end"), (2, f"private key class {name} end"), (3, f"nothing near {noise} here"), (4, f"token = {noise}")]
    rows += [(10 + i, f"import {name}; {name}") for i in range(5)]
    d = docs(rows)
    dictionary = secrets.identifiers(d)
    assert name.encode() in dictionary and len(dictionary) < secrets.DICTIONARY + 1000
    got = {x.doc_id: x.f.spans for x in d.select("doc_id", secrets.find(F.col("text"), dictionary).alias("f")).collect()}
    assert got[1] == f"novel:{rows[0][1].index(noise)}:{rows[0][1].index(noise) + 32}"
    assert got[2] == "" and got[3] == "" and got[4].startswith("assign:0:") and "novel" not in got[4]
    assert secrets.identifiers(docs([])) == secrets.COMMON.encode()


B62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def drawn(r, n, letters=B62):
    return "".join(r.choice(letters) for _ in range(n))


def plain(r, n):
    return " ".join(r.choice("we set the remote host and then name a new port for each user of this service".split()) for _ in range(n))


def novel(text, dictionary=secrets.COMMON.encode()):
    return [x["span"] for x in secrets.scan(text, dictionary)["spans"] if x["key"] is not None]


def test_a_secret_that_occurs_twice_is_found_twice():
    r = random.Random(3)
    for words in (3, 20, 50, 75):
        for _ in range(20):
            a, b = drawn(r, 40), drawn(r, 2)
            text = f"{plain(r, 9)} bearer {a} {plain(r, words)} bearer {b}/{a} {plain(r, 9)}"
            first, second = text.index(a), text.index(f"{b}/{a}")
            assert novel(text) == [f"novel:{first}:{first + 40}", f"novel:{second}:{second + 43}"]


def test_a_copied_key_does_not_become_known(spark, docs):
    r = random.Random(4)
    key, other, name = drawn(r, 40), drawn(r, 40), "RemoteServiceAccountSettings2"
    both = f"run {key} once, {plain(r, 12)}; auth header Bearer {key} end"
    rows = [(i, both) for i in range(6)] + [(10, f"run {other} now"), (11, f"start {other} now"), (12, f"auth header Bearer {other} end")]
    rows += [(20, f"use {name} now"), (21, f"take {name} now"), (22, f"auth header Bearer {name} end")]
    d = docs(rows)
    got = {x.doc_id: x.spans for x in secrets.report(d.select("doc_id", "text")).collect()}
    at = both.rindex(key)
    assert len(got) == len(rows) and all(got[i] == f"novel:{at}:{at + 40}" for i in range(6))
    assert got[12] == "novel:19:59" and got[10] == got[11] == got[20] == got[21] == got[22] == ""
    assert not {key.encode(), other.encode()} & set(secrets.identifiers(d).split())


def test_short_texts_hide_no_secret():
    r = random.Random(5)
    for n, letters in ((20, B62), (40, B62), (64, "0123456789ABCDEF"), (128, "0123456789ABCDEF")):
        for words in (0, 2, 5, 8, 20):
            assert sum(len(novel(f"{plain(r, words)} bearer {drawn(r, n, letters)} {plain(r, words)}")) for _ in range(50)) == 50


def test_identifiers_past_the_dictionary_are_known(spark, docs):
    r = random.Random(6)
    word = lambda: drawn(r, 1, "BCDFGHKLMNPRSTVW") + "".join(drawn(r, 1, "aeiou") + drawn(r, 1, "bcdfghklmnprstvw") for _ in range(3))
    names = ["".join(word() for _ in range(4)) + "2" for _ in range(60)] + ["".join(word() for _ in range(14)) + "2"]
    rows = [(1000 + i, f"auth header Bearer {x} end") for i, x in enumerate(names)] + [(i, f"{j} uses {x}") for i, x in enumerate(names) for j in "ab"]
    d = docs(rows)
    assert secrets.identifiers(d, 200).count(b"2") < 10 + secrets.COMMON.count("2")
    assert {x.spans for x in secrets.report(d.select("doc_id", "text"), 200).collect()} == {""}
    assert secrets.report(docs([]).select("doc_id", "text")).count() == 0
