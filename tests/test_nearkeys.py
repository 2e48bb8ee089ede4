"""Candidates of the similarity search: near keys in cells, words and borders in blocks."""
import random

from test_identity import lev

from loreweave.operators import identity as E
from loreweave.operators import nearkeys as N

SYLLABLES = ["th", "er", "on", "é", "漢", "𝄞", "_"]


def made(rng, n):
    return sorted({"".join(rng.choice(SYLLABLES) for _ in range(rng.randint(2, 6))).strip("_") or "x" for _ in range(n)})


def test_cells_find_all_near_keys_and_no_other(spark, monkeypatch):
    monkeypatch.setattr(N, "PIECE", 40)  # several pieces of each side
    rng = random.Random(5)
    left = {1: made(rng, 130), 2: made(rng, 30), 3: ["only_left"]}
    right = {1: made(rng, 150), 2: made(rng, 90), 4: ["only_right"]}
    frame = lambda d: spark.createDataFrame([(s, k) for s, ks in d.items() for k in ks], "novel_id int, skey string")
    rows = [tuple(r) for r in N.near_keys(frame(left), frame(right), ["novel_id"], 0.70).collect()]
    want = {(s, a, b) for s in (1, 2) for a in left[s] for b in right[s] if lev(a, b) <= int(max(len(a), len(b)) * 0.3 + 1e-9)}
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 50


def test_a_word_or_an_ending_of_many_names_pairs_no_others(spark):
    """Names that share their long first word, or the letters round a border, met in one block each: all pairs."""
    names = [f"governor_{x}{y}" for x in "bcdfghklmn" for y in "aeiou"] + [f"{x}{y}tion_the{x}" for x in "bcdfghklmn" for y in "aeiou"]
    keys = spark.createDataFrame([(1, k) for k in names], "novel_id int, skey string")
    met = E._block_rows(keys, ["novel_id"], "left", "_l").join(E._block_rows(keys, ["novel_id"], "right", "_r"), ["novel_id", "_kind", "_b"])
    assert met.select("_l", "_r").distinct().filter("_l <> _r").count() <= len(names)


def test_very_long_keys_are_found(spark):
    long = "_".join(f"word{i}x{i * i}" for i in range(12))
    data = [(1, "a", long.replace("_", " "), [])]
    ld = spark.createDataFrame(data, "novel_id int, left_id string, name string, aliases array<string>")
    rd = spark.createDataFrame([(1, "b", long.replace("_", " ").replace("w", "v"), []), (1, "c", long[:30].replace("_", " ") + "q", [])], "novel_id int, right_id string, name string, aliases array<string>")
    assert len(long) > N.LONG
    got = {r.right_id: r.score for r in E.identity_scores(ld, rd).collect()}
    assert set(got) == {"b"} and abs(got["b"] - (1 - 12 / len(long))) < 1e-9


def test_a_high_minimum_searches_only_keys_long_enough_for_an_edit(spark, monkeypatch):
    """Scores from 0.98 upwards compared all names of a novel, though a name of less than 50 letters must be equal."""
    rng, seen = random.Random(9), []
    near = E.near_keys
    monkeypatch.setattr(E, "near_keys", lambda left, right, scope, minimum: (
        seen.extend(r.skey for df in (left, right) for r in df.collect()), near(left, right, scope, minimum))[1])
    made_up = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    long = [made_up(n) for n in (48, 49, 50, 51, 55, 64, 65, 80, 101, 120)]
    names = long + [made_up(n) + " " + made_up(4) for n in (4, 5, 9, 20) for _ in range(5)]
    changed = [n[:-1] if k % 3 == 0 else n[:7] + "x" + n[8:] if k % 3 == 1 else n for k, n in enumerate(names)]
    ld = spark.createDataFrame([(1, f"l{i}", n, []) for i, n in enumerate(names)], "novel_id int, left_id string, name string, aliases array<string>")
    rd = spark.createDataFrame([(1, f"r{i}{j}", n, [long[i % 10]]) for j, ns in enumerate((names, changed)) for i, n in enumerate(ns)],
                               "novel_id int, right_id string, name string, aliases array<string>")
    every = {(r.left_id, r.right_id): r.score for r in E.identity_scores(ld, rd).collect()}
    seen.clear()
    for minimum in (E.AUTO_MERGE, E.SAME):
        got = {(r.left_id, r.right_id): r.score for r in E.identity_scores(ld, rd, minimum=minimum).collect()}
        assert got == {k: s for k, s in every.items() if s >= minimum}
    assert any(s < 1 for s in every.values() if s >= E.AUTO_MERGE) and seen and min(map(len, seen)) >= 49
