"""Scores searched from level to level, and the cells and joins under them."""
import random

import pyarrow as pa
from test_identity import lev
from test_staged_scores import made, rows

from loreweave.operators import identity as E
from loreweave.operators import nearkeys as N
from loreweave.plans import inputs as I


def names(rng, n):
    return sorted({"".join(rng.choice(["th", "er", "on", "é", "漢", "_", "ab"]) for _ in range(rng.randint(2, 7))).strip("_") or "x" for _ in range(n)})


def test_parts_and_bits_find_the_same_near_keys(monkeypatch):
    """cells compared every key with all others, also where a high minimum leaves long parts whole."""
    rng = random.Random(2)
    a, b = (N._by_length(pa.array(names(rng, 150))) for _ in range(2))
    for share in (0.02, 0.16, 0.23, 0.3):
        want = {(x, y) for x in a.to_pylist() for y in b.to_pylist() if lev(x, y) <= int(max(len(x), len(y)) * share + 1e-9)}
        for common, many in ((1, 1 << 20), (0, 50), (10**9, 50)):  # as it is, only parts, only bits; in one go and in pieces
            monkeypatch.setattr(N, "COMMON", common)
            monkeypatch.setattr(N, "MANY", many)
            got = [(a[int(i)].as_py(), b[int(j)].as_py()) for x, y in N._near_pairs(N._Keys(a), N._Keys(b), share) for i, j in zip(x, y)]
            assert len(got) == len(set(got)) and set(got) == want


def test_keys_that_hold_others_meet_in_cells():
    rng = random.Random(4)
    a, b = (N._by_length(pa.array(names(rng, 200) + ["onon_onon", "onon_onon_onon", f"x_onon_onon{k}"])) for k in range(2))
    one, other = N._Sums(a), N._Sums(b)
    got = [(a[int(i)].as_py(), b[int(j)].as_py()) for x, y in N._held_pairs(one, other, 7) for i, j in zip(x, y)]
    want = {(x, y) for x in a.to_pylist() for y in b.to_pylist() if x != y and len(x) >= 7 and x in y}
    assert len(got) == len(set(got)) and set(got) == want and len(want) >= 3


def test_blocks_are_never_sent_to_every_task(spark):
    """the planner took the blocks of all names to be as small as their files and collected them in the driver."""
    seen, cand, _, _, _ = made(spark, 1)
    plan = E.score_candidates(seen, cand)._jdf.queryExecution().executedPlan().toString()
    assert "_b#" in plan and not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and ("_b#" in x or "gram#" in x or "_l#" in x)]


def test_review_reads_the_scores_of_a_level_only_until_it_is_decided(spark, monkeypatch):
    """Every name was searched down to the review score, also where a near runner-up had decided it."""
    searched, near = {}, E.near_keys
    for seed in (5, 8):
        seen, cand, _, _, _ = made(spark, seed)
        columns = ("target_key", "score", "chapter_num", "display_name", "cand_id")
        want = rows(E.merge_review_candidate(E.score_candidates(seen, cand)), *columns)
        with monkeypatch.context() as m:
            m.setattr(E, "near_keys", lambda left, right, scope, minimum: (
                searched.setdefault(minimum, []).extend(r.skey for r in left.collect()), near(left, right, scope, minimum))[1])
            assert rows(E.merge_review_candidate(E.review_scores(seen, cand)), *columns) == want and want
    assert len(searched[0.84]) > len(searched[0.77]) >= len(searched[E.REVIEW_MIN])


def test_known_names_of_a_novel_without_a_grouping_by_chapter(spark, tmp_path):
    """the texts were read for names three times, and grouped by chapter before they were grouped by novel."""
    text = "Benjamin walks. Benjamin walks and Caroline sings; Margarete dwells"
    docs = [(k, f"{text} Octavian{'a' * (k % 3)} sleeps", "s1" if k % 2 else None) for k in range(6)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, I.run(spark, str(tmp_path), I.candidates).collect()), key=str)
    by_chapter = lambda d: I.candidates("duck").replace(I.identities("duck"), I.identities("spark"))
    assert got == sorted(map(tuple, I.run(spark, str(tmp_path), by_chapter).collect()), key=str) and len(got) > 5
