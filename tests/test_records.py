"""Record merges, the one-shot folds, job analytics: literal cases and brute-force twins."""
import random

from pyspark.sql import functions as F

from loreweave.functions.ordered import lag_in_key, row_number_in_key
from loreweave.operators import oneshot as O
from loreweave.operators import records as R
from loreweave.operators import runs as K

EV = R.EVIDENCE


def merge_twin(rows):
    """Fields of one record merged in arrival order: list of (field, [[value, confidence, quotes]])."""
    target = []
    for field, batch in rows:
        hit = next((t for t in target if t[0] == field), None)
        if hit:
            index = {v[0]: i for i, v in enumerate(hit[1])}
            for v, c, q in batch:
                if v in index:
                    old = hit[1][index[v]]
                    old[1] = c if old[1] is None else old[1]
                    old[2] += [x for x in q if x not in old[2]]
                else:
                    index[v] = len(hit[1])
                    hit[1].append([v, c, list(q)])
            continue
        kept = []
        for v, c, q in batch:
            old = next((x for t in target if t[0] != field for x in t[1] if x[0] == v), None)
            if old:
                old[1] = c if old[1] is None else old[1]
                old[2] += [x for x in q if x not in old[2]]
            else:
                kept.append([v, c, list(q)])
        if kept:
            target.append([field, kept])
    return [(f, v, c, tuple(q)) for f, vs in target for v, c, q in vs]


def test_merge_fields_equals_twin(spark):
    rng = random.Random(11)
    docs, rows = {}, []
    for rec in range(150):
        docs[rec] = []
        for batch in range(rng.randint(1, 7)):
            field = rng.choice("abc")
            vals = [(rng.choice("xyzu"), rng.choice([None, 0.5]), [rng.choice("pq")]) for _ in range(rng.randint(1, 2))]
            docs[rec].append((field, vals))
            for pos, (v, c, q) in enumerate(vals):
                rows.append((rec, field, "L", batch, pos, v, c, None, None, None, None, [(1, None, None, x, "r") for x in q]))
    schema = "record_id int, field_key string, field_label string, batch int, pos int, value_text string, confidence double, related_character string, relationship_type string, relationship_label string, relationship_direction string, evidence " + EV

    df = spark.createDataFrame(rows, schema)
    got = {}
    for r in R.merge_fields(df).collect():
        got.setdefault(r.record_id, []).append((r.field_key, r.value_text, r.confidence, tuple(e.quote for e in r.evidence)))
    norm = lambda xs: sorted((f, v, c is None, tuple(sorted(q))) for f, v, c, q in xs)
    for rec in docs:
        assert norm(got[rec]) == norm(merge_twin(docs[rec])), docs[rec]


def test_components_follow_chains(spark):
    edges = [(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (1, 3, "b"), (1, 9, "z"), (2, 1, "a")] + [(3, i, f"k{i}") for i in range(20)] + [(3, i, f"k{i + 1}") for i in range(19)]
    df = spark.createDataFrame(edges, "chapter_id int, node int, k string")
    got = {(r.chapter_id, r.node): r.label for r in R.components(df, ["chapter_id"], "node", "k").collect()}
    assert got[1, 1] == got[1, 2] == got[1, 3] == 1 and got[1, 9] == 9 and got[2, 1] == 1
    assert {got[3, i] for i in range(20)} == {0}


def probable(spark, records):
    """records: (ord, name, mentions, aliases, attribute values)"""
    rec = spark.createDataFrame([(1, o, n) for o, n, *_ in records], "chapter_id int, record_ord int, display_name string")
    men = spark.createDataFrame([(1, o, i * 10, i * 10 + 3, n) for o, n, m, *_ in records for i in range(m)], "chapter_id int, record_ord int, start_char int, end_char int, text string")
    val = spark.createDataFrame(
        [(1, o, "other_alias", a) for o, _, _, al, _ in records for a in al] + [(1, o, "appearance", v) for o, _, _, _, vs in records for v in vs],
        "chapter_id int, record_ord int, field_key string, value_text string")
    return sorted(tuple(r)[1:] for r in O.merge_probable_aliases(rec, men, val).collect())


def test_near_names_without_alias_stay_apart(spark):
    assert probable(spark, [(0, "Han Lap Ma", 5, [], []), (1, "Han Lap Mo", 1, [], [])]) == []


def test_name_near_an_alias_folds(spark):
    assert probable(spark, [(0, "Nam Cung", 5, ["Han Lap Ma"], []), (1, "Han Lap Mo", 1, [], [])]) == [(1, 0, "near_alias_surface", 0)]
    assert probable(spark, [(0, "Nam Cung", 5, ["Han Lap Ma"], []), (1, "Han Lap Mo", 3, [], [])]) == []
    assert probable(spark, [(0, "Nam Cung", 5, ["Han Lap Ma"], []), (1, "Han Lap Mo", 1, [], ["tall"])]) == []


def test_folds_chain_and_exact_wins(spark):
    got = probable(spark, [(0, "Lao Ma", 1, ["Han Lap"], []), (1, "Han Lap", 1, ["Big One"], []), (2, "Big One", 0, [], []), (3, "King Old", 9, ["Lao Ma"], [])])
    # 0 folds into 3, then 1 into 3 (its name is an alias 3 took over), then 2 likewise
    assert got == [(0, 3, "exact_alias_surface", 3), (1, 3, "exact_alias_surface", 3), (2, 3, "exact_alias_surface", 3)]


def test_label_variants_collapse_and_keep_evidence(spark):
    rows = [(0, 0, True, "miller", "Han", "self_to_related", "trade", 0.6, [(1, 5, 9, "first", "r")]), (1, 0, False, "miller of the ford", "Han", "self_to_related", "trade_ford", 0.9, [(1, 1, 4, "second", "r")]),
            (2, 0, False, "boss", "Han", "self_to_related", "work", None, [(1, 1, 4, "second", "r")])]
    df = spark.createDataFrame([("c", "p", *r) for r in rows], "chapter_id string, entity_key string, ord int, pos int, first boolean, value string, related string, direction string, rtype string, confidence double, evidence " + EV)
    got = [(r.value, r.rtype, r.confidence, [e.quote for e in r.evidence]) for r in O.merge_relationship_values(df, ["chapter_id", "entity_key"]).orderBy("pos").collect()]
    assert got == [("miller of the ford", "trade_ford", 0.9, ["second", "first"]), ("boss", "work", None, ["second"])]


def context(spark, records, present, limit=24):
    rec = spark.createDataFrame([(1, f"r{i}", c, k, n) for i, (c, k, n, _) in enumerate(records)], "scope_id int, record_id string, chapter_num long, entity_key string, display_name string")
    val = spark.createDataFrame([(f"r{i}", p, *v) for i, (_, _, _, vs) in enumerate(records) for p, v in enumerate(vs)], "record_id string, pos int, value string, related string, direction string, rtype string, evidence " + EV)
    pre = spark.createDataFrame([(1, c, k) for c, k in present], "scope_id int, chapter_num long, identity_key string")
    return [r.asDict() for r in O.known_relationship_context(rec, val, pre, limit).orderBy("chapter_num", "left_key", "right_key").collect()]


def test_only_earlier_relationships_are_context(spark):
    said = lambda c: [("uncle", "B", "self_to_related", "kin", [(c, None, None, "q", "r")]), ("nephew", "A", "related_to_self", "kin", [(c, None, None, "q", "r")])]
    got = context(spark, [(1, "relationship|a|b", "A ↔ B", said(1)), (3, "relationship|a|b", "A ↔ B", said(3)), (1, "relationship|a|z", "A ↔ Z", said(1))], [(2, "a"), (2, "b")])
    assert len(got) == 1
    assert (got[0]["left_name"], got[0]["right_name"], got[0]["left_to_right"], got[0]["right_to_left"], got[0]["evidence_chapters"]) == ("A", "B", "uncle", "nephew", [1])


def test_context_limit_stops_reading(spark):
    v = lambda label: [(label, "X", "self_to_related", label, [])]
    recs = [(1, "relationship|a|b", "A ↔ B", v("one")), (2, "relationship|a|c", "A ↔ C", v("two")), (3, "relationship|a|b", "A ↔ B", v("one more"))]
    got = context(spark, recs, [(9, "a"), (9, "b"), (9, "c")], limit=2)
    assert [(g["right_key"], g["left_to_right"]) for g in got] == [("b", "one"), ("c", "two")]
    assert [g["left_to_right"] for g in context(spark, recs, [(9, "a"), (9, "b"), (9, "c")], limit=3)] == ["one more", "two"]


def test_ordered_helpers_across_buckets(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.randint(0, 9)) for i in rng.sample(range(500), 120)]
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    got = {(r.k, r.seq): r.p for r in lag_in_key(df, ["k"], "seq", "v", "p", width=7).collect()}
    num = {(r.k, r.seq): r.n for r in row_number_in_key(df, ["k"], "seq", "n", width=7).collect()}
    for k in "ab":
        prev = None
        for n, (_, s, v) in enumerate(sorted(r for r in rows if r[0] == k)):
            assert got[k, s] == prev and num[k, s] == n + 1
            prev = v


def test_transitions(spark):
    pairs = [(a, b) for a in K.STATUSES for b in K.STATUSES]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b) for r in df.filter(K.legal_edge(F.col("a"), F.col("b"))).collect()}
    assert got == set(K.EDGES) | {(s, s) for s in K.STATUSES}


def test_replay_in_small_buckets_equals_twin(spark):
    rng = random.Random(9)
    jobs = [(j, rng.choice(K.STATUSES)) for j in range(8)]
    reqs = [(j, s, rng.choice(K.STATUSES)) for j, _ in jobs for s in rng.sample(range(400), 60)]
    jd = spark.createDataFrame([(j, s, None, None, "old", "oldmsg") for j, s in jobs], "job_id int, status string, started_at long, finished_at long, error_code string, error_message string")
    rd = spark.createDataFrame([(j, s, t, s, f"r{s}", f"c{s}") for j, s, t in reqs], "job_id int, sequence long, target string, at long, reason string, code string")
    after, events, refused = K.replay_jobs(jd, rd, width=5)
    final = {r.job_id: r.status for r in after.collect()}
    done = sorted((r.job_id, r.sequence, r.from_status, r.to_status) for r in events.collect())
    no = sorted((r.job_id, r.sequence, r.from_status) for r in refused.collect())
    legal = set(K.EDGES)
    want_done, want_no, want_final = [], [], {}
    for j, s in jobs:
        for _, q, t in sorted(r for r in reqs if r[0] == j):
            if s == t:
                continue
            if (s, t) in legal:
                want_done.append((j, q, s, t))
                s = t
            else:
                want_no.append((j, q, s))
        want_final[j] = s
    assert final == want_final and done == sorted(want_done) and no == sorted(want_no)


def test_pause_keeps_reason_and_run_clears_it(spark):
    jd = spark.createDataFrame([(1, "pending", None, None, None, None)], "job_id int, status string, started_at long, finished_at long, error_code string, error_message string")
    rows = [(1, 1, "running", 10, None, None), (1, 2, "paused", 20, "why", "code"), (1, 3, "running", 30, None, None), (1, 4, "paused", 40, "again", None), (1, 5, "cancelled", 50, None, None)]
    rd = spark.createDataFrame(rows, "job_id int, sequence long, target string, at long, reason string, code string")
    after, events, _ = K.replay_jobs(jd, rd)
    assert tuple(after.first()) == (1, "cancelled", 10, 50, None, "again")
    assert [r.event_type for r in events.orderBy("sequence").collect()] == ["analysis_job_started", "analysis_job_paused", "analysis_job_resumed", "analysis_job_paused", "analysis_job_cancelled"]


def test_reset_keeps_the_alias_map_up(spark):
    """After a reset the map equals one that is built from what is left, whatever left it: first, best or only sources."""
    from loreweave.operators import aliases as J
    from loreweave.operators import runs as RU

    rng = random.Random(6)
    names = ["Han Lap", "Nam Cung Uyen", "Ma Quang", "Han Lap"]
    rec = [(j, f"{j}/{c}/{k}", c, ["han_lap", "nam_cung", " "][k % 3], names[(c + k) % 4]) for j in (1, 2) for c in range(1, 9) for k in range(3)]
    val = [(r[1], ["other_alias", "Nickname", "appearance"][rng.randrange(3)], "L", p, rng.choice(["Han Nhi", "Old Ma", "Uyen Nhi", "x"]), rng.choice([None, 0.2, 0.9])) for r in rec for p in range(3)]
    records = spark.createDataFrame(rec, "job_id int, record_id string, chapter_num int, entity_key string, display_name string")
    values = spark.createDataFrame(val, "record_id string, field_key string, field_label string, pos int, value_text string, confidence double").withColumn(
        "evidence", F.when(F.col("pos") == 1, F.array(F.struct(F.col("record_id").alias("quote")))).otherwise(F.array().cast("array<struct<quote:string>>")))
    aliases = J.rebuild_alias_map(records, values)
    for resets in ([(1, 1, 3)], [(1, 2, 2), (1, 5, 8), (2, None, None)], []):
        r = spark.createDataFrame(resets, "job_id int, from_num int, to_num int")
        out = RU.reset_records(records, {}, values, aliases, r)
        left = [x for x in rec if not any(x[0] == j and (a is None or a <= x[2] <= b) for j, a, b in resets)]
        assert sorted(x.record_id for x in out["records"].collect()) == sorted(x[1] for x in left)
        kept = spark.createDataFrame(left, records.schema)
        want = J.rebuild_alias_map(kept, values.join(kept.select("record_id"), "record_id", "left_semi"))
        assert sorted(map(str, out["aliases"].collect())) == sorted(map(str, want.collect()))
        assert out["values"].count() == 3 * len(left)


def test_aliases_of_a_name_are_checked_once_for_all_its_chapters(spark, monkeypatch):
    """Every alias row of a name met every chapter of that name before E4 ran."""
    from loreweave.operators import identity as E

    rows, push = [], E.push_alias
    monkeypatch.setattr(E, "push_alias", lambda aliases, keys: (rows.append(aliases.count()), push(aliases, keys))[1])
    names = {1: ["Anna Kell", "anna kell", "Bo Rand"], 2: ["Anna Kell"]}  # two spellings of one key are two owners
    ids = spark.createDataFrame(
        [(c, n, name) for n, ns in names.items() for name in ns for c in range(n * 100, n * 100 + 20)] + [(100, 1, "Bo Rand")], "chapter_id int, novel_id int, name string")
    said = [(1, "Anna Kell", 3, "Red Fox"), (1, "Anna Kell", 1, "The Fox"), (1, "ANNA KELL", 2, "the fox"), (1, "Bo Rand", 4, "Bo Rand"), (2, "Anna Kell", 5, "Grey"), (2, "Cy", 6, "Blue")]
    amap = spark.createDataFrame(
        [(n, who, i, text, "alias", "", None, ["he said"] if i == 2 else []) for n, who, i, text in said],
        "novel_id int, display_name string, ord int, alias_text string, alias_type string, alias_label string, confidence double, quotes array<string>")
    out = R.hydrate_aliases(ids, amap, ["chapter_id"])
    assert out.columns == ["chapter_id", "name", "text", "alias_type", "alias_label", "is_primary", "ord", "quotes"]
    got = sorted((r.chapter_id, r.name, r.text, r.ord, tuple(r.quotes)) for r in out.collect())
    first = [("Red Fox", 3, ()), ("The Fox", 1, ())]  # "the fox" has no capital letter and is refused with its quote
    want = [(c, name, *f) for c in range(100, 120) for name in ("Anna Kell", "anna kell") for f in first] + [(c, "Anna Kell", "Grey", 5, ()) for c in range(200, 220)]
    assert got == sorted(want) and rows == [8]


def test_white_space_of_a_text_is_collapsed_before_its_quotes_meet_it(spark):
    """Every quote collapsed the whole text anew."""
    from loreweave.operators import relations as H

    texts = spark.createDataFrame([(1, "He  said:\n\tgo home"), (2, ""), (3, None)], "chapter_id int, content string")
    said = [(1, "said: go"), (1, " He \t said: "), (1, "went"), (1, " "), (1, None), (2, "x"), (2, ""), (3, "x"), (4, "x")]
    quotes = spark.createDataFrame([(c, i, q) for i, (c, q) in enumerate(said)], "chapter_id int, cand_id int, quote string")
    out = H.quotes_in_texts(quotes, texts)
    assert {(r.cand_id, r.found) for r in out.collect()} == {(0, True), (1, True), *((i, False) for i in range(2, 8))}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "content#" in plan and "content#" not in plan[: plan.index("Join")], plan
