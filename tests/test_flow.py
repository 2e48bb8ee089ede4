"""Whole flows: files, import, one-shot extraction, rewriting and streams."""
from pyspark.sql import functions as F

from loreweave.operators import modeltext as L
from loreweave.sources import corpus as C
from loreweave.sources import tables as T
from loreweave.streaming import streams as N


def test_text_files(spark, tmp_path):
    (tmp_path / "My Novel.v2.txt").write_text("Chapter 1\nHi.\n", encoding="utf8")
    (tmp_path / "blank.md").write_text(" \n\t", encoding="utf8")
    ok, bad = C.read_text_corpus(spark, str(tmp_path))
    assert [(r.title, r.text) for r in ok.collect()] == [("My Novel.v2", "Chapter 1\nHi.\n")]
    assert [r.title for r in bad.collect()] == ["blank"]


def test_import_life_cycle(spark):
    raw = spark.createDataFrame(
        [("k1", "p", " T ", "\n Chapter 1\nOne.\n\nChapter 2\nTwo.", "vi", " "), ("k2", "p", "", "x", None, None), ("k3", "p", "t", " ", None, None)],
        "source_key string, project_id string, title string, text string, source_language string, author string")
    t = C.import_novels(raw)
    n = t["novels"].first()
    assert (n.title, n.source_language, n.author) == ("T", "vi", None)
    assert t["chapters"].count() == 2 and t["segments"].count() == 2
    e = t["job_events"].first()
    assert (e.sequence, e.event_type, e.chapter_count, e.source_segment_count) == (1, "analysis_job_created", 2, 2)
    assert {r.source_key: r.error for r in t["errors"].collect()} == {"k2": "title_required", "k3": "text_required"}
    assert t["novels"].first().novel_id == C.import_novels(raw)["novels"].first().novel_id  # same input, same id
    seg = t["segments"].join(t["chapters"].select("chapter_id", "content"), "chapter_id").collect()
    assert all(r.content[r.start_char:r.end_char] == r.text for r in seg)


def test_redaction(spark):
    cases = {
        "invalid key AIzaSyA1234567890ABCDEFGHIJKLMNOP": "invalid key [redacted_api_key]", "Authorization: Bearer super-secret-token": "Authorization: Bearer [redacted_token]",
        "AIzaShort stays": "AIzaShort stays", "bearer bearer x": "bearer [redacted_token] x", "  ": "provider request failed", "xbearer a": "xbearer a",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", L.redact_secrets(F.col("t"))).collect()} == cases


def test_requests_fill_in_template_order(spark):
    df = spark.createDataFrame([(3, " ", "about {chapter_text}", "body")], "chapter_num int, title string, novel_context string, chapter_text string")
    got = L.build_requests(df, "{title}/{novel_context}/{unknown}/{chapter_num}").first().user_prompt
    assert got == "Untitled chapter/about body/{unknown}/3"
    assert "{chapter_text}" not in L.build_requests(df).first().user_prompt


def test_repair_is_tried_once(spark):
    df = spark.createDataFrame([(1, "x" * 24001), (2, "short")], "id int, t string")
    whole = {r.id: r.invalid_text for r in L.repair_queue(df, "t")[0].collect()}
    assert whole == {1: "x" * 24001, 2: "short"}
    again, failed = L.repair_queue(df, "t", limit=24000)
    rows = {r.id: r for r in again.collect()}
    assert rows[1].invalid_text == "x" * 24000 + "\n...[truncated]" and rows[2].invalid_text == "short" and rows[1].attempt == 1
    assert failed.count() == 0
    again2, failed2 = L.repair_queue(again.withColumnRenamed("invalid_text", "t"), "t")
    assert again2.count() == 0 and failed2.count() == 2


def test_versioned_table_rewrites_only_its_groups(spark, tmp_path):
    t = T.VersionedTable(str(tmp_path / "t"), ["job_id", "chapter_id"])
    row = lambda *r: spark.createDataFrame(list(r), "job_id int, chapter_id int, v string")
    group = lambda *r: spark.createDataFrame(list(r), "job_id int, chapter_id int")
    t.replace(row((1, 1, "a"), (1, 2, "b")), group((1, 1), (1, 2)), 0)
    t.replace(row((1, 2, "c")), group((1, 2), (1, 3)), 1)
    t.replace(row((1, 2, "c")), group((1, 2), (1, 3)), 1)  # a retried write changes nothing
    assert sorted((r.chapter_id, r.v) for r in t.current(spark).collect()) == [(1, "a"), (2, "c")]
    assert sorted((r.chapter_id, r.v) for r in t.current(spark, upto=0).collect()) == [(1, "a"), (2, "b")]
    t.replace(row().limit(0), group((1, 1)), 2)
    assert [(r.chapter_id, r.v) for r in t.current(spark).collect()] == [(2, "c")]


CHAPTERS = [(7, 1, 1, "Lao To met Han Lap. Han Lap is tall. Lao To, the uncle of Han Lap, left."), (7, 2, 2, "Han Lap went on. The Old Sage waved.")]
ANSWERS = {
    1: '{"schema_version":"story_chapter_cloud_extraction.v2","chapter_num":1,"characters":[{"display_name":"Lao To","entity_nature":"person","confidence":0.9,"evidence_quotes":["Lao To met"]},'
       '{"display_name":"Han Lap","entity_nature":"person","confidence":0.9,"aliases":["Young Han Ma"],"fields":[{"field_key":"appearance","value":"tall","semantic_class":"physical_appearance","evidence_quotes":["Han Lap is tall"]}]}],'
       '"relationships":[{"source_name":"Lao To","target_name":"Han Lap","relationship_scope":"kinship","relationship_type":"uncle","source_to_target_label":"uncle","target_to_source_label":"nephew","confidence":0.8,"evidence_quotes":["the uncle of Han Lap"]}]}',
    2: 'Sure: {"schema_version":"story_chapter_cloud_extraction.v2","chapter_num":2,"characters":[{"display_name":"Han Lap","entity_nature":"person","confidence":0.9},{"display_name":"Old Sage","entity_nature":"role_title","confidence":0.9}]} ok',
}


def test_extraction_stream_equals_rebuild(spark, tmp_path):
    chapters = spark.createDataFrame(CHAPTERS, "job_id int, chapter_id long, chapter_num long, content string")
    schema = "chapter_id long, json_text string"
    source, base = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, '{"schema_version":"story_chapter_cloud_extraction.v2","chapter_num":1,"characters":[{"display_name":"Wrong One","confidence":0.9}]}'), (2, ANSWERS[2]), (1, ANSWERS[1])]
    for r in rows:  # one answer per micro-batch; chapter 1 is answered twice
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(source)
        s = spark.readStream.schema(schema).parquet(source)
        N.run_batches(s, f"{base}/cp", N.extraction_step(chapters, f"{base}/t")).awaitTermination()
    records, values, aliases = N.extraction_tables(f"{base}/t")
    docs, _ = C.read_model_outputs(spark.createDataFrame(list(ANSWERS.items()), schema))
    rec, val = N.extract_tables(docs, chapters)
    key = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert key(records.current(spark)) == key(rec)
    assert key(values.current(spark)) == key(val)
    names = {(r.entity_key, r.alias_text): r.first_chapter_num for r in aliases.current(spark).collect()}
    assert names == {("lao_to", "Lao To"): 1, ("han_lap", "Han Lap"): 1, ("han_lap", "Young Han Ma"): 1}
    quotes = [(r.content, e) for r in val.join(chapters.select("chapter_id", "content"), "chapter_id").collect() for e in r.evidence]
    assert quotes and all(c[e.start_char:e.end_char] == e.quote for c, e in quotes)


def test_job_stream_over_batches(spark, tmp_path):
    steps = [[(1, 1, "running"), (1, 2, "paused"), (2, 1, "completed")], [(1, 2, "paused"), (1, 3, "running"), (2, 2, "running")], [(1, 1, "cancelled"), (1, 4, "completed")]]
    source, base = str(tmp_path / "in"), str(tmp_path / "s")
    schema = "job_id int, sequence long, status string"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        N.append_to(N.job_steps(spark.readStream.schema(schema).parquet(source)), f"{base}/out", f"{base}/cp").awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    assert {r.job_id: (r.status, r.last_sequence) for r in N.job_state(out).collect()} == {1: ("completed", 4), 2: ("running", 2)}
    assert [(r.job_id, r.sequence, r.from_status, r.to_status) for r in out.filter("NOT applied").collect()] == [(2, 1, "pending", "completed")]


def test_progress_stream_counts_the_latest_run(spark, tmp_path):
    source, base = str(tmp_path / "in"), str(tmp_path / "p")
    schema = "job_id int, chapter_id int, sequence long, status string"
    log = N.LogTable(f"{base}/r", ["job_id", "chapter_id"])
    for rows in ([(1, 1, 1, "running"), (1, 2, 2, "running")], [(1, 1, 3, "completed"), (1, 3, 4, "failed")], [(1, 1, 2, "running"), (1, 2, 5, "completed")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        runs = N.latest_chapter_runs(spark.readStream.schema(schema).parquet(source))
        N.run_batches(runs, f"{base}/cp", N.progress_step(log), mode="update").awaitTermination()
    r = N.progress(log.latest(spark)).first()
    assert (r.pending, r.running, r.completed, r.failed) == (0, 0, 2, 1)


def test_read_faults_of_a_table_are_not_hidden(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    log = N.LogTable(str(tmp_path / "log"), ["k"])
    assert log.rows(spark) is None
    (tmp_path / "log" / "batch_id=0").mkdir(parents=True)
    (tmp_path / "log" / "batch_id=0" / "part-0.parquet").write_text("broken")
    with pytest.raises(Exception) as seen:
        log.rows(spark).collect()
    assert not isinstance(seen.value, AnalysisException) or seen.value.getCondition() != "PATH_NOT_FOUND"


def test_feed_keeps_subscribed_projects(spark):
    e = spark.createDataFrame([(i % 2, "t", i) for i in range(10)], "project_id int, event_type string, sequence long")
    subs = spark.createDataFrame([(0,)], "project_id int")
    assert sorted(r.sequence for r in N.project_feed(e, subs).collect()) == [0, 2, 4, 6, 8]


def test_registry_is_complete():
    from loreweave.plans import load_all
    from loreweave.plans.registry import ORACLES, QUERIES

    load_all()
    q, o = QUERIES, ORACLES
    assert set(o) <= set(q) and len(q) > 150
    without = {n for n in q if n not in o}
    assert without == {"e20_resolve_over_chapters"}
