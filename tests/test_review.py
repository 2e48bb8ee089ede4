"""Literal rows for results that were once wrong."""
from loreweave.operators import mentions as M
from loreweave.operators import modeltext as L
from loreweave.operators import reader as R
from loreweave.operators.segment import detect_language
from pyspark.sql import functions as F


def test_equal_text_ids_of_two_novels_do_not_mix(spark):
    texts = spark.createDataFrame([(1, 1, "Nothing here"), (2, 1, "Anna came")], "novel_id int, text_id int, text string")
    surfaces = spark.createDataFrame([(1, "Anna"), (2, "Anna")], "novel_id int, surface string")
    got = M.find_occurrences(texts, surfaces, ["novel_id"]).collect()
    assert [(r.novel_id, r.text_id, r.text) for r in got] == [(2, 1, "Anna")]


def test_text_after_a_json_value_is_never_read_over(spark):
    good = ['{"a":1}', ' {"a":1}\n', '{"a":"x\ny"}', "{}", '{"a":1,"end":5}']
    bad = ['{"a":1}] x {"b":2}', '{"a":1} x', '{"a":1}},{"b":1}', '{"a":1', "", '{"a":1},"end":3', '{"a":1}{"b":2}', None, "1,2"]
    df = spark.createDataFrame([(x,) for x in good + bad], "t string")
    done, failed = L.parse_tolerant_json(df, "t", "struct<a:string>")
    assert sorted(r.t for r in done.collect()) == sorted(good)
    assert {r.t for r in failed.collect()} == set(bad)


def test_first_of_equally_specific_labels_stays(spark):
    rec = spark.createDataFrame([("n", 1, "han", "Han", "a"), ("n", 1, "mai", "Mai", "b")], "novel_id string, chapter_num long, entity_key string, display_name string, record_id string")
    rel = spark.createDataFrame([("n", "r1", 1, "relationship|han|mai", "Han ↔ Mai"), ("n", "r2", 1, "relationship|han|mai", "Han ↔ Mai")], "novel_id string, record_id string, chapter_num long, entity_key string, display_name string")
    ev = "evidence array<struct<chapter_num:bigint,start_char:bigint,end_char:bigint,quote:string,reason:string>>"
    rows = [("r1", 0, "aunt", "relationship", None), ("r2", 0, "boss", "relationship", None), ("r2", 1, "boss of the works", "habit", None)]
    val = spark.createDataFrame([(r, p, v, "Mai", k, lab, []) for r, p, v, k, lab in rows], "record_id string, pos int, value string, related string, field_key string, relationship_label string, " + ev)
    labels = {r.entity_key: r.label for r in R.relationship_summaries(rec, rel, val).collect()}
    assert labels["han"] == "aunt"
    named = val.withColumn("relationship_label", F.when(F.col("record_id") == "r2", F.lit("old friend")))
    assert {r.entity_key: r.label for r in R.relationship_summaries(rec, rel, named).collect()}["han"] == "old friend"


def test_auto_language_of_a_novel_is_guessed(spark):
    novels = spark.createDataFrame([(1, "auto"), (2, " "), (3, "fr"), (4, None)], "novel_id int, source_language string").selectExpr(
        "novel_id", "'t' title", "'a' author", "'g' genre", "'d' description", "source_language")
    said = spark.createDataFrame([(i, "plain letters of a text in English words " * 3) for i in (1, 2, 3, 4)], "novel_id int, sample string").selectExpr(
        "novel_id", *[f"cast(null as string) {c}" for c in ("title", "author", "genre", "description")], "'auto' source_language", "sample")
    assert {r.novel_id: r.source_language for r in L.fill_metadata(novels, said).collect()} == {1: "en", 2: "en", 3: "fr", 4: "en"}


def test_language_reads_the_whole_text(spark):
    text = "word " * 3000 + "かな" * 10
    got = spark.createDataFrame([(text,)], "t string").select(detect_language(F.col("t")).alias("whole"), detect_language(F.col("t"), 12000).alias("head")).first()
    assert (got.whole, got["head"]) == ("ja", "en")


def test_record_to_show_changes_only_in_its_chapters(spark):
    rows = [("n", "han", "Han", c, f"r{c}") for c in (2, 5, 6, 9)]
    rec = spark.createDataFrame(rows, "novel_id string, entity_key string, display_name string, chapter_num long, record_id string")
    changes = R.identity_records(rec)
    shown = {c: [r.record_id for r in R.identity_records_at(changes, c).collect()] for c in range(1, 12)}
    assert shown[1] == [] and all(shown[c] == [f"r{c}" if c in (5, 6, 9) else "r2"] for c in range(2, 12))
    assert {r.record_id for r in R.visible_as_of(rec, 5).collect()} == {"r2", "r5"}


def test_highlight_takes_the_first_listed_alias_known_by_then(spark):
    """Also where very many entities share a surface: an occurrence then meets the few that can win."""
    chapters = spark.createDataFrame([(c, "n", c, "then Annas came") for c in (1, 5, 9)], "chapter_id long, novel_id string, chapter_num long, content string")
    rows = [("n", f"e{i}", "Annas", "alias", i % 7 + 3, 1000 - i) for i in range(300)] + [("n", "early", "Annas", "alias", 2, 9000), ("n", "unknown", "Annas", "alias", None, 0)]
    aliases = spark.createDataFrame(rows, "novel_id string, entity_key string, alias_text string, alias_type string, first_chapter_num long, ord long")
    records = spark.createDataFrame([], "novel_id string, chapter_id long, chapter_num long, record_id string, entity_key string, display_name string")
    mentions = spark.createDataFrame([], "record_id string, text string, start_char long, end_char long, mention_type string")
    got = {r.chapter_id: r.record_key for r in R.highlight_mentions(records, mentions, aliases, chapters).collect()}

    def best(chapter):
        return min((str(o), e) for _, e, _, _, first, o in rows if first is not None and first <= chapter)[1]

    assert got == {c: f"alias:entity:{best(c)}" for c in (5, 9)}
