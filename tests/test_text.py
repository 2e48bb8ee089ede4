"""Segmentation, keys and matching: literal cases and brute-force twins."""
import random
import re

from pyspark.sql import functions as F

from loreweave.functions import keys as K
from loreweave.functions.textfns import is_json, prefix_starts, scan_spans, sentence_window
from loreweave.operators import mentions as M
from loreweave.operators import segment as S


def chapters_of(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "novel_id long, text string")
    return [tuple(r) for r in S.split_chapters(df, **kw).orderBy("chapter_num").collect()]


def test_chapter_headings(spark):
    got = chapters_of(spark, "Mưa rơi cả đêm\n\nChương 7\nBến đò vắng.\n\nChương 8\nGió lên.")
    assert [(r[1], r[2]) for r in got] == [(1, "Preface"), (2, "Chương 7"), (3, "Chương 8")]
    assert [r[2] for r in chapters_of(spark, "Chapter 4\nThe mill burns.\n\nChapter 5\nAsh.\n\nChapter 6\nSnow.")] == ["Chapter 4", "Chapter 5", "Chapter 6"]
    assert [r[2] for r in chapters_of(spark, "第9章 渡口\n雨。\n\n第10章 磨坊\n雪。")] == ["第9章 渡口", "第10章 磨坊"]
    assert [r[2] for r in chapters_of(spark, "# The Ferry\nRain.\n\n### The Mill\nAsh.")] == ["The Ferry", "The Mill"]
    assert [r[2] for r in chapters_of(spark, "Only rain, and no heading at all.")] == ["Chapter 1"]
    assert chapters_of(spark, " \n\t") == []


def test_heading_limits(spark):
    long_title = "Chapter " + "x" * 88  # 96 characters
    assert len(chapters_of(spark, f"intro\n{long_title}\nbody")) == 2
    assert len(chapters_of(spark, f"intro\n{long_title}x\nbody")) == 1
    assert [r[2] for r in chapters_of(spark, "PROLOGUE\na\n  Epilogue \nb\nchapters are fun\nchap. x\nc")] == ["PROLOGUE", "Epilogue", "chap. x"]
    # a blank start before the first heading is no preface and keeps number 1 for the heading
    assert [(r[1], r[2], r[3]) for r in chapters_of(spark, "\n \nChapter 1\nx")] == [(1, "Chapter 1", 3)]
    assert [r[3] for r in chapters_of(spark, "\n \nChapter 1\nx", trim_first=True)] == [0]


def test_chapter_text_is_covered(spark):
    text = "a😀b\r\nChapter 1\r\nx\n# T\ny\n\n"
    got = chapters_of(spark, text)
    assert "".join(r[5] for r in got) == text
    assert all(text[r[3]:r[4]] == r[5] for r in got)


def test_segments(spark):
    df = spark.createDataFrame([(1, "Bến đò\nMưa rơi.\n\nGió lên."), (2, "  \na\nb\n \t\n\n c"), (3, " \n")], "chapter_id long, content string")
    got = [tuple(r) for r in S.split_segments(df).orderBy("chapter_id", "segment_index").collect()]
    assert got == [(1, 1, 0, 16, "Bến đò\nMưa rơi.\n"), (1, 2, 17, 25, "Gió lên."), (2, 1, 3, 7, "a\nb\n"), (2, 2, 11, 13, " c")]


def chunk_twin(text, target, minimum):
    out, start = [], 0
    while start < len(text):
        if len(text) - start <= target:
            end = len(text)
        else:
            span = range(start + target - 1, start + minimum - 1, -1)
            end = next((i + 2 for i in span if text[i:i + 2] == "\n\n"), None) or next((i + 1 for i in span if text[i] == "\n"), None) \
                or next((i + 1 for i in span if text[i] in ".!?。！？"), None) or start + target
        if text[start:end].strip():
            out.append((start, end, text[start:end]))
        start = end
    return out or [(0, len(text), text)]


def test_chunks_equal_twin(spark):
    rng = random.Random(5)
    texts = ["", "   ", "abc", "x" * 100] + ["".join(rng.choice("ab .\n\n!。é") for _ in range(rng.randint(1, 400))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "chapter_id long, content string")
    got = {}
    for r in S.chunk_chapters(df, target=40, minimum=15).orderBy("chapter_id", "chunk_index").collect():
        got.setdefault(r.chapter_id, []).append((r.start_char, r.end_char, r.text))
    assert got == {i: chunk_twin(t, 40, 15) for i, t in enumerate(texts)}


def test_language(spark):
    rows = ["カタカナひらがな", "가나다라마바사아", "的" * 16, "đ" * 8, "a" * 32, "a" * 31, "的" * 16 + "a" * 16]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    got = [r.lang for r in df.select("i", S.detect_language(F.col("t")).alias("lang")).orderBy("i").collect()]
    assert got == ["ja", "ko", "zh", "vi", "en", None, None]


def test_prefix_starts(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        df = spark.createDataFrame([(list(range(n)),)], "a array<bigint>")
        want = [sum(range(i)) for i in range(n)]
        assert df.select(prefix_starts(F.col("a"))).first()[0] == want


def test_keys(spark):
    cases = [
        ("  Đường Tam ", "đường_tam", "duong_tam", "duong_tam"), ("Señor Ñu", "señor_ñu", "señor_ñu", "se_or_u"), ("第一章", "第一章", "第一章", "field"),
        ("9 lives", "9_lives", "9_lives", "field_9_lives"), ("already_ok", "already_ok", "already_ok", "already_ok"), ("--", "", "", "field"), ("a__b", "a_b", "a_b", "a_b"),
    ]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    t = F.col("t")
    got = [tuple(r) for r in df.select(t, K.text_key(t), K.folded_key(t), K.ascii_key(t)).collect()]
    assert got == cases
    assert df.select(K.ascii_key(t, "unicode")).collect()[2][0] == "第一章"


def test_clean_surface(spark):
    cases = {" “Lão  Tổ” này ": "Lão Tổ", "vị vị khách lạ": "khách lạ", "vị khách": "vị khách", "'a' đó này": "a", "'a' này đó": "a' này", "`x` kia": "x", "đó": "đó"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r[0]: r[1] for r in df.select("t", K.clean_surface(F.col("t"))).collect()} == cases


def word(c):
    return c == "_" or c.isalnum()


def scan_twin(text, v):
    out, i = [], text.find(v)
    while i >= 0:
        e = i + len(v)
        if not (i and word(text[i - 1])) and not (e < len(text) and word(text[e])):
            out.append((i, e))
        i = text.find(v, e)
    return out


def test_scan_equals_twin(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        alphabet = "ab_ .é😀-"
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        v = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
        rows.append((i, t, v))
    rows.append((600, r"x \E a\E b", r"a\E b"))
    df = spark.createDataFrame(rows, "i int, t string, v string")
    got = {r.i: [(x.start, x.end) for x in r.h] for r in df.select("i", scan_spans(F.col("t"), F.col("v")).alias("h")).collect()}
    assert got == {i: scan_twin(t, v) for i, t, v in rows}


def test_scope_matching_equals_direct(spark):
    """Blocking by the longest word run finds what scanning every text for every surface finds."""
    rng = random.Random(2)
    words = ["Ann", "ann", "Anna", "Lee", "-x", "van", "Ann-Lee", "của"]
    texts = [(i, i % 3, " ".join(rng.choice(words) + rng.choice(["", ",", "!"]) for _ in range(12))) for i in range(60)]
    surfaces = [(n, s) for n in range(3) for s in ("Ann", "Ann Lee", "-x", "Lee, van", "ann-Lee", "Của Anna")]
    td = spark.createDataFrame(texts, "text_id int, novel_id int, text string")
    sd = spark.createDataFrame(surfaces, "novel_id int, surface string")
    got = sorted((r.text_id, r.surface, r.start_char, r.end_char) for r in M.find_occurrences(td, sd, ["novel_id"]).collect())
    want = []
    for i, n, t in texts:
        for m, s in surfaces:
            if m == n:
                for v in {s, s[0].lower() + s[1:], s[0].upper() + s[1:]}:
                    want += [(i, s, a, b) for a, b in scan_twin(t, v)]
    assert got == sorted(want)


def test_runs_and_pairs_equal_twin(spark):
    """Names of up to four runs, with edges, that overlap themselves, and without any run, in both scopes."""
    rng = random.Random(9)
    texts = [(i, i % 4, "".join(rng.choice(["a", "b", "ab", " ", " ", ", ", "-", ".", "é😀", "\n"]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    surfaces = sorted({(n, "".join(rng.choice(["a", "b", "ab", " ", "-", "."]) for _ in range(rng.randint(1, 7)))) for n in range(4) for _ in range(60)})
    td = spark.createDataFrame(texts, "text_id int, novel_id int, text string")
    want = []
    for i, n, t in texts:
        for m, s in surfaces:
            if m == n:
                for v in {s, s[0].lower() + s[1:], s[0].upper() + s[1:]}:
                    want += [(i, s, a, b) for a, b in scan_twin(t, v)]
    by_novel = M.find_occurrences(td, spark.createDataFrame(surfaces + surfaces[:5], "novel_id int, surface string"), ["novel_id"])
    assert sorted((r.text_id, r.surface, r.start_char, r.end_char) for r in by_novel.collect()) == sorted(want)
    own = spark.createDataFrame([(i, s) for i, n, _ in texts for m, s in surfaces if m == n], "text_id int, surface string")
    by_text = M.find_occurrences(td, own, ["text_id"])
    assert sorted((r.text_id, r.surface, r.start_char, r.end_char) for r in by_text.collect()) == sorted(want) and len(want) > 500


def test_first_letter_and_borders(spark):
    td = spark.createDataFrame([(1, "😀 anna Anna Annabel xAnna Anna_ Anna")], "text_id int, text string")
    sd = spark.createDataFrame([(1, "Anna")], "text_id int, surface string")
    got = sorted(r.start_char for r in M.find_occurrences(td, sd, ["text_id"]).collect())
    assert got == [2, 7, 32]


def test_non_overlapping_equals_twin(spark):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        for _ in range(rng.randint(1, 12)):
            s = rng.randint(0, 30)
            rows.append((g, s, s + rng.randint(1, 8)))
    rows = sorted(set(rows))
    df = spark.createDataFrame([(g, s, e, f"t{s}-{e}") for g, s, e in rows], "g int, start_char long, end_char long, text string")
    got = sorted((r.g, r.start_char, r.end_char) for r in M.select_non_overlapping(df, ["g"]).collect())
    want = []
    for g in {r[0] for r in rows}:
        kept = []
        for s, e in sorted(((s, e) for gg, s, e in rows if gg == g), key=lambda x: (x[0] - x[1], x[0])):
            if all(not (a < e and s < b) for a, b in kept):
                kept.append((s, e))
        want += [(g, s, e) for s, e in kept]
    assert got == sorted(want)


def test_sentence_window(spark):
    t = "One. Two x here! Three"
    df = spark.createDataFrame([(t, 9, 10), (t, 0, 3), (t, 17, 22)], "t string, s int, e int")
    got = [tuple(r[0]) for r in df.select(sentence_window(F.col("t"), F.col("s"), F.col("e"))).collect()]
    assert got == [(4, 16, " Two x here!"), (0, 4, "One."), (16, 22, " Three")]


def test_samples_take_first_middle_last(spark):
    df = spark.createDataFrame([(1, "k", i, i + 1, "x") for i in range(6)], "c int, group_key string, start_char int, end_char int, text string")
    assert sorted(r.start_char for r in M.sample_for_confirmation(df, ["c"], k=3).collect()) == [0, 2, 5]
    assert M.sample_for_confirmation(df, ["c"]).count() == 6


def test_quoted_spans_pair_greedily(spark):
    df = spark.createDataFrame([(1, "a \"Lão Tổ\" b 'bad: one' \"x\" c \"open")], "text_id int, text string")
    assert [(r.start_char, r.end_char, r.text) for r in M.quoted_spans(df).collect()] == [(2, 10, "Lão Tổ")]


def test_is_json_refuses_what_follows(spark):
    df = spark.createDataFrame([('{"a":1}',), ('{"a":1}}',), ('{"a":1},{"b":2}',), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(is_json(F.col("t"))).collect()] == [True, False, False, False, False, False]


def test_segment_mentions_match_text(spark):
    """Stored offsets always cut out the mention text."""
    td = spark.createDataFrame([(1, "Ông Lão Tổ và Lão Tổ.")], "chapter_id int, content string")
    ids = spark.createDataFrame([(1, "i", "Lão Tổ", ["Ông Lão Tổ"])], "chapter_id int, identity_id string, name string, aliases array<string>")
    rows = M.scan_identity_mentions(td, ids).collect()
    text = "Ông Lão Tổ và Lão Tổ."
    assert sorted((r.start_char, r.text) for r in rows) == [(0, "Ông Lão Tổ"), (14, "Lão Tổ")]
    assert all(text[r.start_char:r.end_char] == r.text for r in rows)
    assert re.match("Ông", text)


def shuffled_rows(df):
    """Rows that all shuffles of a query wrote."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if node.metrics().contains("shuffleRecordsWritten"):
                total += node.metrics().apply("shuffleRecordsWritten").value()
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return total


def test_search_shuffles_texts_and_not_their_runs(spark):
    """Surfaces of a text: no row per word. Of a wider scope: a row per distinct run at most, however often it occurs, and
    names with a common first word do not multiply what a text is compared with."""
    names = [f"Anna w{i}" for i in range(40)]
    text = " ".join(["Anna", "w7", "and"] * 500)
    td = spark.createDataFrame([(1, 1, text)], "text_id int, novel_id int, text string")
    sd = spark.createDataFrame([(1, n) for n in names], "text_id int, surface string")
    by_text = M.find_occurrences(td, sd, ["text_id"])
    assert by_text.count() == 500 and shuffled_rows(by_text) < 100
    by_novel = M.find_occurrences(td, sd.withColumnRenamed("text_id", "novel_id"), ["novel_id"])
    assert by_novel.count() == 500 and shuffled_rows(by_novel) < 1000


def test_parts_of_a_text_share_its_surfaces(spark):
    td = spark.createDataFrame([(1, "a", "Anna came. Anna"), (1, "b", "no one"), (1, "c", None), (2, "a", "Lee, anna")], "chunk int, part string, text string")
    sd = spark.createDataFrame([(1, "Anna"), (2, "Lee"), (2, "...")], "chunk int, surface string")
    got = sorted((r.chunk, r.part, r.surface, r.start_char) for r in M.find_occurrences(td, sd, ["chunk"], text_id="part", per_text=True).collect())
    assert got == [(1, "a", "Anna", 0), (1, "a", "Anna", 11), (2, "a", "Lee", 0)]


def test_entities_with_one_surface_meet_what_is_found_once(spark):
    td = spark.createDataFrame([(1, "n", 5, "Anna and Lee. Anna")], "chapter_id int, novel_id string, chapter_num int, text string")
    rows = [("n", "anna", "Anna", 1), ("n", "anna", "Lee", 9), ("n", "lee", "Lee", 7), ("n", "ann", "Anna", 2), ("n", "ann", "Anna", 8)]
    ad = spark.createDataFrame(rows, "novel_id string, entity_key string, surface string, first_chapter_num int")
    assert sorted(r.entity_key for r in M.known_identities_in_text(td, ad).collect()) == ["ann", "anna", "lee"]
    assert sorted(r.entity_key for r in M.known_identities_in_text(td, ad, prior_only=True).collect()) == ["ann", "anna"]
