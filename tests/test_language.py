"""Functions and operators on titles, answers, templates, mentions and similar names: hand-written cases and brute force."""

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.operators import dedup, similarity, textops


def one(spark, value, function):
    return spark.createDataFrame([(value,)], "v string").select(function(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "left"),
    [("a {{b {{c {{d}} e}} f}} g", "a  g"), ("{{x}}y{{z}}", "y"), ("a {{b", "a {{b"), ("a }} b", "a }} b"), ("{{a {{b}} c", "{{a  c"), ("", ""), ("{{a}} {{b {{c}} d", " {{b  d"), ("{{" * 3000 + "x" + "}}" * 3000 + "y", "y")],
)
def test_templates_of_any_depth(text, left):
    assert X.strip_templates(text) == left


def test_pages(spark):
    page = "<!-- n -->{{Infobox|a={{b|{{c}}}}}}'''Tên''' là [[đội|một đội]].<ref>x</ref>\n== Đầu ==\n* [https://a.b trang] &amp; [[File:x.png|thumb|y [[z]]]]\n{|\n|t\n|}[[Category:C]]"
    assert one(spark, page, X.article_text) == "Tên là một đội. Đầu trang &"
    assert one(spark, None, X.article_text) is None and one(spark, "", X.clean_wikitext) == ""


@pytest.mark.parametrize(("text", "year", "years"), [("Giải 2004–05", 2004, "2004-2005"), ("V 2019-2020", 2019, "2019-2020"), ("Cúp 1998", 1998, "1998"), ("không", None, None), ("", None, None), (None, None, None)])
def test_seasons(spark, text, year, years):
    r = one(spark, text, X.season)
    assert (r.year, r.years) == (year, years)


def test_answers(spark):
    rows = [("Có.", "yes", True), ("Không đúng!", "false", True), ("Không", "no", True), ("Đúng", "yes", False), ("CLB Roán Chin", "Roán Chin", True), ("", "", True), (None, "yes", False), ("sai rồi", "false", True), ("không", "có", False)]
    df = spark.createDataFrame(rows, "a string, b string, ok boolean")
    assert df.filter(X.answers_match(F.col("a"), F.col("b")) != F.col("ok")).count() == 0
    assert one(spark, "<|im_start|>A đi. A đi. B.</s>", X.without_special_tokens) == "A đi. B."


def test_titles_and_maps(spark):
    assert one(spark, "o'brien x-y nguyễn văn", X.title_case) == "O'Brien X-Y Nguyễn Văn"
    pairs = [("hậu vệ", "DF"), ("hậu vệ trái", "LB")]
    read = lambda v: one(spark, v, lambda c: X.mapped(c, pairs, F.upper(F.left(c, F.lit(3)))))
    assert [read(v) for v in ("Hậu vệ trái", "là hậu vệ trái", "xyz1", " ", None)] == ["LB", "DF", "XYZ", None, None]
    assert one(spark, "Tam Kỳ, Đà Nẵng", lambda c: X.corrected(c, [("Tam Kỳ", "Đà Nẵng", "Quảng Nam")])) == "Tam Kỳ, Quảng Nam"
    assert one(spark, "fc Roán clb Chin", lambda c: X.without_affixes(c, ["fc", "clb"])) == "roán chin"
    assert one(spark, "là Roán", lambda c: X.masked_ngrams(F.split(c, " "), 2, ["là"])) == ["là Roán", "Roán"]


def test_long_sentences_are_split(spark):
    long = ", ".join(f"Mệnh đề số {i} của câu dài" for i in range(40))
    df = spark.createDataFrame([(1, f"Ông ở TP. Mọc Miền hôm nay. {long}. Ngắn. Câu cuối cùng đây! và tiếp", 0), (2, None, 0), (3, "", 0), (4, "x" * 600, 0)], "id int, t string, sentence int")
    got = [(r.id, r.sentence_idx, r.sentence) for r in textops.sentences(df, "id", "t").orderBy("id", "sentence_idx").collect()]
    assert got[0] == (1, 0, "Ông ở TP. Mọc Miền hôm nay.") and len(got) == 42 and got[-1][2] == "Câu cuối cùng đây! và tiếp"
    assert [g[1] for g in got] == list(range(42)) and textops.sentences(df.limit(0), "id", "t").count() == 0


def test_long_names_are_found(spark):
    name = "Câu lạc bộ bóng đá của những người rất yêu thành phố Roán Chin"
    names = spark.createDataFrame([(7, name), (8, "Roán"), (9, "Roán"), (10, None)], "id long, name string")
    df = spark.createDataFrame([(1, f"hôm nay ({name.upper()}) đá, Roán."), (2, None), (3, "")], "k int, t string")
    assert {tuple(r) for r in textops.dictionary_mentions(df, "k", "t", names, "name", "id").collect()} == {(1, 7), (1, 8)}
    spans = textops.dictionary_spans(df, "k", "t", names, "name", ["id"]).collect()
    text = df.first().t
    assert {text[r.start_pos : r.end_pos].lower() for r in spans} == {name.lower(), "roán"} and len(spans) == 5
    from pitchlake.operators import lookup

    ref = spark.createDataFrame([(1, "một hai ba bốn năm sáu bảy tám chín mười")], "id long, n string")
    asked = spark.createDataFrame([("x một hai ba bốn năm sáu bảy tám chín mười y",), ("hai ba bốn năm sáu bảy tám chín mười",), ("hai chín",)], "a string")
    assert {tuple(r) for r in lookup.contained_lookup(asked, "a", "a", ref, "n", "id").collect()} == {(asked.collect()[0].a, 1), (asked.collect()[1].a, 1)}


def test_recognised(spark):
    df = spark.createDataFrame([(1, 0, 10, "A", 5, 1), (1, 5, 12, "B", 6, 0), (1, 5, 12, "C", 7, 0), (1, 20, 25, "A", 8, 1), (2, 0, 3, "A", None, 1)], "k int, start_pos int, end_pos int, kind string, wiki_id long, priority int")
    assert {tuple(r) for r in textops.recognised(df, "k", ["kind", "wiki_id"]).collect()} == {(1, 5, 12, "B", 6), (1, 20, 25, "A", 8), (2, 0, 3, "A", None)}


def test_every_match_counts(spark):
    df = spark.createDataFrame([(1, "Roán Chin thắng Voan Vừ. Lẻo Phịch thắng Điệu Vai, Tọt Tẻo thua Chịa Toa."), (2, None), (3, "")], "k int, c string")
    rules = [("thắng", "DEFEATED", False, 0.9), ("thua", "DEFEATED", True, 0.8)]
    name = "[A-ZĐ][^ .,]*(?: [A-ZĐ][^ .,]*)*"
    got = {(r.subject, r.object, r.swapped) for r in textops.pattern_relations(df, "k", "c", rules, name).collect()}
    assert got == {("Roán Chin", "Voan Vừ", False), ("Lẻo Phịch", "Điệu Vai", False), ("Chịa Toa", "Tọt Tẻo", True)}


def test_words_present(spark):
    df = spark.createDataFrame([("Cùng Quê",), ("quê",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(textops.words_present(F.col("t"), ("quê", "cùng quê"))).collect()] == [3, 1, 0, None]


def test_best_match_is_brute_force(spark):
    refs = [(i, f"Đội {a} {b} FC") for i, (a, b) in enumerate((x, y) for x in ("Roán", "Voan", "Lẻo", "Điệu", "Tọt") for y in ("Chin", "Vừ", "Phịch", "Vai", "Tẻo"))]
    asked = ["Đội Roán Chin FC", "đội roán chinn fc", "Đội Voan Vừư FC", "Khác Hẳn", "FC", " ", None, "Roán Chin"]
    ref = spark.createDataFrame(refs, "id long, n string")
    got = {r.a: (r.id, r.n, round(r.score, 6)) for r in similarity.best_match(spark.createDataFrame([(a,) for a in asked], "a string"), "a", ref, "n", "id", 0.85).collect()}
    want = {}
    for a in filter(None, asked):
        words = set(a.lower().split()) - {"fc", "đội"}  # common words begin no comparison
        scores = [(-X.token_set_ratio(a, n), n, i) for i, n in refs if words & set(n.lower().split())]
        if scores and -min(scores)[0] >= 0.85:
            s, n, i = min(scores)
            want[a] = (i, n, round(-s, 6))
    assert got == want and len(got) == 4


def test_surrogate_ids(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, "x") for i in range(1000)], "v int, w string").repartition(7)
    assert {(r.v, r.no) for r in dedup.with_surrogate_ids(df, ["v"], "no").collect()} == {(i, i + 1) for i in range(1000)}
    assert dedup.with_surrogate_ids(df.limit(0), ["v"], "no").count() == 0


def test_canonical_names(spark):
    df = spark.createDataFrame([(1, "A", 1990), (2, "A", None), (3, "B", None), (4, None, 1990)], "i long, n string, y int")
    assert {(r.i, r.c) for r in dedup.canonical_names(df, "n", "y", "i", "c").collect()} == {(1, "A (1990)"), (2, "A (#2)"), (3, "B"), (4, None)}


def test_intermediates_go(spark):
    import os

    from pitchlake.session import materialize, release, shared_dir

    df = materialize(spark.range(3), "x")
    path = df._written.replace("file:", "")
    assert os.path.isdir(path) and df.count() == 3 and df._written.startswith(shared_dir(spark))
    release(df)
    release(df.filter("id > 0"))
    assert not os.path.isdir(path)


def test_model_spans(spark):
    def load():
        import re

        return lambda t: [(m.start(), m.end(), "PER" if m.group()[0] == "R" else "MISC", 0.5) for m in re.finditer(r"[A-Z]\w+", t)]

    df = spark.createDataFrame([("gặp Roán và Voan",), ("",), (None,)], "t string")
    assert [[tuple(s) for s in r.s] for r in df.select(textops.model_spans(F.col("t"), load).alias("s")).collect()] == [[("Roán", "PLAYER", 4, 8, 0.5)], [], []]


def test_questions_in_words(spark):
    from pitchlake.plans.answers import answer

    facts = spark.createDataFrame([("played", "A B", "CLB C"), ("club_province", "A B", "D"), ("teammate", "A B", "E"), ("played", "A B", "CLB C")], "kind string, s string, o string")
    asked = [("A B có từng chơi cho CLB C không?", None, "yes"), ("A B từng chơi cho một đội ở D.", None, "true"), ("A B từng chơi cho một đội ở X.", None, "false"), ("Ai là đồng đội của A B?", ["E", "F"], "E"), ("A B quê ở đâu?", ["D", "X"], "?"), ("Z có từng chơi cho CLB C không?", None, "no"), ("chào", None, ""), ("", None, "")]
    q = spark.createDataFrame([(i, t, c, e) for i, (t, c, e) in enumerate(asked)], "no int, question string, choices array<string>, expected string")
    got = answer(q, facts).collect()
    assert {r.no for r in got} == set(range(6)) and all(r.given == r.expected for r in got)
    assert {r.intent for r in got} == {"played", "club_province", "teammate", "born"} and {r.confidence for r in got} == {0.95, 0.85}
    assert answer(q.limit(0), facts).count() == 0 and answer(q, facts.limit(0)).filter("given IN ('true', 'yes')").count() == 0


def test_unicode_and_cleaning(spark):
    assert one(spark, "Ðo\u0302\u0301ng “x”", lambda c: X.nfc(c, X.REPLACED)) == 'Đống "x"' and one(spark, None, X.nfc) is None
    assert one(spark, "Xem <b>tin</b> https://a.b/c ★ gửi a@b.vn ► ngay…  nhé!", X.clean_text) == "Xem tin gửi ngay nhé!"


def test_shared_folder():
    """Off local mode a folder has to be named."""
    from types import SimpleNamespace

    from pitchlake.session import shared_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(RuntimeError):
        shared_dir(cluster)
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "hdfs://x/y"), sparkContext=context)
    assert shared_dir(named) == "hdfs://x/y"
