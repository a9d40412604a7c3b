"""Expressions, lookups, joins, graph operators and text operators on small cases with known results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.operators import algorithms, dedup, graph, infobox, intervals, lookup, stats, textops


def one(spark, value, *columns):
    return spark.createDataFrame([(value,)], "x string").select(*columns).first()


@pytest.mark.parametrize(
    ("text", "expected"),
    [("2001–2005", (2001, 2005)), ("2001–05", (2001, 2005)), ("1998-01", (1998, 2001)), ("2010–nay", (2010, None)), ("2010–", (2010, None)), ("2010", (2010, 2010)), ("?", (None, None)), ("", (None, None)), (None, (None, None))],
)
def test_year_range(spark, text, expected):
    assert tuple(one(spark, text, X.year_range(F.col("x")).alias("r")).r) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("{{birth date|1990|5|7}}", "1990-05-07"), ("1990-05-07", "1990-05-07"), ("7/5/1990", "1990-05-07"), ("ngày 7 tháng 5 năm 1990", "1990-05-07"), ("7 May 1990", "1990-05-07"), ("khoảng 1990", "1990-01-01"), ("?", None), (None, None)],
)
def test_parse_date(spark, text, expected):
    assert one(spark, text, X.parse_date(F.col("x")).alias("d")).d == expected


def test_text_expressions(spark):
    r = one(
        spark, "[[Hà Nội (thành phố)|Hà Nội]] <b>A</b> (x)",
        X.clean_name(F.col("x")).alias("name"), X.clean_wikitext(F.lit("'''A''' {{t|{{u}}}}b<ref>c</ref> [[d|e]]")).alias("wiki"), X.clean_text(F.lit("a https://x.y/z b@c.d <i>e</i>")).alias("text"),
        X.height_m(F.lit("1,78 m")).alias("h1"), X.height_m(F.lit("178 cm")).alias("h2"), X.capacity(F.lit("khoảng 40.000 chỗ")).alias("seats"), X.digits_int(F.lit("12 (3)")).alias("digits"), X.digits_int(F.lit("")).alias("none"),
        X.field_name(F.lit(" Tên Đầy  Đủ "), {"tên_đầy_đủ": "full_name"}).alias("field"), X.split_two_scripts(F.lit("Kim Lee Nguyễn Văn A"), "Kim Lee").alias("two"), X.unique_sentences(F.lit("A. B. A.")).alias("once"),
        X.json_list(F.lit("no"), "int").alias("bad"), X.json_list(F.lit("[1,2]"), "int").alias("good"), X.word_overlap(F.lit("a b"), F.lit("b c d")).alias("overlap"), X.name_variants(F.lit("A B C")).alias("variants"), X.ngrams(F.split(F.lit("a b c"), " "), 2).alias("grams"),
    )
    assert (r.name, r.wiki, r.text) == ("Hà Nội A", "A b e", "a e")
    assert (r.h1, r.h2, r.seats, r.digits, r.none, r.field, r.two, r.once) == (1.78, 1.78, 40000, 123, None, "full_name", "Kim Lee (Nguyễn Văn A)", "A. B.")
    assert (r.bad, r.good, round(r.overlap, 6)) == ([], [1, 2], 0.166667)
    assert r.variants == ["A B C", "B C", "C"] and r.grams == ["a b", "b c", "a", "b", "c"]
    assert X.token_set_ratio("a b", "b a c") == 1.0 and X.token_set_ratio("", "a") == 0.0 and 0 < X.token_set_ratio("abc", "abd") < 1


def test_lookup(spark):
    ref = spark.createDataFrame([(1, "Hà Nội"), (2, "CLB Hà Nội B"), (3, "Reo"), (4, "reo"), (5, None)], "id long, name string")
    rows = spark.createDataFrame([("hà nội ",), ("FC Hà Nội",), ("Hà",), ("Reo",), ("Xa",), (None,)], "n string")
    got = {r.n: r.id for r in lookup.priority_lookup(rows, "n", "n", ref, "name", "id", F.lit(-1).cast("long")).collect()}
    assert got == {"hà nội ": 1, "FC Hà Nội": 1, "Hà": 1, "Reo": 3, "Xa": -1, None: -1}


def test_interval_joins_are_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.randint(1, 12), rnd.choice([1, 1, 1, 2, 3, None]), rnd.choice([None, 0, rnd.randint(1990, 2020)]), rnd.choice([None, 0, rnd.randint(2000, 2024)])) for i in range(120)]
    df = spark.createDataFrame(rows, "e long, p long, g long, a int, b int")
    want = {}
    for x, y in itertools.product(rows, rows):
        if x[1] < y[1] and x[2] is not None and x[2] == y[2]:
            s, t = max(x[3] or 1900, y[3] or 1900), min(x[4] or 2025, y[4] or 2025)
            if (x[3] or 1900) <= (y[4] or 2025) and (y[3] or 1900) <= (x[4] or 2025):
                k = (x[1], y[1], x[2])
                want[k] = min(want.get(k, (x[0], y[0], s, t)), (x[0], y[0], s, t))
    got = {(r.p1, r.p2, r.g): (r.from_year, r.to_year) for r in intervals.interval_self_join(df, "p", "g", "a", "b", "e").collect()}
    assert got == {k: v[2:] for k, v in want.items()}
    both = intervals.interval_join(df, "p", df.withColumnRenamed("p", "q"), "q", "g", "a", "b", "e", "e")
    assert {(r.p, r.q, r.g) for r in both.filter("p < q").collect()} == set(want)
    groups = {}
    for _, p, g, _, _ in rows:
        if g is not None:
            groups.setdefault(p, set()).add(g)
    pairs = {(p, q): len(groups[p] & groups[q]) for p in groups for q in groups if p < q and len(groups[p] & groups[q]) >= 2}
    assert {(r.p1, r.p2): r.shared for r in intervals.shared_groups(df, "p", "g").collect()} == pairs


def test_dedup(spark):
    df = spark.createDataFrame([("a", None, 2, "x"), ("a", None, 1, "y"), ("b", "1", 3, None), ("b", "2", 4, "z")], "n string, d string, id long, v string")
    assert sorted((r.n, r.id, r.v) for r in dedup.keep_first(df, ["n", "d"], ["id"]).collect()) == [("a", 1, "y"), ("b", 3, None), ("b", 4, "z")]
    names = dedup.canonical_names(df.withColumn("y", F.when(F.col("d").isNotNull(), F.lit(1990))), "n", "y", "id", "c").select("c")
    assert sorted(r.c for r in names.collect()) == ["a (#1)", "a (#2)", "b (1990)", "b (1990)"]
    assert dedup.keep_first(df.limit(0), ["n"], ["id"]).count() == 0


def links(spark, pairs):
    return spark.createDataFrame([(i, a, b, "R") for i, (a, b) in enumerate(pairs)], "eid long, src long, dst long, rel string")


TWO_TRIANGLES = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6)]


def test_algorithms_on_known_graphs(spark):
    e = links(spark, [*TWO_TRIANGLES, (2, 1), (7, 7), (8, 9)])
    c = {r.id: (r.degree, r.triangles, round(r.coefficient, 4)) for r in algorithms.clustering(e).collect()}
    assert c[1] == (2, 1, 1.0) and c[3] == (3, 1, 0.3333) and c[8] == (1, 0, 0.0) and 7 not in c
    assert {r.id: r.component for r in algorithms.components(e).collect()} == {**dict.fromkeys(range(1, 7), 1), 8: 8, 9: 8}
    star = {r.id: r.score for r in algorithms.pagerank(links(spark, [(0, i) for i in range(1, 6)]), 30).collect()}
    assert star[0] > 2 * star[1] and abs(sum(star.values()) - 6) < 1e-6
    chain = links(spark, [(i, i + 1) for i in range(40)])
    assert {r.component for r in algorithms.components(chain).collect()} == {0}
    assert algorithms.components(e.limit(0)).count() == 0


def test_communities(spark):
    got = {r.id: r.community for r in algorithms.louvain(links(spark, TWO_TRIANGLES)).collect()}
    assert got[1] == got[2] == got[3] and got[4] == got[5] == got[6] and got[1] != got[4]


def test_paths(spark):
    e = links(spark, [*TWO_TRIANGLES, (1, 2)])
    s = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.distance) for r in graph.distances(e, s, 3).collect()} == {(1, 0), (2, 1), (3, 1), (4, 2), (5, 3), (6, 3)}
    wanted = spark.createDataFrame([(1, 6), (1, 2)], "source long, target long")
    assert {(r.target, tuple(r.path)) for r in graph.shortest_paths(e, wanted, 3).collect()} == {(6, (1, 3, 4, 6)), (2, (1, 2))}
    t = graph.trails(e, s, 2).collect()
    assert all(len(set(r.eids)) == r.hops for r in t) and sum(r.hops == 1 for r in t) == 3 and (1, 2) in {(r.target, r.hops) for r in t}
    assert {r.other for r in graph.neighbours(e, s, "out").collect()} == {2, 3} and graph.neighbours(e, s, "in").count() == 0


def test_path_counts_are_brute_force(spark):
    rnd = random.Random(11)
    pairs = [(i, i + 1) for i in range(20)] + [(rnd.randint(200, 330), rnd.randint(200, 330)) for _ in range(150)] + [(500, 500)]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in near:
        level, reached, d = {start}, {start}, 0
        while level:
            level = {y for x in level for y in near[x]} - reached
            reached |= level
            d += 1
            if level:
                want[d] = want.get(d, 0) + len(level)
    assert max(want) == 20
    got = graph.path_counts(links(spark, pairs), 1, 100)
    assert {r.distance: r.pairs for r in got.collect()} == want
    assert graph.path_counts(links(spark, TWO_TRIANGLES).limit(0)).count() == 0


def test_whole_graph_paths_have_no_cap(spark, tmp_path):
    from pitchlake.plans import graph as queries

    chain = spark.createDataFrame([(i, i, i + 1) for i in range(12)], "edge_id long, player1_id long, player2_id long")
    tables = {
        "teammate": chain,
        "played_for": spark.createDataFrame([], "edge_id long, from_player_id long, to_club_id long"),
        "coached": spark.createDataFrame([], "edge_id long, from_coach_id long, to_club_id long"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    assert tuple(queries.path_lengths(spark, str(tmp_path)).first()) == (round(14 / 3, 6), 12, 156)


def test_merges(spark):
    old = spark.createDataFrame([(1, 1, "a", None), (2, 1, "b", "x")], "k long, v long, n string, p string")
    new = spark.createDataFrame([(1, 2, None, "y"), (3, 1, "c", None), (3, 0, "d", None)], "k long, v long, n string, p string")
    assert {tuple(r) for r in graph.merge_last(old, new, ["k"], "v").collect()} == {(1, 2, None, "y"), (2, 1, "b", "x"), (3, 1, "c", None)}
    on = graph.merge_on_match(old.drop("v"), new.filter("v > 0").drop("v"), "k", ["p"])
    assert {tuple(r) for r in on.collect()} == {(1, "a", "y", "matched"), (2, "b", "x", "kept"), (3, "c", None, "created")}
    assert graph.create_absent(old, new, ["k"]).count() == 3
    nodes = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "id long, label string")
    n, e = graph.detach_delete(nodes, links(spark, [(1, 2), (2, 3), (3, 1)]), F.col("label") == "A")
    assert {r.id for r in n.collect()} == {2, 3} and {(r.src, r.dst) for r in e.collect()} == {(2, 3)}


def test_infobox(spark):
    page = "x {{nav|a=1}} {{Thông tin tiểu sử bóng đá\n| tên = [[A|B]]\n|clubs1=[[C (D)|C]]|years1=2001–05|caps1=12|goals1=(3)\n|clubs2=E|years2=2006–nay|clubs2=F|birth={{date|1990|1|2}}|empty= }} y"
    df = spark.createDataFrame([(page,), (None,), ("{{open",)], "w string").select(infobox.infobox_params(F.col("w"), ["thông tin"], ["bóng đá"]).alias("p"))
    rows = df.select("p", infobox.career(F.col("p"), "clubs", "years", "caps", "goals").alias("c")).collect()
    assert rows[0].p["tên"] == "[[A|B]]" and rows[0].p["birth"] == "{{date|1990|1|2}}" and "empty" not in rows[0].p
    assert [tuple(s) for s in rows[0].c] == [("C", 2001, 2005, 12, 3), ("F", 2006, None, None, None)]
    assert rows[1].p == {} and rows[2].c == []
    assert one(spark, "Cúp trẻ", infobox.first_classified(F.col("x"), [("trẻ", "youth"), ("cúp", "cup")], "league").alias("k")).k == "youth"


def test_text_operators(spark):
    df = spark.createDataFrame([(1, "Câu một dài hơn. Câu hai cũng dài!\nNgắn. Năm 2001 thủ môn Đạ Thúc FC bay."), (2, None), (3, "")], "id long, t string")
    s = textops.sentences(df, "id", "t", 10, 100).collect()
    assert [(r.sentence_id, r.sentence) for r in s] == [("1_0", "Câu một dài hơn."), ("1_1", "Câu hai cũng dài!"), ("1_2", "Năm 2001 thủ môn Đạ Thúc FC bay.")]
    spans = df.select("t", F.explode(textops.pattern_spans(F.col("t"), [(r"năm \d{4}", "DATE", 0.95), ("thủ môn", "POSITION", 0.9)])).alias("s")).collect()
    assert all(r.t[r.s.start : r.s.end] == r.s.text for r in spans) and [r.s.type for r in spans] == ["DATE", "POSITION"]
    names = spark.createDataFrame([(7, "Đạ Thúc FC"), (8, "Thúc"), (9, "Xa")], "i long, n string")
    assert {(r.id, r.i) for r in textops.dictionary_mentions(df, "id", "t", names, "n", "i").collect()} == {(1, 7), (1, 8)}
    assert textops.resolve_spans([(1, 0, 5, 1), (0, 3, 8, 2), (2, 9, 12, 3), (1, 0, 2, 4)]) == [(1, 0, 2, 4), (0, 3, 8, 2), (2, 9, 12, 3)]


def test_stats(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(10)], "i long, k string")
    assert {r.k: r.n for r in stats.count_with_zeros(df, "k", ["a", "b", "c"]).collect()} == {"a": 7, "b": 3, "c": 0}
    assert {r.i for r in stats.top_per_group(df, "k", [F.desc("i")], 2).collect()} == {6, 5, 9, 8}
    total = stats.grouped_sets(df, [["k"], []], F.count("*").alias("n")).collect()
    assert {(r.k, r.n) for r in total} == {("a", 7), ("b", 3), (None, 10)}
    assert stats.hash_sample(spark.range(20_000), F.col("id"), "#", "40").count() == pytest.approx(5000, rel=0.1)


def test_sections_and_relation_patterns(spark):
    page = "intro\n== Sự nghiệp ==\na\n=== Câu lạc bộ ===\nb\n== Tham khảo ==\nc\n=== Sách ===\nd\n== Khác ==\ne"
    assert one(spark, page, textops.without_sections(F.col("x"), ["tham khảo"]).alias("t")).t == "intro\n== Sự nghiệp ==\na\n=== Câu lạc bộ ===\nb\n== Khác ==\ne"
    assert one(spark, None, textops.without_sections(F.col("x"), ["x"]).alias("t")).t is None
    df = spark.createDataFrame([(1, "Đạ Thúc chuyển sang Reo Nhoạt FC mùa 2001."), (2, "A thua B"), (3, None)], "id long, t string")
    found = textops.pattern_relations(df, "id", "t", [("chuyển sang", "TO", False, 0.9), ("thua", "BEAT", True, 0.8)], f"[{X.UPPER}][^ .,]*(?: [{X.UPPER}][^ .,]*)*")
    assert {(r.id, r.predicate, r.subject, r.object) for r in found.collect()} == {(1, "TO", "Đạ Thúc", "Reo Nhoạt FC"), (2, "BEAT", "B", "A")}


def test_distractors_are_whole(spark, tmp_path):
    from pitchlake.plans import graph as queries
    from pitchlake.plans import text as questions

    clubs = [(i, f"Club{i}") for i in range(1, 41)]
    played = [(1000 + p, g) for p in range(30) for g in range(1, 41) if g != p + 1]  # all clubs but one
    played += [(2000, g) for g in range(1, 41)] + [(3000, 5), (3000, 99)]
    facts = [(1, 1000, 2, "a Club1"), (2, 3000, 5, "a Club5"), (3, 7777, 6, "a Club6"), (4, 2000, 7, "a Club7"), (5, 3000, 8, "nothing")]
    tables = {
        "club_parsed": spark.createDataFrame(clubs, "wiki_id long, name string"),
        "played_for": spark.createDataFrame(played, "from_player_id long, to_club_id long"),
        "relation": spark.createDataFrame([(*f, "PLAYED_FOR") for f in facts], "relation_id long, subject_wiki_id long, object_wiki_id long, context string, predicate string"),
    }
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.player: r.club for r in queries.false_memberships(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(1000, 1030), 3000} and got[3000] not in (5, 99)
    assert all(got[1000 + p] == p + 1 for p in range(30))
    m = tables["played_for"].toDF("player", "club")
    asked = tables["relation"].select("relation_id", F.col("subject_wiki_id").alias("player"), F.col("object_wiki_id").alias("own"))
    drawn = {}
    for r in queries.free_clubs(asked, "relation_id", m, tables["club_parsed"].withColumnRenamed("wiki_id", "club"), 3).collect():
        drawn.setdefault(r.relation_id, []).append(r.club)
    assert {k: len(v) for k, v in drawn.items()} == {1: 1, 2: 3, 3: 3, 5: 3} and all(len(set(v)) == len(v) for v in drawn.values())
    assert drawn[1] == [1] and 5 not in drawn[2] and 6 not in drawn[3] and not {5, 8} & set(drawn[5])
    asked = questions.choice_questions(spark, str(tmp_path)).collect()
    assert {r.relation_id: r.chosen for r in asked if r.relation_id < 5} == {1: 1, 2: 5, 3: 6, 4: 7} and len(asked) == 5


def test_pagerank_has_twenty_rounds(spark, tmp_path):
    from pitchlake.plans import graph as queries

    pairs = [(i, i + 1) for i in range(30)] + [(0, 40), (0, 41), (0, 42)]
    spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "edge_id long, player1_id long, player2_id long").write.parquet(str(tmp_path / "teammate.parquet"))
    spark.createDataFrame([], "edge_id long, from_player_id long, to_club_id long").write.parquet(str(tmp_path / "played_for.parquet"))
    spark.createDataFrame([], "edge_id long, from_coach_id long, to_club_id long").write.parquet(str(tmp_path / "coached.parquet"))
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    score = dict.fromkeys(near, 1.0)
    for _ in range(20):
        score = {x: 0.15 + 0.85 * sum(score[y] / len(near[y]) for y in near[x]) for x in near}
    got = {r.id: r.score for r in queries.pagerank(spark, str(tmp_path)).collect()}
    assert set(got) == set(score) and all(abs(got[x] - score[x]) < 2e-6 for x in score)


def test_hot_groups_in_blocks(spark, monkeypatch):
    rows = [(i, "hot" if i < 60 else f"g{i % 5}", 2000 + i % 7, 2003 + i % 5, i) for i in range(100)]
    df = spark.createDataFrame(rows, "p long, g string, a int, b int, o long").repartition(3)
    plain = sorted(tuple(r) for r in intervals.interval_self_join(df, "p", "g", "a", "b", "o").collect())
    pairs = sorted(tuple(r) for r in intervals.overlapping_pairs(df, "p", "g", "a", "b").collect())
    monkeypatch.setattr(intervals, "BLOCK", 7)
    assert sorted(tuple(r) for r in intervals.interval_self_join(df, "p", "g", "a", "b", "o").collect()) == plain
    assert sorted(tuple(r) for r in intervals.overlapping_pairs(df, "p", "g", "a", "b").collect()) == pairs
    cut, whole = intervals.blocks(df.select("g", "p"), df.select("g", "p"), "g", ["p"])
    sizes = {(r.g, r._block): r["count"] for r in cut.groupBy("g", "_block").count().collect()}
    assert sum(sizes.values()) == 100 and len([k for k in sizes if k[0] == "hot"]) == 9 and whole.filter("g = 'hot'").count() == 540
