"""Files and streams: round trips, malformed input, restarts."""

import json

import pytest
from pyspark.sql import functions as F

from pitchlake.operators.interval_map import IntervalMap
from pitchlake.sources import files
from pitchlake.streaming import ingest


def test_pages_and_json_lines(spark, tmp_path):
    d = tmp_path / "raw"
    d.mkdir()
    (d / "player_1.json").write_text(json.dumps({"page_id": 1, "page_title": "A", "entity_type": "player", "wikitext": "x\ny"}))
    (d / "player_2.json").write_text('{"page_id": 2, "page_ti')
    pages = files.read_raw_pages(spark, str(d))
    assert [(r.page_id, r.wikitext) for r in pages.collect()] == [(1, "x\ny")]
    files.write_raw_pages(pages, str(tmp_path / "out"))
    assert (tmp_path / "out" / "entity_type=player").exists()
    lines = tmp_path / "l.jsonl"
    lines.write_text('{"wiki_id": 1, "clubs_history": [{"club_name": "C", "from_year": 2001}]}\n\n{bad\n{"wiki_id": 2, "more": 3}\n')
    got = files.read_jsonl(spark, str(lines), files.PLAYER).select("wiki_id", F.size("clubs_history").alias("n")).collect()
    assert {r.wiki_id: r.n for r in got if r.wiki_id is not None} == {1: 1, 2: None}
    assert files.read_jsonl(spark, str(tmp_path / "none"), files.PLAYER).count() == 0


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', [1, 2]), (2, None, None), (3, "đ", [])], "id long, t string, l array<int>")
    assert files.write_csv(df, str(tmp_path / "c")) and not files.write_csv(df.limit(0), str(tmp_path / "e"))
    back = {r.id: (r.t, r.l) for r in files.read_csv(spark, str(tmp_path / "c"), "id long, t string, l string").collect()}
    assert back == {1: ('a "q", b\nc', "[1,2]"), 2: (None, None), 3: ("đ", "[]")}
    assert files.read_csv(spark, str(tmp_path / "e"), "id long").count() == 0


def test_texts_and_reports(spark, tmp_path):
    d = tmp_path / "t"
    d.mkdir()
    (d / "a.txt").write_text('<!-- METADATA: {"wiki_id": 5, "page_title": "P"} -->\n\nText one.')
    (d / "b.txt").write_text("Only text.")
    got = {(r.wiki_id, r.page_title, r.text) for r in files.read_texts(spark, str(d)).collect()}
    assert got == {(5, "P", "Text one."), (None, None, "Only text.")}
    pages = spark.createDataFrame([(1, "x" * 60), (2, "y" * 60), (3, "short")], "id long, t string")
    assert [r.id for r in files.collectable(pages, pages.filter("id = 2"), "id", "t").collect()] == [1]
    assert files.supplement(spark.createDataFrame([(1,), (3,)], "id long"), pages.filter("id = 1"), pages.withColumn("u", F.lit(1)), "id").count() == 2
    assert files.write_report(pages.agg(F.count("*").alias("n")), str(tmp_path / "r" / "x.json")) == {"n": 3}
    assert json.loads((tmp_path / "r" / "x.json").read_text()) == {"n": 3}


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id long, v long, n string, a long, b long"
    def run():
        stream = spark.readStream.schema(schema).parquet(src)
        w = ingest.upsert_batches(stream, str(tmp_path / "table"), ["id"], "v", str(tmp_path / "cp1")).trigger(availableNow=True).start()
        w.awaitTermination(90)
        m = ingest.interval_stream(stream, "id", "a", "b").writeStream.outputMode("update")
        m = m.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "maps"))).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
        m.awaitTermination(90)
    spark.createDataFrame([(1, 1, "a", 2000, 2002), (2, 1, "b", 1990, 1995)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    spark.createDataFrame([(1, 2, "c", 2003, 2004), (1, 0, "old", 2010, 2011), (2, 1, None, None, 1)], schema).coalesce(1).write.mode("append").parquet(src)
    run()
    held = ingest.current(spark, str(tmp_path / "table"), spark.read.parquet(src).schema)
    assert {(r.id, r.v, r.n) for r in held.collect()} == {(1, 2, "c"), (2, 1, "b")}
    assert len(list((tmp_path / "table").iterdir())) == 2  # the buckets of two keys, not the whole table
    maps = spark.read.parquet(str(tmp_path / "maps")).collect()
    newest = {r.key: max(x.version for x in maps if x.key == r.key) for r in maps}
    got = {(r.key, r.kind, r.start, r.end) for r in maps if r.version == newest[r.key]}
    held = IntervalMap()
    for s, e in ((2000, 2002), (2003, 2004), (2010, 2011)):
        held.insert(s, e)
    assert got == {(1, *r) for r in held.rows()} | {(2, "period", 1990, 1995)}


def test_pages_from_outside(spark):
    from pitchlake.sources import fetch

    def get(key):
        if key == 2:
            raise OSError("gone")
        return f"page {key}"

    wanted = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (None, "x")], "id long, page string")
    assert {tuple(r) for r in fetch.fetch_pages(wanted, "id", get, 2, 0.0).collect()} == {(1, "page 1", None), (2, None, "gone")}
    calls = []
    assert fetch.retried(lambda: calls.append(1) or len(calls), 3, 0.0) == 1
    with pytest.raises(ZeroDivisionError):
        fetch.retried(lambda: 1 / 0, 2, 0.0, True)
    links = spark.createDataFrame([("a", "p1", False), ("a", "b", True), ("b", "p2", False), ("b", "c", True), ("c", "p3", False), ("b", "a", True), ("a", None, False), ("a", "p1", False)], "category string, member string, is_category boolean")
    pages = lambda d: {r.page for r in fetch.category_members(links, spark.createDataFrame([("a",)], "root string"), d).collect()}
    assert pages(0) == {"p1"} and pages(1) == {"p1", "p2"} and pages(5) == {"p1", "p2", "p3"}


def test_reports_and_scripts(spark):
    df = spark.createDataFrame([("a|b", 2), ("c<d", 1), (None, None)], "k string, n int")
    assert "| a\\|b | 2 |" in files.markdown("T", {"Counts": df}) and files.markdown("T", {"Counts": df}).startswith("# T\n")
    svg = files.chart(df, "k", "n")
    assert svg.count("<rect") == 3 and "c&lt;d" in svg and 'width="400.0"' in svg
    nodes = spark.createDataFrame([(1, "A", "it's \\ x"), (2, "A", None)], "id long, label string, name string")
    edges = spark.createDataFrame([(1, 2, "R"), (1, 2, "R")], "src long, dst long, rel string")
    got = [r.statement for r in files.graph_script(nodes, edges).orderBy("part", "statement").collect()]
    assert got == ["MERGE (n:A {id: 1}) SET n.name = 'it\\'s \\\\ x';", "MERGE (n:A {id: 2});", "MATCH (a {id: 1}), (b {id: 2}) MERGE (a)-[:R]->(b);"]
    rows = files.literal_rows(spark, '[{"a": 1, "b": "x"}, {"a": null}]', "a int, b string")
    assert {tuple(r) for r in rows.collect()} == {(1, "x"), (None, None)} and files.literal_rows(spark, [(1,)], "a int").count() == 1
    pages = spark.createDataFrame([(1, "club"), (2, "coach"), (3, "other")], "id int, entity_type string")
    routed = files.routed(pages, {"club": lambda p: p.select("id"), "coach": lambda p: p.filter("id > 5")})
    assert {k: v.count() for k, v in routed.items()} == {"club": 1, "coach": 0}
    assert [r.id for r in files.limited(pages, "id", 2).collect()] == [1, 2]


def test_infobox_variants(spark):
    from pitchlake.operators import infobox

    text = "{{Infobox football biography| Clubs1 = [[A]] |years1=2001-03|caps1=5|clubs2=B|years2=2004|clubs4=D|years4=2008|nationalteam1=N|nationalyears1=2005-nay|nationalcaps1=7}}"
    p = infobox.infobox_params(F.col("t"), ["infobox"], ["football"])
    one = spark.createDataFrame([(text,)], "t string").select(p.alias("p")).select("p", infobox.consecutive_career(F.col("p"), "clubs", "years", "caps", "goals").alias("c"), infobox.consecutive_career(F.col("p"), "nationalteam", "nationalyears", "nationalcaps", "nationalgoals").alias("n"), infobox.career(F.col("p"), "clubs", "years", "caps", "goals").alias("all")).first()
    assert one.p["Clubs1"] == one.p["clubs1"] == "[[A]]" and [s.club_name for s in one.c] == ["A", "B"] and [s.club_name for s in one["all"]] == ["A", "B", "D"]
    assert [(s.club_name, s.from_year, s.to_year, s.appearances) for s in one.n] == [("N", 2005, None, 7)]
    exact = spark.createDataFrame([("{{cầu thủ|a=1}}",)], "t string").select(infobox.infobox_params(F.col("t"), ["infobox"], ["football"], ("cầu thủ",)).alias("p")).first()
    assert exact.p == {"a": "1"}
    told = spark.createDataFrame([("2001-2003: [[x|Đội A]]\nkhông\n[[B]] (2005)",)], "t string").select(infobox.career_in_text(F.col("t")).alias("c")).first()
    assert [tuple(s) for s in told.c] == [("Đội A", 2001, 2003), ("B", 2005, 2005)]
