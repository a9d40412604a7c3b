"""Queries that pass tables through the file sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.plans.registry import query
from pitchlake.plans.stats import EDGES_SQL, NODES_SQL, edges, nodes
from pitchlake.session import shared_dir, table
from pitchlake.sources import files
from pitchlake.sources.fetch import category_members


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pitchlake/{name}-{uuid.uuid4().hex}"


@query("jsonl_players", "SELECT wiki_id, name, len(clubs_history)::INT AS stints, clubs_history[1].club_name AS first_club FROM player_parsed")
def jsonl_players(spark: SparkSession, sf: str) -> DataFrame:
    """Players with nested histories written as JSON lines and read again with a fixed schema."""
    path = _folder(spark, "players")
    files.write_jsonl(table(spark, sf, "player_parsed"), path)
    back = files.read_jsonl(spark, path, files.PLAYER)
    return back.select("wiki_id", "name", F.when(F.col("clubs_history").isNotNull(), F.size("clubs_history")).alias("stints"), F.try_element_at("clubs_history", F.lit(1))["club_name"].alias("first_club"))


@query("csv_clubs", "SELECT wiki_id, nullif(name, '') AS name, nullif(chairman, '') AS chairman, nullif(capacity, '') AS capacity FROM club_parsed")
def csv_clubs(spark: SparkSession, sf: str) -> DataFrame:
    """Clubs written as CSV and read again, empty fields as null."""
    path = _folder(spark, "clubs")
    files.write_csv(table(spark, sf, "club_parsed").select("wiki_id", "name", "chairman", "capacity"), path)
    return files.read_csv(spark, path, "wiki_id bigint, name string, chairman string, capacity string")


@query("unseen_pages", "SELECT DISTINCT wiki_id FROM player_parsed WHERE wiki_id NOT IN (SELECT from_player_id FROM played_for WHERE from_player_id IS NOT NULL)")
def unseen_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Incremental scan: pages whose key wasn't seen before."""
    seen = table(spark, sf, "played_for").select(F.col("from_player_id").alias("wiki_id"))
    return files.unseen(table(spark, sf, "player_parsed").select("wiki_id").filter("wiki_id IS NOT NULL").distinct(), seen, "wiki_id")


@query("collectable_texts", "SELECT doc_id, md5(text) AS text_hash FROM documents WHERE length(text) >= 50 AND doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def collectable_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts long enough that weren't collected before."""
    d = table(spark, sf, "documents")
    return files.collectable(d.select("doc_id", "text"), d.filter("lang = 'en'"), "doc_id", "text").select("doc_id", "text_hash")


@query("sql_passthrough", "SELECT entity_type, count(*)::BIGINT AS n FROM entity WHERE confidence >= 0.7 GROUP BY 1")
def sql_passthrough(spark: SparkSession, sf: str) -> DataFrame:
    """A raw statement with a named parameter."""
    return files.run_sql(spark, "SELECT entity_type, count(*) AS n FROM entity WHERE confidence >= :least GROUP BY 1", {"entity": table(spark, sf, "entity")}, least=0.7)


@query(
    "league_pages",
    """WITH l AS (SELECT DISTINCT league AS category, CAST(wiki_id AS VARCHAR) AS member FROM club_parsed WHERE league IS NOT NULL AND wiki_id IS NOT NULL), m AS (SELECT DISTINCT CAST(to_club_id AS VARCHAR) AS category, CAST(from_player_id AS VARCHAR) AS member FROM played_for WHERE to_club_id IS NOT NULL AND from_player_id IS NOT NULL)
    SELECT DISTINCT l.category AS root, m.member AS page FROM l JOIN m ON m.category = l.member""",
)
def league_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of each league's category: the players in the subcategories, which are its clubs, one level down."""
    clubs = table(spark, sf, "club_parsed").select(F.col("league").alias("category"), F.col("wiki_id").cast("string").alias("member"), F.lit(True).alias("is_category"))
    players = table(spark, sf, "played_for").select(F.col("to_club_id").cast("string").alias("category"), F.col("from_player_id").cast("string").alias("member"), F.lit(False).alias("is_category"))
    roots = table(spark, sf, "club_parsed").select(F.col("league").alias("root")).filter("root IS NOT NULL").distinct()
    return category_members(clubs.unionByName(players), roots, 1)


@query(
    "graph_script",
    rf"""SELECT 0 AS part, 'MERGE (n:' || label || ' {{id: ' || id || '}})' || CASE WHEN name IS NOT NULL THEN ' SET n.name = ' || chr(39) || replace(replace(name, '\', '\\'), chr(39), '\' || chr(39)) || chr(39) ELSE '' END || ';' AS statement FROM ({NODES_SQL})
    UNION ALL SELECT 1, 'MATCH (a {{id: ' || src || '}}), (b {{id: ' || dst || '}}) MERGE (a)-[:' || rel || ']->(b);' FROM (SELECT DISTINCT src, rel, dst FROM ({EDGES_SQL}))""",
)
def graph_script(spark: SparkSession, sf: str) -> DataFrame:
    """The graph as a script of statements with literal values."""
    return files.graph_script(nodes(spark, sf), edges(spark, sf))


@query(
    "merged_csv",
    "SELECT wiki_id, fetched_at, name, founded FROM (SELECT wiki_id, fetched_at, nullif(name, '') AS name, founded, row_number() OVER (PARTITION BY wiki_id ORDER BY fetched_at DESC, nullif(name, '') DESC NULLS LAST, founded DESC NULLS LAST) AS rn FROM club_parsed WHERE wiki_id IS NOT NULL) WHERE rn = 1",
)
def merged_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Clubs from a CSV with casts, merged by key into an empty graph: the last version of each page."""
    path = _folder(spark, "merge")
    c = table(spark, sf, "club_parsed").select("wiki_id", "fetched_at", "name", "founded")
    files.write_csv(c.withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss.SSSSSS")), path)
    schema = f"wiki_id bigint, fetched_at {c.schema['fetched_at'].dataType.simpleString()}, name string, founded int"
    return files.csv_merge(spark, path, schema, ["wiki_id"], "fetched_at", c.limit(0))
