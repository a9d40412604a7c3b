"""Queries of statistics, rankings, samples and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.operators import stats
from pitchlake.plans.registry import query
from pitchlake.session import table

NODES_SQL = """SELECT wiki_id AS id, 'Player' AS label, min(name) AS name FROM player_parsed WHERE wiki_id IS NOT NULL GROUP BY 1
UNION ALL SELECT wiki_id, 'Coach', min(name) FROM coach_parsed WHERE wiki_id IS NOT NULL GROUP BY 1
UNION ALL SELECT wiki_id, 'Club', min(name) FROM club_parsed WHERE wiki_id IS NOT NULL GROUP BY 1
UNION ALL SELECT wiki_id, 'NationalTeam', min(name) FROM national_team_parsed WHERE wiki_id IS NOT NULL GROUP BY 1"""
EDGES_SQL = """SELECT edge_id AS eid, from_player_id AS src, to_club_id AS dst, 'PLAYED_FOR' AS rel FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL
UNION ALL SELECT edge_id, from_coach_id, to_club_id, 'COACHED' FROM coached WHERE from_coach_id IS NOT NULL AND to_club_id IS NOT NULL
UNION ALL SELECT edge_id, player1_id, player2_id, 'TEAMMATE' FROM teammate WHERE player1_id IS NOT NULL AND player2_id IS NOT NULL"""


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, label, name) of the graph's nodes."""
    out = None
    for t, label in (("player_parsed", "Player"), ("coach_parsed", "Coach"), ("club_parsed", "Club"), ("national_team_parsed", "NationalTeam")):
        part = table(spark, sf, t).filter("wiki_id IS NOT NULL").groupBy(F.col("wiki_id").alias("id")).agg(F.min("name").alias("name")).select("id", F.lit(label).alias("label"), "name")
        out = part if out is None else out.unionByName(part)
    return out


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """(eid, src, dst, rel) of the graph's edges, several between two nodes kept."""
    out = None
    for t, s, d, rel in (("played_for", "from_player_id", "to_club_id", "PLAYED_FOR"), ("coached", "from_coach_id", "to_club_id", "COACHED"), ("teammate", "player1_id", "player2_id", "TEAMMATE")):
        part = table(spark, sf, t).filter(F.col(s).isNotNull() & F.col(d).isNotNull()).select(F.col("edge_id").alias("eid"), F.col(s).alias("src"), F.col(d).alias("dst"), F.lit(rel).alias("rel"))
        out = part if out is None else out.unionByName(part)
    return out


@query("nodes", NODES_SQL)
def nodes_query(spark: SparkSession, sf: str) -> DataFrame:
    """The nodes of the graph."""
    return nodes(spark, sf)


@query(
    "graph_counts",
    f"""WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL}) SELECT 'node' AS what, label AS kind, count(*)::BIGINT AS n FROM n GROUP BY 2 UNION ALL SELECT 'edge', rel, count(*)::BIGINT FROM e GROUP BY 2
    UNION ALL SELECT 'pair', rel, count(DISTINCT (least(src, dst), greatest(src, dst)))::BIGINT FROM e GROUP BY 2""",
)
def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by label, edges by type, and undirected pairs by type."""
    e = edges(spark, sf)
    n = nodes(spark, sf).groupBy(F.col("label").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    by = e.groupBy(F.col("rel").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n")
    pairs = e.select("rel", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy(F.col("rel").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("pair").alias("what"), "kind", "n")
    return n.unionByName(by).unionByName(pairs)


@query(
    "listed_type_counts",
    """SELECT v.t AS entity_type, count(e.entity_id)::BIGINT AS n FROM (VALUES ('PLAYER'), ('CLUB'), ('COACH'), ('STADIUM'), ('AWARD'), ('NATIONAL_TEAM')) v(t) LEFT JOIN entity e ON e.entity_type = v.t GROUP BY 1""",
)
def listed_type_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of a fixed list of types, those without rows as zero."""
    return stats.count_with_zeros(table(spark, sf, "entity"), "entity_type", ["PLAYER", "CLUB", "COACH", "STADIUM", "AWARD", "NATIONAL_TEAM"])


@query("graph_density", f"WITH n AS ({NODES_SQL}), e AS ({EDGES_SQL}) SELECT (SELECT count(*) FROM n)::BIGINT AS nodes, (SELECT count(*) FROM e)::BIGINT AS edges, round(100.0 * (SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * (SELECT count(*) FROM n))::DOUBLE, 6) AS density")
def graph_density(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes, edges and density in percent of all ordered pairs."""
    n, e = nodes(spark, sf).agg(F.count("*").alias("nodes")), edges(spark, sf).agg(F.count("*").alias("edges"))
    return n.join(F.broadcast(e)).select("nodes", "edges", F.round(F.try_divide(100.0 * F.col("edges"), (F.col("nodes") * F.col("nodes")).cast("double")), 6).alias("density"))


@query(
    "top_clubs",
    "SELECT to_club_id, count(DISTINCT from_player_id)::BIGINT AS players, count(*)::BIGINT AS stints FROM played_for WHERE to_club_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
)
def top_clubs(spark: SparkSession, sf: str) -> DataFrame:
    """Clubs with the most different players."""
    p = table(spark, sf, "played_for").filter("to_club_id IS NOT NULL")
    return p.groupBy("to_club_id").agg(F.countDistinct("from_player_id").alias("players"), F.count("*").alias("stints")).orderBy(F.desc("players"), "to_club_id").limit(10)


@query(
    "top_per_label",
    f"""WITH d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id, eid, rel FROM ({EDGES_SQL}) UNION SELECT dst, eid, rel FROM ({EDGES_SQL})) GROUP BY 1),
    r AS (SELECT n.id, n.label, d.degree::BIGINT AS degree, row_number() OVER (PARTITION BY n.label ORDER BY d.degree DESC, n.id) AS rn FROM ({NODES_SQL}) n JOIN d ON d.id = n.id)
    SELECT id, label, degree FROM r WHERE rn <= 10 ORDER BY degree DESC, id LIMIT 20""",
)
def top_per_label(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nodes of each label with the highest degree, merged to twenty."""
    e = edges(spark, sf)
    d = e.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    ranked = stats.top_per_group(nodes(spark, sf).join(d, "id"), "label", [F.desc("degree"), F.col("id")], 10)
    return ranked.select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(20)


@query(
    "position_share",
    "SELECT entity_type, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(count(*) / max(count(*)) OVER (), 6) AS of_largest FROM entity GROUP BY 1",
)
def position_share(spark: SparkSession, sf: str) -> DataFrame:
    """Distribution of types with each one's share and its size against the largest."""
    g = table(spark, sf, "entity").groupBy("entity_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1))  # a row per type: the groups, not the rows, meet in one task
    return g.select("entity_type", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"), F.round(F.col("n") / F.max("n").over(w), 6).alias("of_largest"))


@query(
    "age_histogram",
    """SELECT CASE WHEN a < 20 THEN 'U20' WHEN a < 25 THEN '20-24' WHEN a < 30 THEN '25-29' WHEN a < 35 THEN '30-34' ELSE '35+' END AS age_group, count(*)::BIGINT AS n FROM (SELECT 2025 - try_cast(left(date_of_birth, 4) AS INT) AS a FROM player_parsed) WHERE a > 15 AND a < 60 GROUP BY 1""",
)
def age_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Players by age group as of 2025, ages 16 to 59."""
    a = F.lit(2025) - F.left("date_of_birth", F.lit(4)).try_cast("int")
    p = table(spark, sf, "player_parsed").select(a.alias("a")).filter("a > 15 AND a < 60")
    return p.groupBy(stats.bucket(F.col("a"), [20, 25, 30, 35], ["U20", "20-24", "25-29", "30-34", "35+"]).alias("age_group")).agg(F.count("*").alias("n"))


@query(
    "degree_histogram",
    f"""WITH d AS (SELECT n.id, count(e.id) AS d FROM ({NODES_SQL}) n LEFT JOIN (SELECT src AS id FROM ({EDGES_SQL}) UNION ALL SELECT dst FROM ({EDGES_SQL}) WHERE src <> dst) e ON e.id = n.id GROUP BY 1)
    SELECT CASE WHEN d < 5 THEN '0-4' WHEN d < 10 THEN '5-9' WHEN d < 20 THEN '10-19' WHEN d < 50 THEN '20-49' ELSE '50+' END AS degree_group, count(*)::BIGINT AS n FROM d GROUP BY 1""",
)
def degree_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes by group of degree, nodes without an edge included: an aggregate of an aggregate."""
    ends = edges(spark, sf).select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    d = nodes(spark, sf).select("id").join(ends, "id", "left").select(F.coalesce("d", F.lit(0)).alias("d"))
    return d.groupBy(stats.bucket(F.col("d"), [5, 10, 20, 50], ["0-4", "5-9", "10-19", "20-49", "50+"]).alias("degree_group")).agg(F.count("*").alias("n"))


@query(
    "career_lengths",
    """WITH c AS (SELECT from_player_id, max(to_year) - min(from_year) AS y, min(from_year) AS debut FROM played_for WHERE from_player_id IS NOT NULL AND from_year > 0 AND to_year > 0 GROUP BY 1)
    SELECT y::INT AS years, count(*)::BIGINT AS n, count(*) FILTER (debut BETWEEN 1990 AND 2025)::BIGINT AS recent FROM c WHERE y > 0 AND y < 30 GROUP BY 1""",
)
def career_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Histogram of career lengths of 1 to 29 years, and how many of each began from 1990 on."""
    p = table(spark, sf, "played_for").filter("from_player_id IS NOT NULL AND from_year > 0 AND to_year > 0")
    c = p.groupBy("from_player_id").agg((F.max("to_year") - F.min("from_year")).alias("years"), F.min("from_year").alias("debut")).filter("years > 0 AND years < 30")
    return c.groupBy("years").agg(F.count("*").alias("n"), F.count_if(F.col("debut").between(1990, 2025)).alias("recent"))


@query(
    "mean_career_length",
    """WITH c AS (SELECT max(to_year) - min(from_year) AS y FROM played_for WHERE from_player_id IS NOT NULL AND from_year > 0 AND to_year > 0 GROUP BY from_player_id), h AS (SELECT y, count(*) AS n FROM c WHERE y > 0 AND y < 30 GROUP BY 1) SELECT round(sum(y * n) / sum(n), 6) AS mean_years FROM h""",
)
def mean_career_length(spark: SparkSession, sf: str) -> DataFrame:
    """Weighted mean of a histogram."""
    return career_lengths(spark, sf).agg(F.round(F.sum(F.col("years") * F.col("n")) / F.sum("n"), 6).alias("mean_years"))


@query("active_by_year", "SELECT to_year, count(DISTINCT from_player_id)::BIGINT AS players FROM played_for WHERE to_year BETWEEN 1990 AND 2025 GROUP BY 1 HAVING count(DISTINCT from_player_id) >= 3")
def active_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Players per last year, years with three or more: a filter after the aggregate."""
    return table(spark, sf, "played_for").filter("to_year BETWEEN 1990 AND 2025").groupBy("to_year").agg(F.countDistinct("from_player_id").alias("players")).filter("players >= 3")


@query("source_counts", "SELECT source, entity_type, count(*)::BIGINT AS n, count(wiki_id)::BIGINT AS linked FROM entity WHERE source IS NOT NULL GROUP BY GROUPING SETS ((source), (entity_type), (source, entity_type), ())")
def source_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions by source, by type, by both and in all, with how many are linked."""
    e = table(spark, sf, "entity").filter("source IS NOT NULL")
    return stats.grouped_sets(e, [["source"], ["entity_type"], ["source", "entity_type"], []], F.count("*").alias("n"), F.count("wiki_id").alias("linked"))


@query(
    "confidence_tiers",
    """SELECT predicate, tier, count(*)::BIGINT AS n FROM (SELECT predicate, CASE WHEN confidence >= 0.85 THEN 'high' WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS tier FROM relation WHERE predicate IS NOT NULL AND confidence IS NOT NULL) GROUP BY GROUPING SETS ((predicate), (tier))""",
)
def confidence_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by predicate and by tier of confidence."""
    tier = F.when(F.col("confidence") >= 0.85, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    r = table(spark, sf, "relation").filter("predicate IS NOT NULL AND confidence IS NOT NULL").select("predicate", tier.alias("tier"))
    return stats.grouped_sets(r, [["predicate"], ["tier"]], F.count("*").alias("n"))


@query(
    "natural_communities",
    "SELECT to_club_id, count(DISTINCT from_player_id)::BIGINT AS members, min(from_player_id) AS first_member, max(from_player_id) AS last_member FROM played_for WHERE to_club_id IS NOT NULL AND from_player_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT from_player_id) >= 3",
)
def natural_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities by membership of three or more, with sizes instead of unbounded member lists."""
    p = table(spark, sf, "played_for").filter("to_club_id IS NOT NULL AND from_player_id IS NOT NULL").groupBy("to_club_id")
    return p.agg(F.countDistinct("from_player_id").alias("members"), F.min("from_player_id").alias("first_member"), F.max("from_player_id").alias("last_member")).filter("members >= 3")


@query(
    "community_members",
    "SELECT to_club_id, from_player_id FROM (SELECT DISTINCT to_club_id, from_player_id FROM played_for WHERE to_club_id IS NOT NULL AND from_player_id IS NOT NULL) WHERE to_club_id IN (SELECT to_club_id FROM played_for WHERE from_player_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT from_player_id) >= 3)",
)
def community_members(spark: SparkSession, sf: str) -> DataFrame:
    """The members of each community of three or more, one row each: a list could be as long as the table."""
    m = table(spark, sf, "played_for").select("to_club_id", "from_player_id").dropna().distinct()
    return m.join(m.groupBy("to_club_id").agg(F.count("*").alias("n")).filter("n >= 3").select("to_club_id"), "to_club_id", "left_semi")


@query("community_sizes", "SELECT min(n)::BIGINT AS least, max(n)::BIGINT AS most, round(avg(n), 6) AS mean, count(*)::BIGINT AS communities FROM (SELECT count(DISTINCT from_player_id) AS n FROM played_for WHERE to_club_id IS NOT NULL GROUP BY to_club_id HAVING count(DISTINCT from_player_id) >= 3)")
def community_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest, largest and mean size of the communities."""
    n = table(spark, sf, "played_for").filter("to_club_id IS NOT NULL").groupBy("to_club_id").agg(F.countDistinct("from_player_id").alias("n")).filter("n >= 3")
    return n.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.count("*").alias("communities"))


@query("multi_club_players", "SELECT from_player_id, count(DISTINCT to_club_id)::BIGINT AS clubs FROM played_for WHERE from_player_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT to_club_id) >= 4")
def multi_club_players(spark: SparkSession, sf: str) -> DataFrame:
    """Players of four or more different clubs."""
    return table(spark, sf, "played_for").filter("from_player_id IS NOT NULL").groupBy("from_player_id").agg(F.countDistinct("to_club_id").alias("clubs")).filter("clubs >= 4")


@query(
    "baseline_counts",
    "SELECT 'players' AS name, count(*)::BIGINT AS n FROM player_parsed UNION ALL SELECT 'clubs', count(*)::BIGINT FROM club_parsed UNION ALL SELECT 'coaches', count(*)::BIGINT FROM coach_parsed UNION ALL SELECT 'relations', count(*)::BIGINT FROM relation",
)
def baseline_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the base tables."""
    return stats.tagged_counts({"players": table(spark, sf, "player_parsed"), "clubs": table(spark, sf, "club_parsed"), "coaches": table(spark, sf, "coach_parsed"), "relations": table(spark, sf, "relation")})


@query(
    "enrichment_quality",
    """SELECT count(*)::BIGINT AS mentions, count(wiki_id)::BIGINT AS linked, count(DISTINCT (lower(text), entity_type))::BIGINT AS different, round(count(wiki_id) / greatest(count(*), 1), 6) AS linking_rate,
      round(1 - count(DISTINCT (lower(text), entity_type)) / greatest(count(*), 1), 6) AS duplicate_rate, round(count(*) FILTER (confidence >= 0.85) / greatest(count(*), 1), 6) AS high_share, round(100.0 * count(wiki_id) / greatest((SELECT count(*) FROM player_parsed), 1), 6) AS growth FROM entity WHERE text IS NOT NULL AND entity_type IS NOT NULL""",
)
def enrichment_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Linking and duplicate rates, share of high confidence, and growth over the base in percent."""
    e = table(spark, sf, "entity").filter("text IS NOT NULL AND entity_type IS NOT NULL")
    different = F.countDistinct(F.lower("text"), F.col("entity_type"))
    q = e.agg(F.count("*").alias("mentions"), F.count("wiki_id").alias("linked"), different.alias("different"), F.count_if(F.col("confidence") >= 0.85).alias("high"))
    n = F.greatest("mentions", F.lit(1))
    base = table(spark, sf, "player_parsed").agg(F.count("*").alias("base"))
    return q.join(F.broadcast(base)).select(
        "mentions", "linked", "different", F.round(F.col("linked") / n, 6).alias("linking_rate"), F.round(1 - F.col("different") / n, 6).alias("duplicate_rate"),
        F.round(F.col("high") / n, 6).alias("high_share"), F.round(100.0 * F.col("linked") / F.greatest("base", F.lit(1)), 6).alias("growth"),
    )


@query(
    "data_quality",
    f"""WITH n AS ({NODES_SQL}), o AS (SELECT count(*) AS orphans FROM n WHERE id NOT IN (SELECT src FROM ({EDGES_SQL})) AND id NOT IN (SELECT dst FROM ({EDGES_SQL}))),
    q AS (SELECT count(*) FILTER (name IS NULL OR name = '') AS no_name, count(*) FILTER (position IS NULL OR position = '') AS no_position, count(*) FILTER (nationality IS NULL OR nationality = '') AS no_nationality FROM player_parsed),
    y AS (SELECT count(*) FILTER (from_year IS NULL) AS no_year FROM played_for)
    SELECT orphans::BIGINT AS orphans, no_name::BIGINT AS no_name, no_position::BIGINT AS no_position, no_nationality::BIGINT AS no_nationality, no_year::BIGINT AS no_year, greatest(0.0, round(100 - 100.0 * (orphans + no_name) / (SELECT count(*) FROM n), 6)) AS score FROM o, q, y""",
)
def data_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan nodes, missing fields and the score that follows from them."""
    n = nodes(spark, sf)
    ends = edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    o = n.join(ends, "id", "left_anti").agg(F.count("*").alias("orphans"))
    total = n.agg(F.count("*").alias("total"))
    empty = lambda c: F.count_if(F.col(c).isNull() | (F.col(c) == ""))
    q = table(spark, sf, "player_parsed").agg(empty("name").alias("no_name"), empty("position").alias("no_position"), empty("nationality").alias("no_nationality"))
    y = table(spark, sf, "played_for").agg(F.count_if(F.col("from_year").isNull()).alias("no_year"))
    score = F.greatest(F.lit(0.0), F.round(100 - F.try_divide(100.0 * (F.col("orphans") + F.col("no_name")), F.col("total")), 6))
    return o.join(F.broadcast(q)).join(F.broadcast(y)).join(F.broadcast(total)).select("orphans", "no_name", "no_position", "no_nationality", "no_year", score.alias("score"))


@query(
    "metadata_fields",
    "SELECT k AS field, count(*)::BIGINT AS n, arg_min(v, entity_id) AS sample FROM (SELECT entity_id, unnest(map_keys(metadata)) AS k, unnest(map_values(metadata)) AS v FROM entity) GROUP BY 1 HAVING count(*) >= 5",
)
def metadata_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Frequency of the keys of a map with the first value of each, keys in five rows or more."""
    e = table(spark, sf, "entity").select("entity_id", F.explode("metadata").alias("field", "v"))
    return e.groupBy("field").agg(F.count("*").alias("n"), F.min_by("v", "entity_id").alias("sample")).filter("n >= 5")


@query("edge_types_of_label", f"WITH e AS ({EDGES_SQL}) SELECT rel, count(*)::BIGINT AS n FROM e JOIN (SELECT DISTINCT wiki_id FROM club_parsed) c ON c.wiki_id = e.dst GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def edge_types_of_label(spark: SparkSession, sf: str) -> DataFrame:
    """Types of the edges that end at a club, most frequent first."""
    clubs = table(spark, sf, "club_parsed").select(F.col("wiki_id").alias("dst")).distinct()
    return edges(spark, sf).join(clubs, "dst", "left_semi").groupBy("rel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rel").limit(10)


@query("collected_texts", "SELECT entity_type, source, count(*)::BIGINT AS n, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean FROM documents WHERE length(text) >= 50 GROUP BY 1, 2")
def collected_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of 50 characters or more by type and source: number, characters, mean."""
    d = table(spark, sf, "documents").filter(F.length("text") >= 50)
    return d.groupBy("entity_type", "source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 6).alias("mean"))


SEARCH = "Ngong"


@query(
    "ranked_search",
    f"""SELECT id, name, CASE WHEN lower(name) = lower('{SEARCH}') THEN 0 WHEN starts_with(lower(name), lower('{SEARCH}')) THEN 1 ELSE 2 END AS rank FROM ({NODES_SQL}) WHERE contains(lower(name), lower('{SEARCH}')) ORDER BY 3, length(name), name, id LIMIT 10""",
)
def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """Search by part of a name: equal names first, then those that begin with it, then the rest, shorter first."""
    n, t = F.lower("name"), SEARCH.lower()
    rank = F.when(n == t, 0).when(n.startswith(t), 1).otherwise(2)
    return nodes(spark, sf).filter(n.contains(t)).select("id", "name", rank.alias("rank")).orderBy("rank", F.length("name"), "name", "id").limit(10)


@query("random_nodes", f"SELECT id FROM ({NODES_SQL}) ORDER BY md5(CAST(id AS VARCHAR) || '#1'), id LIMIT 100")
def random_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """A repeatable sample of a fixed size in hash order."""
    return nodes(spark, sf).select("id").orderBy(stats.hash_order(F.col("id"), "#1"), "id").limit(100)


@query("sampled_pairs", "SELECT edge_id FROM teammate WHERE substring(md5(CAST(edge_id AS VARCHAR) || '#2'), 1, 2) < '03'")
def sampled_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A repeatable sample of about one percent of the rows by hash."""
    return stats.hash_sample(table(spark, sf, "teammate"), F.col("edge_id"), "#2", "03").select("edge_id")


@query(
    "coach_and_player_teams",
    "SELECT to_club_id AS team FROM coached WHERE to_club_id IS NOT NULL UNION SELECT to_club_id FROM played_for WHERE to_club_id IS NOT NULL",
)
def coach_and_player_teams(spark: SparkSession, sf: str) -> DataFrame:
    """Union of two sets of teams."""
    a = table(spark, sf, "coached").select(F.col("to_club_id").alias("team"))
    return a.union(table(spark, sf, "played_for").select("to_club_id")).filter("team IS NOT NULL").distinct()


@query("clubs_without_players", "SELECT wiki_id FROM club_parsed WHERE wiki_id IS NOT NULL EXCEPT SELECT to_club_id FROM played_for")
def clubs_without_players(spark: SparkSession, sf: str) -> DataFrame:
    """Difference of two sets."""
    a = table(spark, sf, "club_parsed").select("wiki_id").filter("wiki_id IS NOT NULL")
    return a.distinct().join(table(spark, sf, "played_for").select(F.col("to_club_id").alias("wiki_id")), "wiki_id", "left_anti")


@query("clubs_of_both", "SELECT to_club_id FROM played_for WHERE to_club_id IS NOT NULL INTERSECT SELECT to_club_id FROM coached")
def clubs_of_both(spark: SparkSession, sf: str) -> DataFrame:
    """Intersection of two sets."""
    return table(spark, sf, "played_for").select("to_club_id").filter("to_club_id IS NOT NULL").intersect(table(spark, sf, "coached").select("to_club_id"))
