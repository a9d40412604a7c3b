"""Queries that derive edges: lookups, interval joins, shared groups, deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions.text import birth_year
from pitchlake.operators import dedup, intervals, lookup
from pitchlake.plans.registry import query
from pitchlake.session import table

STINTS_SQL = """
SELECT o_custkey AS person, l_partkey AS part, nullif(min(year(o_orderdate)), 1995)::INT AS from_year, nullif(max(year(o_orderdate)), 2001)::INT AS to_year,
  count(*)::BIGINT AS appearances, sum(l_quantity)::BIGINT AS goals
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2"""


def stints(spark: SparkSession, sf: str) -> DataFrame:
    """Membership intervals of customers in parts: first and last year of their orders, open where the data begin or end."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    grouped = lines.join(orders, lines.l_orderkey == orders.o_orderkey).groupBy(F.col("o_custkey").alias("person"), F.col("l_partkey").alias("part"))
    return grouped.agg(
        F.nullif(F.min("y"), F.lit(1995)).alias("from_year"), F.nullif(F.max("y"), F.lit(2001)).alias("to_year"),
        F.count("*").alias("appearances"), F.sum("l_quantity").cast("bigint").alias("goals"),
    )


@query("stints", STINTS_SQL)
def stints_query(spark: SparkSession, sf: str) -> DataFrame:
    """Membership intervals."""
    return stints(spark, sf)


@query(
    "top_teammates",
    f"""WITH s AS (SELECT person, part, coalesce(from_year, 1900) AS a, coalesce(to_year, 2025) AS b FROM ({STINTS_SQL})),
    p AS (SELECT DISTINCT x.person AS p1, y.person AS p2 FROM s x JOIN s y ON x.part = y.part AND x.person < y.person AND x.a <= y.b AND y.a <= x.b)
    SELECT person, count(*)::BIGINT AS teammates FROM (SELECT p1 AS person FROM p UNION ALL SELECT p2 FROM p) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
)
def top_teammates(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty persons with the most different teammates: overlapping membership of a group."""
    pairs = intervals.overlapping_pairs(stints(spark, sf), "person", "part", "from_year", "to_year")
    both = pairs.select(F.explode(F.array("p1", "p2")).alias("person"))
    return both.groupBy("person").agg(F.count("*").alias("teammates")).orderBy(F.desc("teammates"), "person").limit(20)


BOUNDS_SQL = "coalesce(nullif(from_year, 0), 1900) AS a, coalesce(nullif(to_year, 0), 2025) AS b"


@query(
    "teammate_edges",
    f"""WITH s AS (SELECT edge_id, from_player_id AS p, to_club_id AS g, {BOUNDS_SQL} FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL),
    j AS (SELECT x.p AS p1, y.p AS p2, x.g AS to_club_id, greatest(x.a, y.a)::INT AS from_year, least(x.b, y.b)::INT AS to_year,
      row_number() OVER (PARTITION BY x.p, y.p, x.g ORDER BY x.edge_id, y.edge_id) AS rn FROM s x JOIN s y ON x.g = y.g AND x.p < y.p AND x.a <= y.b AND y.a <= x.b)
    SELECT p1, p2, to_club_id, from_year, to_year FROM j WHERE rn = 1""",
)
def teammate_edges(spark: SparkSession, sf: str) -> DataFrame:
    """TEAMMATE edges: players with overlapping stints at a club."""
    return intervals.interval_self_join(table(spark, sf, "played_for"), "from_player_id", "to_club_id", "from_year", "to_year", "edge_id")


@query(
    "national_teammate_edges",
    """WITH s AS (SELECT DISTINCT wiki_id, name FROM national_team_parsed), e AS (
      SELECT wiki_id AS p, h.club_name AS team, coalesce(nullif(h.from_year, 0), 1900) AS a, coalesce(nullif(h.to_year, 0), 2025) AS b, fetched_at, i
      FROM (SELECT wiki_id, fetched_at, unnest(national_team_history) AS h, generate_subscripts(national_team_history, 1) AS i FROM player_parsed WHERE wiki_id IS NOT NULL)),
    j AS (SELECT x.p AS p1, y.p AS p2, x.team, greatest(x.a, y.a)::INT AS from_year, least(x.b, y.b)::INT AS to_year, row_number() OVER (PARTITION BY x.p, y.p, x.team ORDER BY x.a, x.b, y.a, y.b) AS rn
      FROM (SELECT DISTINCT p, team, a, b FROM e WHERE team IS NOT NULL) x JOIN (SELECT DISTINCT p, team, a, b FROM e WHERE team IS NOT NULL) y ON x.team = y.team AND x.p < y.p AND x.a <= y.b AND y.a <= x.b)
    SELECT p1, p2, team, from_year, to_year FROM j WHERE rn = 1""",
)
def national_teammate_edges(spark: SparkSession, sf: str) -> DataFrame:
    """NATIONAL_TEAMMATE edges from the nested national-team histories."""
    p = table(spark, sf, "player_parsed").filter("wiki_id IS NOT NULL").select("wiki_id", F.explode("national_team_history").alias("h"))
    return intervals.hot_self_join(p.select("wiki_id", F.col("h.club_name").alias("team"), "h.from_year", "h.to_year"), "wiki_id", "team", "from_year", "to_year")


@query(
    "under_coach_edges",
    f"""WITH p AS (SELECT edge_id, from_player_id, to_club_id AS g, {BOUNDS_SQL} FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL),
    c AS (SELECT edge_id, from_coach_id, to_club_id AS g, {BOUNDS_SQL} FROM coached WHERE from_coach_id IS NOT NULL AND to_club_id IS NOT NULL),
    j AS (SELECT from_player_id, from_coach_id, p.g AS to_club_id, greatest(p.a, c.a)::INT AS from_year, least(p.b, c.b)::INT AS to_year, row_number() OVER (PARTITION BY from_player_id, from_coach_id, p.g ORDER BY p.edge_id, c.edge_id) AS rn
      FROM p JOIN c ON p.g = c.g AND p.a <= c.b AND c.a <= p.b)
    SELECT from_player_id, from_coach_id, to_club_id, from_year, to_year FROM j WHERE rn = 1""",
)
def under_coach_edges(spark: SparkSession, sf: str) -> DataFrame:
    """UNDER_COACH edges: player and coach with overlapping stints at a club."""
    return intervals.interval_join(table(spark, sf, "played_for"), "from_player_id", table(spark, sf, "coached"), "from_coach_id", "to_club_id", "from_year", "to_year", "edge_id", "edge_id")


@query(
    "played_same_clubs",
    """WITH m AS (SELECT DISTINCT from_player_id AS p, to_club_id AS g FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL)
    SELECT x.p AS p1, y.p AS p2, count(*)::BIGINT AS shared, string_agg(CAST(x.g AS VARCHAR), '|' ORDER BY CAST(x.g AS VARCHAR)) AS groups FROM m x JOIN m y ON x.g = y.g AND x.p < y.p GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def played_same_clubs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of players who share two clubs or more."""
    return intervals.shared_groups(table(spark, sf, "played_for"), "from_player_id", "to_club_id")


@query(
    "same_ground_clubs",
    """WITH m AS (SELECT DISTINCT wiki_id, ground FROM club_parsed WHERE ground IS NOT NULL AND wiki_id IS NOT NULL) SELECT a.wiki_id AS club1, b.wiki_id AS club2, a.ground FROM m a JOIN m b ON a.ground = b.ground AND a.wiki_id < b.wiki_id""",
)
def same_ground_clubs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of clubs of one group, here those that share a ground."""
    m = table(spark, sf, "club_parsed").filter("ground IS NOT NULL AND wiki_id IS NOT NULL").select("wiki_id", "ground").distinct()
    one, two = intervals.blocks(m.withColumnRenamed("wiki_id", "club1"), m.withColumnRenamed("wiki_id", "club2"), "ground", ["club1"])
    return one.join(two, ["ground", "_block"]).filter("club1 < club2").select("club1", "club2", "ground")


NAMES_SQL = "SELECT lower(trim(name)) AS k, min(wiki_id) AS club_id FROM club_parsed WHERE name IS NOT NULL GROUP BY 1"


@query(
    "membership_edges",
    f"""SELECT wiki_id, h.club_name AS club_name, h.from_year AS from_year, h.to_year AS to_year, n.club_id FROM (SELECT wiki_id, unnest(clubs_history) AS h FROM player_parsed) LEFT JOIN ({NAMES_SQL}) n ON n.k = lower(trim(h.club_name))""",
)
def membership_edges(spark: SparkSession, sf: str) -> DataFrame:
    """PLAYED_FOR edges from nested histories; clubs looked up by exact name, unmatched ones kept without an id."""
    e = table(spark, sf, "player_parsed").select("wiki_id", F.explode("clubs_history").alias("h")).select("wiki_id", "h.club_name", "h.from_year", "h.to_year")
    clubs = table(spark, sf, "club_parsed").select(F.col("name").alias("ref_name"), F.col("wiki_id").alias("club_id"))
    return lookup.exact_lookup(e, "club_name", clubs, "ref_name", "club_id")


@query(
    "ground_provinces",
    """WITH g AS (SELECT DISTINCT ground FROM club_parsed WHERE ground IS NOT NULL), p AS (SELECT province_id, lower(name) AS n FROM provinces_reference)
    SELECT ground, arg_min(province_id, row(-len, province_id)) AS province_id FROM (
      SELECT ground, province_id, length(n) AS len FROM g JOIN p ON contains(' ' || lower(ground) || ' ', ' ' || n || ' ')
      UNION ALL SELECT ground, province_id, length(ground) FROM g JOIN p ON contains(' ' || n || ' ', ' ' || lower(ground) || ' ')) GROUP BY 1""",
)
def ground_provinces(spark: SparkSession, sf: str) -> DataFrame:
    """Province of each ground by containment of names in either direction, without a nested loop."""
    g = table(spark, sf, "club_parsed").select("ground").filter("ground IS NOT NULL").distinct()
    return lookup.contained_lookup(g, "ground", "ground", table(spark, sf, "provinces_reference"), "name", "province_id")


@query(
    "club_in_province",
    """WITH g AS (SELECT DISTINCT wiki_id, ground FROM club_parsed WHERE ground IS NOT NULL AND wiki_id IS NOT NULL), p AS (SELECT province_id, name FROM provinces_reference)
    SELECT wiki_id, p.name AS province FROM g JOIN p ON contains(' ' || lower(ground) || ' ', ' ' || lower(p.name) || ' ')""",
)
def club_in_province(spark: SparkSession, sf: str) -> DataFrame:
    """BASED_IN edges derived in two steps: club to ground, ground to province; unmatched clubs are dropped."""
    clubs = table(spark, sf, "club_parsed").filter("ground IS NOT NULL AND wiki_id IS NOT NULL").select("wiki_id", "ground").distinct()
    provinces = table(spark, sf, "provinces_reference").select("province_id", F.col("name").alias("province"))
    g = clubs.select("ground").distinct()
    found = lookup.contained_lookup(g, "ground", "ground", provinces, "province", "province_id")
    return clubs.join(found, "ground").join(F.broadcast(provinces), "province_id").select("wiki_id", "province")


@query(
    "position_edges",
    """SELECT p.wiki_id, p.fetched_at, coalesce(r.position_code, lower(trim(p.position))) AS position_key FROM player_parsed p LEFT JOIN (SELECT lower(position_name) AS k, position_code FROM positions_reference UNION SELECT lower(position_name_vi), position_code FROM positions_reference UNION SELECT lower(position_code), position_code FROM positions_reference) r ON r.k = lower(trim(p.position)) WHERE p.position IS NOT NULL""",
)
def position_edges(spark: SparkSession, sf: str) -> DataFrame:
    """HAS_POSITION edges; a position that the list doesn't have stays its own key."""
    r = table(spark, sf, "positions_reference")
    keys = r.select("position_code", F.explode(F.array("position_name", "position_name_vi", "position_code")).alias("k")).select(F.lower("k").alias("k"), "position_code").distinct()
    p = table(spark, sf, "player_parsed").filter("position IS NOT NULL").withColumn("k", F.lower(F.trim("position")))
    return p.join(F.broadcast(keys), "k", "left").select("wiki_id", "fetched_at", F.coalesce("position_code", "k").alias("position_key"))


@query(
    "competition_edges",
    """WITH l AS (SELECT league, row_number() OVER (ORDER BY league)::BIGINT AS competition_id FROM (SELECT DISTINCT league FROM club_parsed WHERE league IS NOT NULL)) SELECT DISTINCT c.wiki_id, c.league, l.competition_id FROM club_parsed c LEFT JOIN l ON l.league = c.league""",
)
def competition_edges(spark: SparkSession, sf: str) -> DataFrame:
    """COMPETES_IN edges with surrogate ids of the different leagues; clubs without one are kept."""
    c = table(spark, sf, "club_parsed")
    leagues = dedup.with_surrogate_ids(c.select("league").filter("league IS NOT NULL").distinct(), ["league"], "competition_id")
    return c.select("wiki_id", "league").distinct().join(leagues, "league", "left").select("wiki_id", "league", "competition_id")


@query(
    "loadable_edges",
    """SELECT edge_id FROM played_for WHERE from_player_id IN (SELECT wiki_id FROM player_parsed) AND to_club_id IN (SELECT wiki_id FROM club_parsed)""",
)
def loadable_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with non-null keys whose end points both exist."""
    e = table(spark, sf, "played_for").dropna(subset=["from_player_id", "to_club_id"])
    e = e.join(table(spark, sf, "player_parsed").select(F.col("wiki_id").alias("from_player_id")), "from_player_id", "left_semi")
    return e.join(table(spark, sf, "club_parsed").select(F.col("wiki_id").alias("to_club_id")), "to_club_id", "left_semi").select("edge_id")


@query(
    "first_by_key",
    """SELECT * EXCLUDE (rn) FROM (SELECT name, date_of_birth, wiki_id, fetched_at, row_number() OVER (PARTITION BY name, date_of_birth ORDER BY wiki_id, fetched_at) AS rn FROM player_parsed) WHERE rn = 1""",
)
def first_by_key(spark: SparkSession, sf: str) -> DataFrame:
    """Keep-first deduplication on name and birth date; null keys are equal."""
    p = table(spark, sf, "player_parsed").select("name", "date_of_birth", "wiki_id", "fetched_at")
    return dedup.keep_first(p, ["name", "date_of_birth"], ["wiki_id", "fetched_at"])


@query(
    "most_complete_rows",
    """SELECT wiki_id, score, fetched_at FROM (SELECT wiki_id, fetched_at, score, row_number() OVER (PARTITION BY wiki_id ORDER BY score DESC, fetched_at) AS rn FROM (SELECT *, (CASE WHEN coalesce(length(trim(position)), 0) > 0 THEN 10 ELSE 0 END + CASE WHEN coalesce(length(trim(height)), 0) > 0 THEN 5 ELSE 0 END + CASE WHEN coalesce(length(trim(place_of_birth)), 0) > 0 THEN 3 ELSE 0 END + CASE WHEN coalesce(length(trim(full_name)), 0) > 0 THEN 2 ELSE 0 END)::INT AS score FROM player_parsed)) WHERE rn = 1""",
)
def most_complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The most complete row of each page by a weighted score, the earliest of equal ones."""
    score = dedup.completeness({"position": 10, "height": 5, "place_of_birth": 3, "full_name": 2})
    p = table(spark, sf, "player_parsed").select("wiki_id", score.alias("score"), "fetched_at")
    return dedup.keep_first(p, ["wiki_id"], [-F.col("score"), "fetched_at"])


@query(
    "canonical_names",
    """SELECT wiki_id, CASE WHEN n > 1 AND y IS NOT NULL THEN name || ' (' || y || ')' WHEN n > 1 THEN name || ' (#' || wiki_id || ')' ELSE name END AS canonical_name FROM (
      SELECT wiki_id, name, y, count(*) OVER (PARTITION BY name) AS n FROM (SELECT wiki_id, min(name) AS name, min(nullif(regexp_extract(date_of_birth, '([0-9]{4})', 1), '')) AS y FROM player_parsed WHERE name IS NOT NULL GROUP BY 1))""",
)
def canonical_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names made unique by year of birth or id where several pages share one."""
    year = F.min(F.nullif(F.regexp_extract("date_of_birth", "([0-9]{4})", 1), F.lit("")))
    p = table(spark, sf, "player_parsed").filter("name IS NOT NULL").groupBy("wiki_id").agg(F.min("name").alias("name"), year.alias("y"))
    return dedup.canonical_names(p, "name", "y", "wiki_id", "canonical_name").select("wiki_id", "canonical_name")


@query(
    "canonical_names_by_year",
    """SELECT wiki_id, CASE WHEN n > 1 AND y IS NOT NULL THEN name || ' (' || y || ')' WHEN n > 1 THEN name || ' (#' || wiki_id || ')' ELSE name END AS canonical_name FROM (SELECT wiki_id, name, y, count(*) OVER (PARTITION BY name) AS n FROM (SELECT wiki_id, min(name) AS name,
      min(CASE WHEN try_cast(regexp_extract(date_of_birth, '([0-9]{4})', 1) AS INT) BETWEEN 1940 AND 2010 THEN try_cast(regexp_extract(date_of_birth, '([0-9]{4})', 1) AS INT) END) AS y FROM player_parsed WHERE name IS NOT NULL GROUP BY 1))""",
)
def canonical_names_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Names made unique by the year of birth where it is plausible, else by the id."""
    p = table(spark, sf, "player_parsed").filter("name IS NOT NULL").groupBy("wiki_id").agg(F.min("name").alias("name"), F.min(birth_year(F.col("date_of_birth"))).alias("y"))
    return dedup.canonical_names(p, "name", "y", "wiki_id", "canonical_name").select("wiki_id", "canonical_name")


@query(
    "province_ids",
    """WITH f AS (SELECT DISTINCT p.name FROM provinces_reference p JOIN player_parsed q ON q.place_of_birth = p.name) SELECT p.name, row_number() OVER (ORDER BY (f.name IS NOT NULL) DESC, p.name)::BIGINT AS new_id FROM provinces_reference p LEFT JOIN f ON f.name = p.name""",
)
def province_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of a reference list: entries in use first, then by name."""
    used = table(spark, sf, "player_parsed").select(F.col("place_of_birth").alias("name")).filter("name IS NOT NULL").distinct().withColumn("used", F.lit(0))
    p = table(spark, sf, "provinces_reference").select("name").join(used, "name", "left").withColumn("used", F.coalesce("used", F.lit(1)))
    return dedup.with_surrogate_ids(p, ["used", "name"], "new_id").select("name", "new_id")


@query(
    "alias_lookup",
    """WITH a AS (SELECT lower(name) AS k, 1 AS pr, wiki_id FROM player_parsed WHERE name IS NOT NULL UNION SELECT lower(name), 2, wiki_id FROM club_parsed WHERE name IS NOT NULL UNION SELECT lower(name), 3, wiki_id FROM coach_parsed WHERE name IS NOT NULL
      UNION SELECT lower(ground), 4, wiki_id FROM club_parsed WHERE ground IS NOT NULL UNION SELECT lower(name), 5, province_id FROM provinces_reference WHERE name IS NOT NULL),
    b AS (SELECT k, arg_min(wiki_id, row(pr, wiki_id)) AS wiki_id, count(*)::BIGINT AS candidates FROM a GROUP BY 1) SELECT r.relation_id, b.wiki_id AS found_id, b.candidates FROM (SELECT relation_id, unnest([lower(subject_text), lower(object_text)]) AS k FROM relation) r JOIN b ON b.k = r.k""",
)
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Entity of each mention by its name with a priority of kinds: player, club, coach, ground, province."""
    sources = (("player_parsed", "name", "wiki_id"), ("club_parsed", "name", "wiki_id"), ("coach_parsed", "name", "wiki_id"), ("club_parsed", "ground", "wiki_id"), ("provinces_reference", "name", "province_id"))
    kinds = [table(spark, sf, t).filter(F.col(c).isNotNull()).select(F.lower(c).alias("k"), F.lit(i).alias("pr"), F.col(key).cast("bigint").alias("wiki_id")) for i, (t, c, key) in enumerate(sources, 1)]
    names = reduce(DataFrame.unionByName, kinds).distinct()
    best = names.groupBy("k").agg(F.min(F.struct("pr", "wiki_id")).alias("b"), F.count("*").alias("candidates"))
    r = table(spark, sf, "relation").select("relation_id", F.explode(F.array(F.lower("subject_text"), F.lower("object_text"))).alias("k"))
    return r.join(best, "k").select("relation_id", F.col("b.wiki_id").alias("found_id"), "candidates")


@query(
    "club_lookup",
    f"""WITH t AS (SELECT DISTINCT club_name FROM teammate WHERE club_name IS NOT NULL), n AS ({NAMES_SQL}),
    e AS (SELECT t.club_name, n.club_id FROM t LEFT JOIN n ON n.k = lower(trim(regexp_replace(t.club_name, '[ \t\r\n]+', ' ', 'g')))),
    c AS (SELECT club_name, arg_min(club_id, row(-len, club_id)) AS club_id FROM (
      SELECT e.club_name, r.wiki_id AS club_id, length(lower(r.name)) AS len FROM e JOIN (SELECT DISTINCT wiki_id, name FROM club_parsed WHERE name IS NOT NULL) r ON e.club_id IS NULL AND contains(' ' || lower(e.club_name) || ' ', ' ' || lower(r.name) || ' ')
      UNION ALL SELECT e.club_name, r.wiki_id, length(e.club_name) FROM e JOIN (SELECT DISTINCT wiki_id, name FROM club_parsed WHERE name IS NOT NULL) r ON e.club_id IS NULL AND contains(' ' || lower(r.name) || ' ', ' ' || lower(e.club_name) || ' ')) GROUP BY 1)
    SELECT e.club_name, coalesce(e.club_id, c.club_id, -1) AS club_id FROM e LEFT JOIN c ON c.club_name = e.club_name""",
)
def club_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Club of each spelling: exact name, else contained name, else -1."""
    names = table(spark, sf, "teammate").select("club_name").filter("club_name IS NOT NULL").distinct()
    clubs = table(spark, sf, "club_parsed").select(F.col("name").alias("ref_name"), F.col("wiki_id").alias("club_id"))
    return lookup.priority_lookup(names, "club_name", "club_name", clubs, "ref_name", "club_id", F.lit(-1).cast("bigint")).select("club_name", "club_id")


