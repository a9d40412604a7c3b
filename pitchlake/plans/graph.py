"""Queries over the property graph: neighbourhoods, paths, algorithms, merges and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators import algorithms, graph
from pitchlake.plans.registry import query
from pitchlake.plans.stats import EDGES_SQL, NODES_SQL, edges, nodes
from pitchlake.session import checkpoint, table

ANCHORS_SQL = "SELECT DISTINCT player1_id AS id FROM teammate WHERE player1_id IS NOT NULL ORDER BY 1 LIMIT 5"
TEAM_SQL = "SELECT edge_id AS eid, player1_id AS src, player2_id AS dst FROM teammate WHERE player1_id IS NOT NULL AND player2_id IS NOT NULL"
PAIRS_SQL = f"SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM ({TEAM_SQL}) WHERE src <> dst"
LINKS_SQL = f"SELECT a AS id, b AS next FROM ({PAIRS_SQL}) UNION ALL SELECT b, a FROM ({PAIRS_SQL})"


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """The five first players with teammates: the start of the traversals (a parameter of these queries, not a sample of their data)."""
    return table(spark, sf, "teammate").filter("player1_id IS NOT NULL").select(F.col("player1_id").alias("id")).distinct().orderBy("id").limit(5)


def team(spark: SparkSession, sf: str) -> DataFrame:
    return edges(spark, sf).filter("rel = 'TEAMMATE'")


@query(
    "neighbours",
    f"WITH e AS ({EDGES_SQL}), s AS ({ANCHORS_SQL}) SELECT src AS anchor, eid, rel, dst AS other FROM e WHERE src IN (SELECT id FROM s) AND rel IN ('PLAYED_FOR', 'TEAMMATE') UNION ALL SELECT dst, eid, rel, src FROM e WHERE dst IN (SELECT id FROM s) AND rel IN ('PLAYED_FOR', 'TEAMMATE')",
)
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Edges at some nodes in both directions, of two types."""
    return graph.neighbours(edges(spark, sf), anchors(spark, sf), "both", ["PLAYED_FOR", "TEAMMATE"])


@query(
    "two_hops_capped",
    f"""WITH l AS (SELECT id, next FROM ({LINKS_SQL})), s AS ({ANCHORS_SQL}), o AS (SELECT anchor, via FROM (SELECT id AS anchor, next AS via, row_number() OVER (PARTITION BY id ORDER BY next) AS rn FROM l WHERE id IN (SELECT id FROM s)) WHERE rn <= 10)
    SELECT anchor, via, other FROM (SELECT o.anchor, o.via, l.next AS other, row_number() OVER (PARTITION BY o.anchor, o.via ORDER BY l.next) AS rn FROM o JOIN l ON l.id = o.via WHERE l.next <> o.anchor) WHERE rn <= 5""",
)
def two_hops_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Two-hop expansion with ten first and five second neighbours."""
    return graph.capped_two_hops(team(spark, sf), anchors(spark, sf), 10, 5)


DIST_SQL = f"""WITH RECURSIVE l AS ({LINKS_SQL}), s AS ({ANCHORS_SQL}), d(source, id, distance) AS (SELECT id, id, 0 FROM s UNION SELECT d.source, l.next, d.distance + 1 FROM d JOIN l ON l.id = d.id WHERE d.distance < 3)
SELECT source, id, min(distance)::INT AS distance FROM d GROUP BY 1, 2"""


@query("distances", DIST_SQL)
def distances(spark: SparkSession, sf: str) -> DataFrame:
    """Breadth-first distances up to three hops."""
    return graph.distances(team(spark, sf), anchors(spark, sf), 3)


ALL_SQL = f"""l AS ({LINKS_SQL}), d(source, id, distance) USING KEY (source, id) AS (SELECT id, id, 0 FROM (SELECT DISTINCT id FROM l) UNION SELECT f.source, l.next, f.distance + 1 FROM d f JOIN l ON l.id = f.id LEFT JOIN recurring.d k ON k.source = f.source AND k.id = l.next WHERE k.id IS NULL)"""


@query("path_lengths", f"WITH RECURSIVE {ALL_SQL} SELECT round(avg(distance), 6) AS mean, max(distance)::INT AS longest, count(*)::BIGINT AS pairs FROM d WHERE distance > 0")
def path_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and longest finite distance between all players of the teammate graph, from every node and without a cap on hops."""
    at = graph.path_counts(team(spark, sf))
    return at.agg(F.round(F.sum(F.col("distance") * F.col("pairs")) / F.sum("pairs"), 6).alias("mean"), F.max("distance").alias("longest"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


@query(
    "sampled_path_lengths",
    f"""WITH RECURSIVE l AS ({LINKS_SQL}), d(source, id, distance) USING KEY (source, id) AS (SELECT id, id, 0 FROM (SELECT DISTINCT id FROM l) WHERE substring(md5(CAST(id AS VARCHAR) || '#p'), 1, 2) < '03' UNION SELECT f.source, l.next, f.distance + 1 FROM d f JOIN l ON l.id = f.id LEFT JOIN recurring.d k ON k.source = f.source AND k.id = l.next WHERE k.id IS NULL AND f.distance < 15)
    SELECT round(avg(distance), 6) AS mean, max(distance)::INT AS longest, min(distance)::INT AS shortest, count(*)::BIGINT AS pairs FROM d WHERE distance > 0""",
)
def sampled_path_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """Distances of up to 15 hops from about one in a hundred players, drawn by hash, to all others (a sampling operator): for graphs on which all pairs are too many."""
    from pitchlake.operators import stats

    e = team(spark, sf).filter("src <> dst")
    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    at = graph.path_counts(e, sources=stats.hash_sample(ids, F.col("id"), "#p", "03"), most=15)
    return at.agg(F.round(F.sum(F.col("distance") * F.col("pairs")) / F.sum("pairs"), 6).alias("mean"), F.max("distance").alias("longest"), F.min("distance").alias("shortest"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


@query("k_hop_nodes", f"SELECT id, min(distance)::INT AS hops FROM ({DIST_SQL}) WHERE distance <= 2 GROUP BY 1")
def k_hop_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes within two hops of any start node."""
    return graph.distances(team(spark, sf), anchors(spark, sf), 2).groupBy("id").agg(F.min("distance").alias("hops"))


@query("induced_subgraph", f"WITH n AS (SELECT DISTINCT id FROM ({DIST_SQL}) WHERE distance <= 1) SELECT eid, src, dst FROM ({TEAM_SQL}) WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    """Edges among the nodes within one hop of the start nodes."""
    ids = graph.distances(team(spark, sf), anchors(spark, sf), 1).select("id").distinct()
    return graph.induced(team(spark, sf), ids).select("eid", "src", "dst")


@query("shortest_paths", f"SELECT source, id AS target, distance AS hops FROM ({DIST_SQL}) WHERE id IN (SELECT id FROM ({ANCHORS_SQL}))")
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Length of a shortest path between the start nodes, within three hops."""
    a = anchors(spark, sf)
    wanted = a.select(F.col("id").alias("source")).join(F.broadcast(a.select(F.col("id").alias("target"))))
    return graph.shortest_paths(team(spark, sf), wanted, 3).select("source", "target", "hops")


@query(
    "trails",
    f"""WITH RECURSIVE e AS ({TEAM_SQL}), l AS (SELECT eid, src, dst FROM e UNION ALL SELECT eid, dst, src FROM e), t(source, target, hops, eids) AS (SELECT id, id, 0, []::BIGINT[] FROM ({ANCHORS_SQL}) UNION ALL SELECT t.source, l.dst, t.hops + 1, list_append(t.eids, l.eid) FROM t JOIN l ON l.src = t.target WHERE t.hops < 2 AND NOT list_contains(t.eids, l.eid))
    SELECT source, target, hops::INT AS hops, eids FROM t WHERE hops > 0""",
)
def trails(spark: SparkSession, sf: str) -> DataFrame:
    """All trails of one or two teammate edges."""
    return graph.trails(team(spark, sf), anchors(spark, sf), 2)


def _pagerank_sql(rounds: int) -> str:
    parts = [f"l AS ({LINKS_SQL})", "d AS (SELECT id, count(*) AS degree FROM l GROUP BY 1)", "r0 AS (SELECT id, 1.0::DOUBLE AS score FROM d)"]
    parts += [f"r{i} AS (SELECT l.next AS id, 0.15 + 0.85 * sum(r.score / d.degree) AS score FROM l JOIN r{i - 1} r ON r.id = l.id JOIN d ON d.id = l.id GROUP BY 1)" for i in range(1, rounds + 1)]
    return f"WITH {', '.join(parts)} SELECT id, round(score, 6) AS score FROM r{rounds}"


@query("pagerank", _pagerank_sql(20))
def pagerank(spark: SparkSession, sf: str) -> DataFrame:
    """PageRank after the documented twenty rounds on the teammate graph."""
    return algorithms.pagerank(team(spark, sf), 20).select("id", F.round("score", 6).alias("score"))


@query("pagerank_of_best", f"SELECT id, score, round(score / max(score) OVER (), 6) AS of_best FROM ({_pagerank_sql(20)}) ORDER BY score DESC, id LIMIT 10")
def pagerank_of_best(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best scores and their ratio to the best."""
    top = pagerank(spark, sf).orderBy(F.desc("score"), "id").limit(10)
    return top.join(F.broadcast(top.agg(F.max("score").alias("best")))).select("id", "score", F.round(F.col("score") / F.col("best"), 6).alias("of_best"))


CLUSTER_SQL = f"""WITH p AS ({PAIRS_SQL}), l AS ({LINKS_SQL}), d AS (SELECT id, count(*) AS degree FROM l GROUP BY 1),
t AS (SELECT x.a, x.b, y.b AS c FROM p x JOIN p y ON x.b = y.a JOIN p z ON z.a = x.a AND z.b = y.b),
n AS (SELECT id, count(*) AS triangles FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY 1)
SELECT d.id, d.degree::BIGINT AS degree, coalesce(n.triangles, 0)::BIGINT AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6)::DOUBLE AS coefficient FROM d LEFT JOIN n ON n.id = d.id"""


@query("clustering", CLUSTER_SQL)
def clustering(spark: SparkSession, sf: str) -> DataFrame:
    """Degree, triangles and local clustering coefficient on the teammate graph."""
    return algorithms.clustering(team(spark, sf)).select("id", "degree", "triangles", F.round("coefficient", 6).alias("coefficient"))


@query(
    "small_world",
    f"WITH RECURSIVE {ALL_SQL} SELECT round(m.mean, 6) AS mean_path, round(c.cc, 6) AS mean_clustering, m.mean < 6 AND c.cc > 0.1 AS small_world FROM (SELECT avg(distance) AS mean FROM d WHERE distance > 0) m, (SELECT avg(coefficient) AS cc FROM ({CLUSTER_SQL}) WHERE coefficient > 0) c",
)
def small_world(spark: SparkSession, sf: str) -> DataFrame:
    """Small-world test of the whole teammate graph: the mean is over all pairs of ``path_lengths``."""
    e = checkpoint(graph.undirected(team(spark, sf))).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    m = graph.path_counts(e).agg((F.sum(F.col("distance") * F.col("pairs")) / F.sum("pairs")).alias("mean"))
    c = algorithms.clustering(e).select(F.round("coefficient", 6).alias("coefficient")).filter("coefficient > 0").agg(F.avg("coefficient").alias("cc"))
    return m.join(F.broadcast(c)).select(F.round("mean", 6).alias("mean_path"), F.round("cc", 6).alias("mean_clustering"), ((F.col("mean") < 6) & (F.col("cc") > 0.1)).alias("small_world"))


@query(
    "components",
    """WITH RECURSIVE e AS (SELECT DISTINCT from_coach_id AS a, to_club_id AS b FROM coached WHERE from_coach_id IS NOT NULL AND to_club_id IS NOT NULL), l AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(id, seen) AS (SELECT x, x FROM l UNION SELECT r.id, l.y FROM r JOIN l ON l.x = r.seen)
    SELECT id, min(seen) AS component FROM r GROUP BY 1""",
)
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components of coaches and clubs."""
    return algorithms.components(edges(spark, sf).filter("rel = 'COACHED'"))


@query("louvain_communities")
def louvain_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Communities of three and more players and clubs by modularity (tested on graphs with known communities)."""
    found = algorithms.louvain(edges(spark, sf).filter("rel IN ('PLAYED_FOR', 'TEAMMATE')"))
    return found.join(found.groupBy("community").agg(F.count("*").alias("n")).filter("n >= 3").select("community"), "community", "left_semi").select("id", "community")


@query(
    "node_upsert",
    """SELECT wiki_id, fetched_at, name, league FROM (SELECT wiki_id, name, league, fetched_at, row_number() OVER (PARTITION BY wiki_id ORDER BY fetched_at DESC NULLS LAST, name DESC NULLS LAST, league DESC NULLS LAST) AS rn FROM club_parsed WHERE wiki_id IS NOT NULL) WHERE rn = 1""",
)
def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Clubs after merging the later half of the loads into the earlier: the last version of each key."""
    c = table(spark, sf, "club_parsed").filter("wiki_id IS NOT NULL").select("wiki_id", "fetched_at", "name", "league")
    return graph.merge_last(c.filter("fetched_at < '2025-01-01'"), c.filter("NOT coalesce(fetched_at < '2025-01-01', false)"), ["wiki_id"], "fetched_at")


@query(
    "edge_upsert",
    "SELECT from_player_id, to_club_id, edge_id, from_year, to_year FROM (SELECT *, row_number() OVER (PARTITION BY from_player_id, to_club_id ORDER BY edge_id DESC) AS rn FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL) WHERE rn = 1",
)
def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """One edge per pair of nodes: the last row wins."""
    e = table(spark, sf, "played_for").filter("from_player_id IS NOT NULL AND to_club_id IS NOT NULL").select("from_player_id", "to_club_id", "edge_id", "from_year", "to_year")
    return graph.merge_last(e, e.limit(0), ["from_player_id", "to_club_id"], "edge_id")


@query("multi_edges", "SELECT DISTINCT from_player_id, to_club_id, from_year, to_year FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL")
def multi_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges whose key includes the years: several stints at a club stay."""
    return table(spark, sf, "played_for").filter("from_player_id IS NOT NULL AND to_club_id IS NOT NULL").select("from_player_id", "to_club_id", "from_year", "to_year").distinct()


@query("undirected_merge", PAIRS_SQL)
def undirected_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Undirected edges: one per unordered pair."""
    return graph.undirected(team(spark, sf))


@query(
    "merge_on_match",
    """WITH o AS (SELECT wiki_id, min(name) AS name, min(nationality) AS nationality FROM coach_parsed WHERE wiki_id IS NOT NULL GROUP BY 1), n AS (SELECT from_coach_id AS wiki_id, min(to_club_name) AS name, min(role) AS nationality FROM coached WHERE from_coach_id IS NOT NULL GROUP BY 1)
    SELECT coalesce(o.wiki_id, n.wiki_id) AS wiki_id, CASE WHEN o.wiki_id IS NULL THEN n.name ELSE o.name END AS name, CASE WHEN o.wiki_id IS NULL THEN n.nationality ELSE coalesce(n.nationality, o.nationality) END AS nationality, CASE WHEN o.wiki_id IS NULL THEN 'created' WHEN n.wiki_id IS NOT NULL THEN 'matched' ELSE 'kept' END AS action FROM o FULL JOIN n ON n.wiki_id = o.wiki_id""",
)
def merge_on_match(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional merge: created, matched and kept keys."""
    o = table(spark, sf, "coach_parsed").filter("wiki_id IS NOT NULL").groupBy("wiki_id").agg(F.min("name").alias("name"), F.min("nationality").alias("nationality"))
    n = table(spark, sf, "coached").filter("from_coach_id IS NOT NULL").groupBy(F.col("from_coach_id").alias("wiki_id")).agg(F.min("to_club_name").alias("name"), F.min("role").alias("nationality"))
    return graph.merge_on_match(o, n, "wiki_id", ["nationality"])


@query(
    "create_absent",
    """WITH o AS (SELECT DISTINCT from_player_id AS s, to_club_id AS d FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL), n AS (SELECT DISTINCT subject_wiki_id AS s, object_wiki_id AS d FROM relation WHERE predicate = 'PLAYED_FOR' AND subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL) SELECT s, d FROM o UNION SELECT s, d FROM n""",
)
def create_absent(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of the tables with those extracted from text that aren't there yet."""
    o = table(spark, sf, "played_for").select(F.col("from_player_id").alias("s"), F.col("to_club_id").alias("d")).dropna().distinct()
    n = table(spark, sf, "relation").filter("predicate = 'PLAYED_FOR'").select(F.col("subject_wiki_id").alias("s"), F.col("object_wiki_id").alias("d")).dropna()
    return graph.create_absent(o, n, ["s", "d"])


@query("detach_delete", f"WITH n AS (SELECT id FROM ({NODES_SQL}) WHERE label = 'Coach') SELECT eid, rel FROM ({EDGES_SQL}) WHERE src NOT IN (SELECT id FROM n) AND dst NOT IN (SELECT id FROM n)")
def detach_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Edges left after a label's nodes are deleted with their edges."""
    return graph.detach_delete(nodes(spark, sf), edges(spark, sf), F.col("label") == "Coach")[1].select("eid", "rel")


@query("provenance_delete", "SELECT relation_id FROM relation WHERE source IS DISTINCT FROM 'zero_shot' AND confidence >= 0.5")
def provenance_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Relations left after deleting those of one source and those of low confidence."""
    return table(spark, sf, "relation").filter(~F.col("source").eqNullSafe("zero_shot") & (F.col("confidence") >= 0.5)).select("relation_id")


@query(
    "verified_relations",
    """WITH e AS (SELECT DISTINCT from_player_id AS s, to_club_id AS d FROM played_for), b AS (SELECT DISTINCT s, d FROM e UNION SELECT from_coach_id, to_club_id FROM coached)
    SELECT r.relation_id, CASE WHEN r.predicate = 'PLAYED_FOR' AND EXISTS (SELECT 1 FROM e WHERE e.s = r.subject_wiki_id AND e.d = r.object_wiki_id) THEN 0.95 WHEN EXISTS (SELECT 1 FROM b WHERE b.s = r.subject_wiki_id AND b.d = r.object_wiki_id) THEN 0.9 ELSE 0.1 END::DOUBLE AS belief FROM relation r WHERE r.subject_wiki_id IS NOT NULL AND r.object_wiki_id IS NOT NULL""",
)
def verified_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Facts from text verified against the graph: an edge of the type, any edge, none."""
    e = table(spark, sf, "played_for").select(F.col("from_player_id").alias("s"), F.col("to_club_id").alias("d")).dropna().distinct()
    c = table(spark, sf, "coached").select(F.col("from_coach_id").alias("s"), F.col("to_club_id").alias("d")).dropna()
    found = e.withColumn("typed", F.lit(1)).unionByName(c.distinct().withColumn("typed", F.lit(0))).groupBy("s", "d").agg(F.max("typed").alias("typed"))
    r = table(spark, sf, "relation").select("relation_id", "predicate", F.col("subject_wiki_id").alias("s"), F.col("object_wiki_id").alias("d")).dropna(subset=["s", "d"])
    belief = F.when((F.col("predicate") == "PLAYED_FOR") & (F.col("typed") == 1), 0.95).when(F.col("typed").isNotNull(), 0.9).otherwise(0.1)
    return r.join(found, ["s", "d"], "left").select("relation_id", belief.alias("belief"))


@query(
    "teammate_checks",
    """WITH m AS (SELECT DISTINCT from_player_id AS p, to_club_id AS g FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL), t AS (SELECT DISTINCT player1_id AS a, player2_id AS b FROM teammate WHERE player1_id IS NOT NULL AND player2_id IS NOT NULL)
    SELECT t.a, t.b, EXISTS (SELECT 1 FROM m x JOIN m y ON x.g = y.g WHERE x.p = t.a AND y.p = t.b) AS same_club FROM t""",
)
def teammate_checks(spark: SparkSession, sf: str) -> DataFrame:
    """For each teammate pair whether both played for a common club."""
    m = table(spark, sf, "played_for").select(F.col("from_player_id").alias("p"), F.col("to_club_id").alias("g")).dropna().distinct()
    t = table(spark, sf, "teammate").select(F.col("player1_id").alias("a"), F.col("player2_id").alias("b")).dropna().distinct()
    both = t.join(m.withColumnRenamed("p", "a"), "a").join(m.withColumnRenamed("p", "b"), ["b", "g"]).select("a", "b").distinct().withColumn("same_club", F.lit(True))
    return t.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("same_club", F.lit(False)).alias("same_club"))


@query(
    "club_province_players",
    """WITH g AS (SELECT DISTINCT c.wiki_id AS club, p.name AS province FROM club_parsed c JOIN provinces_reference p ON contains(' ' || lower(c.ground) || ' ', ' ' || lower(p.name) || ' ')), b AS (SELECT DISTINCT wiki_id, place_of_birth FROM player_parsed WHERE place_of_birth IS NOT NULL)
    SELECT DISTINCT f.from_player_id AS player, g.club, g.province FROM played_for f JOIN g ON g.club = f.to_club_id JOIN b ON b.wiki_id = f.from_player_id AND b.place_of_birth = g.province""",
)
def club_province_players(spark: SparkSession, sf: str) -> DataFrame:
    """Three hops: players of a club in the province of their birth."""
    from pitchlake.plans.edges import club_in_province

    g = club_in_province(spark, sf).select(F.col("wiki_id").alias("club"), "province").distinct()
    b = table(spark, sf, "player_parsed").select(F.col("wiki_id").alias("player"), F.col("place_of_birth").alias("province")).dropna().distinct()
    f = table(spark, sf, "played_for").select(F.col("from_player_id").alias("player"), F.col("to_club_id").alias("club")).dropna().distinct()
    return f.join(g, "club").join(b, ["player", "province"]).select("player", "club", "province")


@query("isolated_nodes", f"SELECT id, label FROM ({NODES_SQL}) WHERE id NOT IN (SELECT src FROM ({EDGES_SQL})) AND id NOT IN (SELECT dst FROM ({EDGES_SQL}))")
def isolated_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes without any edge."""
    e = edges(spark, sf)
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    return nodes(spark, sf).join(ends, "id", "left_anti").select("id", "label")


@query(
    "left_outer_degrees",
    """SELECT c.wiki_id, count(DISTINCT p.from_player_id)::BIGINT AS players, count(DISTINCT k.from_coach_id)::BIGINT AS coaches FROM (SELECT DISTINCT wiki_id FROM club_parsed WHERE wiki_id IS NOT NULL) c LEFT JOIN played_for p ON p.to_club_id = c.wiki_id LEFT JOIN coached k ON k.to_club_id = c.wiki_id GROUP BY 1""",
)
def left_outer_degrees(spark: SparkSession, sf: str) -> DataFrame:
    """Players and coaches of every club, clubs without any included; each side is counted before it is joined."""
    c = table(spark, sf, "club_parsed").select("wiki_id").filter("wiki_id IS NOT NULL").distinct()
    p = table(spark, sf, "played_for").groupBy(F.col("to_club_id").alias("wiki_id")).agg(F.countDistinct("from_player_id").alias("players"))
    k = table(spark, sf, "coached").groupBy(F.col("to_club_id").alias("wiki_id")).agg(F.countDistinct("from_coach_id").alias("coaches"))
    return c.join(p, "wiki_id", "left").join(k, "wiki_id", "left").fillna(0, ["players", "coaches"]).select("wiki_id", "players", "coaches")


def _draw(key: Column, turn: Column) -> Column:
    """A number from a hash of a key and a turn, the same in every engine with MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", key.cast("string"), turn.cast("string"))), 1, 8), 16, 10).cast("bigint")


def free_clubs(asked: DataFrame, key: str, m: DataFrame, clubs: DataFrame, most: int) -> DataFrame:
    """(key, turn, club): ``most`` different clubs for each row of ``asked`` (key, player, and own: a club besides, or null) that aren't the player's, or all that remain where they are fewer.

    Clubs are numbered; a hash draws a rank among the numbers that remain, which is then shifted past the player's own
    numbers in order. So no draw fails, however many clubs a player has, and each club drawn counts as own for the next.
    """
    from pitchlake.operators.dedup import with_surrogate_ids

    numbered = with_surrogate_ids(clubs.select("club").filter("club IS NOT NULL").distinct(), ["club"], "no")
    size = numbered.agg(F.count("*").alias("size"))
    owned = m.join(numbered, "club").groupBy("player").agg(F.collect_set("no").alias("nos"))
    own = asked.join(numbered.select(F.col("club").alias("own"), F.col("no").alias("own_no")), "own", "left").join(owned, "player", "left").join(F.broadcast(size))
    none = F.array().cast("array<bigint>")
    taken = F.array_union(F.coalesce("nos", none), F.when(F.col("own_no").isNotNull(), F.array("own_no")).otherwise(none))

    def draw(state, turn):
        left = F.col("size") - F.size(state["taken"])
        rank = F.when(left > 0, _draw(F.col(key), turn) % left + 1)
        no = F.aggregate(F.array_sort(state["taken"]), rank, lambda x, o: F.when(o <= x, x + 1).otherwise(x))
        return F.when(left > 0, F.struct(F.concat(state["taken"], F.array(no)).alias("taken"), F.concat(state["drawn"], F.array(no)).alias("drawn"))).otherwise(state)

    drawn = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.struct(taken.alias("taken"), none.alias("drawn")), draw, lambda s: s["drawn"])
    return own.select(key, F.posexplode(drawn).alias("turn", "no")).join(numbered, "no").select(key, "turn", "club")


def free_sql(asked: str, key: str, clubs: str, most: int) -> str:
    """SQL of ``free_clubs``: each turn takes the element of a hashed rank from the list of the clubs that remain."""
    turns = []
    for t in range(1, most + 1):
        rank = f"(('0x' || substring(md5(CAST({key} AS VARCHAR) || '-{t}'), 1, 8))::BIGINT % greatest(len(free), 1) + 1)"
        turns.append(f"u{t} AS (SELECT {key}, list_filter(free, lambda x: x <> free[{rank}]) AS free, list_append(drawn, free[{rank}]) AS drawn FROM u{t - 1})")
    return f"""WITH cl AS ({clubs}), a AS ({asked}), mem AS (SELECT from_player_id AS player, list(DISTINCT to_club_id) AS own FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL GROUP BY 1), al AS (SELECT list_sort(list(DISTINCT club)) AS l FROM cl WHERE club IS NOT NULL),
    u0 AS (SELECT a.{key}, list_filter(al.l, lambda x: NOT list_contains(coalesce(mem.own, []), x) AND x IS DISTINCT FROM a.own) AS free, []::BIGINT[] AS drawn FROM a LEFT JOIN mem ON mem.player = a.player, al), {', '.join(turns)}
    SELECT {key}, unnest(list_filter(drawn, lambda x: x IS NOT NULL)) AS club FROM u{most}"""


@query(
    "false_memberships",
    free_sql("SELECT DISTINCT from_player_id AS player, NULL::BIGINT AS own FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL", "player", "SELECT wiki_id AS club FROM club_parsed", 1),
)
def false_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """A club that each player never played for, drawn by hash: a negative sample without a cross product. Only a player of all clubs has no row."""
    clubs = table(spark, sf, "club_parsed").select(F.col("wiki_id").alias("club"))
    m = table(spark, sf, "played_for").select(F.col("from_player_id").alias("player"), F.col("to_club_id").alias("club")).dropna().distinct()
    players = m.select("player").distinct().withColumn("own", F.lit(None).cast(m.schema["club"].dataType))
    return free_clubs(players, "player", m, clubs, 1).select("player", "club")
