"""Queries that answer, generate and evaluate questions over the graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.operators import stats
from pitchlake.plans.cleaning import birth_provinces
from pitchlake.plans.edges import club_in_province
from pitchlake.plans.registry import ORACLE, query
from pitchlake.session import materialize, table

PLAYED_SQL = "SELECT DISTINCT from_player_id AS player, to_club_id AS club FROM played_for WHERE from_player_id IS NOT NULL AND to_club_id IS NOT NULL"
COACHED_SQL = "SELECT DISTINCT from_coach_id AS coach, to_club_id AS club FROM coached WHERE from_coach_id IS NOT NULL AND to_club_id IS NOT NULL"
BORN_SQL = f"SELECT DISTINCT wiki_id AS player, first_listed AS province FROM ({ORACLE['birth_provinces']}) WHERE wiki_id IS NOT NULL"
BASED_SQL = f"SELECT DISTINCT wiki_id AS club, province FROM ({ORACLE['club_in_province']})"
NATIONAL_SQL = "SELECT DISTINCT wiki_id AS player, h.club_name AS team FROM (SELECT wiki_id, unnest(national_team_history) AS h FROM player_parsed WHERE wiki_id IS NOT NULL) WHERE h.club_name IS NOT NULL"
POSITION_SQL = "SELECT DISTINCT q.wiki_id AS player, r.position_code AS code FROM player_parsed q JOIN positions_reference r ON lower(trim(q.position)) = lower(r.position_name_vi) WHERE q.wiki_id IS NOT NULL"
TEAM_PAIRS_SQL = "SELECT DISTINCT player1_id AS a, player2_id AS b FROM teammate WHERE player1_id IS NOT NULL AND player2_id IS NOT NULL"


def _pairs_of(df: DataFrame, a: str, b: str, names: tuple[str, str]) -> DataFrame:
    return df.select(F.col(a).alias(names[0]), F.col(b).alias(names[1])).dropna().distinct()


def played(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs_of(table(spark, sf, "played_for"), "from_player_id", "to_club_id", ("player", "club"))


def coached(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs_of(table(spark, sf, "coached"), "from_coach_id", "to_club_id", ("coach", "club"))


def born(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs_of(birth_provinces(spark, sf), "wiki_id", "first_listed", ("player", "province"))


def based(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs_of(club_in_province(spark, sf), "wiki_id", "province", ("club", "province"))


def national(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "player_parsed").select("wiki_id", F.explode("national_team_history").alias("h"))
    return _pairs_of(p.select("wiki_id", F.col("h.club_name").alias("team")), "wiki_id", "team", ("player", "team"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "positions_reference").select("position_code", F.lower("position_name_vi").alias("k"))
    p = table(spark, sf, "player_parsed").select("wiki_id", F.lower(F.trim("position")).alias("k")).join(F.broadcast(r), "k")
    return _pairs_of(p, "wiki_id", "position_code", ("player", "code"))


_LOOKUPS = (
    ("clubs of player", "player", "club", PLAYED_SQL, played), ("players of club", "club", "player", PLAYED_SQL, played), ("clubs of coach", "coach", "club", COACHED_SQL, coached), ("province of player", "player", "province", BORN_SQL, born),
    ("players of province", "province", "player", BORN_SQL, born), ("province of club", "club", "province", BASED_SQL, based), ("teams of player", "player", "team", NATIONAL_SQL, national), ("position of player", "player", "code", POSITION_SQL, positions),
)


@query("graph_lookups", " UNION ALL ".join(f"SELECT '{n}' AS lookup, CAST({k} AS VARCHAR) AS key, CAST({v} AS VARCHAR) AS value FROM ({sql})" for n, k, v, sql, _ in _LOOKUPS))
def graph_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """The lookups of one hop that questions need, as (lookup, key, value)."""
    return reduce(DataFrame.unionByName, [f(spark, sf).select(F.lit(n).alias("lookup"), F.col(k).cast("string").alias("key"), F.col(v).cast("string").alias("value")) for n, k, v, _, f in _LOOKUPS])


ASKED_SQL = f"{TEAM_PAIRS_SQL} UNION SELECT x.from_player_id, y.from_player_id FROM played_for x JOIN played_for y ON y.edge_id = x.edge_id + 1 WHERE x.from_player_id <> y.from_player_id"


def asked_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b): teammates, and pairs of players of consecutive stints, who mostly share nothing."""
    e = table(spark, sf, "played_for").select("edge_id", F.col("from_player_id").alias("a"))
    other = e.select((F.col("edge_id") - 1).alias("edge_id"), F.col("a").alias("b"))
    shifted = e.join(other, "edge_id").filter("a <> b").select("a", "b")
    return _pairs_of(table(spark, sf, "teammate"), "player1_id", "player2_id", ("a", "b")).unionByName(shifted).distinct()


PAIR_SQL = f"""WITH q AS ({ASKED_SQL}), pl AS ({PLAYED_SQL}), bo AS ({BORN_SQL}), ba AS ({BASED_SQL}), na AS ({NATIONAL_SQL}), t AS (SELECT a, b FROM ({TEAM_PAIRS_SQL}) UNION SELECT b, a FROM ({TEAM_PAIRS_SQL})),
c AS (SELECT q.a, q.b, min(x.club) AS shared_club FROM q JOIN pl x ON x.player = q.a JOIN pl y ON y.player = q.b AND y.club = x.club GROUP BY 1, 2),
v AS (SELECT q.a, q.b, min(x.club) AS club_there FROM q JOIN pl x ON x.player = q.a JOIN ba ON ba.club = x.club JOIN bo ON bo.player = q.b AND bo.province = ba.province GROUP BY 1, 2),
h AS (SELECT DISTINCT q.a, q.b FROM q JOIN bo x ON x.player = q.a JOIN bo y ON y.player = q.b AND y.province = x.province),
n AS (SELECT DISTINCT q.a, q.b FROM q JOIN na x ON x.player = q.a JOIN na y ON y.player = q.b AND y.team = x.team)
SELECT q.a, q.b, t.a IS NOT NULL AS direct, c.shared_club, v.club_there, h.a IS NOT NULL AS same_home, n.a IS NOT NULL AS same_team,
CASE WHEN t.a IS NOT NULL THEN 'direct' WHEN c.a IS NOT NULL THEN 'same club' END AS teammates, CASE WHEN v.a IS NOT NULL THEN 'club in home' WHEN h.a IS NOT NULL THEN 'same home' END AS province,
c.a IS NOT NULL AND h.a IS NOT NULL AS club_and_home, c.a IS NOT NULL AND h.a IS NULL AS club_not_home
FROM q LEFT JOIN t ON t.a = q.a AND t.b = q.b LEFT JOIN c ON c.a = q.a AND c.b = q.b LEFT JOIN v ON v.a = q.a AND v.b = q.b LEFT JOIN h ON h.a = q.a AND h.b = q.b LEFT JOIN n ON n.a = q.a AND n.b = q.b"""


@query("pair_checks", PAIR_SQL)
def pair_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What two players share: teammates directly or by a club, a club in the other's home province, home, national team.

    Each check joins the pairs with the memberships of one player and then with those of the other on both, so a club with
    very many players is no block of pairs.
    """
    q, p = asked_pairs(spark, sf), played(spark, sf)

    def both(memberships: DataFrame, value: str) -> DataFrame:
        return q.join(memberships.withColumnRenamed("player", "a"), "a").join(memberships.withColumnRenamed("player", "b"), ["b", value])

    t = _pairs_of(table(spark, sf, "teammate"), "player1_id", "player2_id", ("a", "b"))
    t = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("direct", F.lit(True))
    homes = born(spark, sf)
    c = both(p, "club").groupBy("a", "b").agg(F.min("club").alias("shared_club"))
    v = q.join(p.withColumnRenamed("player", "a"), "a").join(based(spark, sf), "club").join(homes.withColumnRenamed("player", "b"), ["b", "province"]).groupBy("a", "b").agg(F.min("club").alias("club_there"))
    h = both(homes, "province").select("a", "b").distinct().withColumn("same_home", F.lit(True))
    n = both(national(spark, sf), "team").select("a", "b").distinct().withColumn("same_team", F.lit(True))
    out = q
    for part in (t, c, v, h, n):
        out = out.join(part, ["a", "b"], "left")
    out = out.fillna(False, ["direct", "same_home", "same_team"])
    club = F.col("shared_club").isNotNull()
    return out.select(
        "a", "b", "direct", "shared_club", "club_there", "same_home", "same_team", F.when(F.col("direct"), "direct").when(club, "same club").alias("teammates"),
        F.when(F.col("club_there").isNotNull(), "club in home").when(F.col("same_home"), "same home").alias("province"), (club & F.col("same_home")).alias("club_and_home"), (club & ~F.col("same_home")).alias("club_not_home"),
    )


_TURN = "('0x' || substring(md5(CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR)), 1, 2))::INT % 4"


@query(
    "yes_no_answers",
    f"""SELECT a, b, kind, CASE WHEN yes THEN 'Có' ELSE 'Không' END AS answer, CASE WHEN yes THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM (SELECT a, b, ['same club', 'teammates', 'club in home', 'same home'][{_TURN} + 1] AS kind,
    [shared_club IS NOT NULL, teammates IS NOT NULL, club_there IS NOT NULL, province IS NOT NULL][{_TURN} + 1] AS yes FROM ({PAIR_SQL}))
    UNION ALL SELECT f.a, f.b, 'played for', CASE WHEN p.player IS NOT NULL THEN 'Có' ELSE 'Không' END, CASE WHEN p.player IS NOT NULL THEN 0.95 ELSE 0.9 END FROM (SELECT DISTINCT x.from_player_id AS a, y.to_club_id AS b FROM played_for x JOIN played_for y ON y.edge_id = x.edge_id + 1 WHERE x.from_player_id IS NOT NULL AND y.to_club_id IS NOT NULL) f
      LEFT JOIN ({PLAYED_SQL}) p ON p.player = f.a AND p.club = f.b
    UNION ALL SELECT f.player, NULL, 'national team', CASE WHEN n.player IS NOT NULL THEN 'Có' ELSE 'Không' END, CASE WHEN n.player IS NOT NULL THEN 0.95 ELSE 0.9 END FROM (SELECT DISTINCT player FROM ({PLAYED_SQL})) f LEFT JOIN (SELECT DISTINCT player FROM ({NATIONAL_SQL})) n ON n.player = f.player""",
)
def yes_no_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers to yes-or-no questions by the rule of their kind, with the rule's confidence: a question of one of four kinds per pair, of memberships and of national teams."""
    turn = F.conv(F.substring(F.md5(F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string"))), 1, 2), 16, 10).cast("int") % 4
    asked = pair_checks(spark, sf).select("a", "b", turn.alias("t"), F.array(F.col("shared_club").isNotNull(), F.col("teammates").isNotNull(), F.col("club_there").isNotNull(), F.col("province").isNotNull()).alias("holds"))
    kinds = F.array(*[F.lit(k) for k in ("same club", "teammates", "club in home", "same home")])
    pairs = asked.select("a", "b", F.get(kinds, F.col("t")).alias("kind"), F.get("holds", F.col("t")).alias("yes"), F.lit(0.85).alias("no"))
    e = table(spark, sf, "played_for").select("edge_id", F.col("from_player_id").alias("a"), F.col("to_club_id").alias("b"))
    clubs = e.select("edge_id", "a").join(e.select((F.col("edge_id") - 1).alias("edge_id"), "b"), "edge_id").select("a", "b").dropna().distinct()
    p = played(spark, sf).select(F.col("player").alias("a"), F.col("club").alias("b"), F.lit(True).alias("yes"))
    member = clubs.join(p, ["a", "b"], "left").select("a", "b", F.lit("played for").alias("kind"), F.coalesce("yes", F.lit(False)).alias("yes"), F.lit(0.9).alias("no"))
    teams = national(spark, sf).select(F.col("player").alias("a"), F.lit(True).alias("yes")).distinct()
    single = p.select("a").distinct().join(teams, "a", "left").select("a", F.lit(None).cast("bigint").alias("b"), F.lit("national team").alias("kind"), F.coalesce("yes", F.lit(False)).alias("yes"), F.lit(0.9).alias("no"))
    out = pairs.unionByName(member).unionByName(single)
    return out.select("a", "b", "kind", F.when(F.col("yes"), "Có").otherwise("Không").alias("answer"), F.when(F.col("yes"), 0.95).otherwise(F.col("no")).alias("confidence"))


# Words that show that a national team is meant.
GATE_WORDS = ("đội tuyển", "đt ", "tuyển", "u-", "u2")


@query(
    "gated_teams",
    f"""SELECT r.relation_id, coalesce(n.wiki_id, CASE WHEN {' OR '.join(f"contains(lower(r.object_text), '{w}')" for w in GATE_WORDS)} THEN (SELECT min(wiki_id) FROM national_team_parsed WHERE contains(lower(name), 'đội tuyển')) END) AS team_id
    FROM relation r LEFT JOIN (SELECT lower(name) AS k, min(wiki_id) AS wiki_id FROM national_team_parsed GROUP BY 1) n ON n.k = lower(trim(r.object_text, ' ')) WHERE r.object_type = 'NATIONAL_TEAM'""",
)
def gated_teams(spark: SparkSession, sf: str) -> DataFrame:
    """National team of a mention: by its exact name, else the first team of the list where a keyword shows that one is meant, else none."""
    t = table(spark, sf, "national_team_parsed")
    exact = t.groupBy(F.lower("name").alias("k")).agg(F.min("wiki_id").alias("wiki_id"))
    first = t.filter(F.contains(F.lower("name"), F.lit("đội tuyển"))).agg(F.min("wiki_id").alias("first"))
    r = table(spark, sf, "relation").filter("object_type = 'NATIONAL_TEAM'").withColumn("k", F.lower(F.trim("object_text")))
    found = r.join(F.broadcast(exact), "k", "left").join(F.broadcast(first))
    return found.select("relation_id", F.coalesce("wiki_id", F.when(X.contains_any(F.col("object_text"), GATE_WORDS), F.col("first"))).alias("team_id"))


@query(
    "guarded_memberships",
    f"""WITH m AS (SELECT DISTINCT p.player, lower(c.name) AS club FROM ({PLAYED_SQL}) p JOIN club_parsed c ON c.wiki_id = p.club WHERE c.name IS NOT NULL), pr AS (SELECT lower(name) AS p FROM provinces_reference)
    SELECT r.relation_id, coalesce(bool_or(m.club = lower(r.object_text) OR ((contains(m.club, lower(r.object_text)) OR contains(lower(r.object_text), m.club)) AND NOT EXISTS (SELECT 1 FROM pr WHERE contains(lower(r.object_text), p) AND NOT contains(m.club, p)))), false) AS played
    FROM relation r LEFT JOIN m ON m.player = r.subject_wiki_id WHERE r.predicate = 'PLAYED_FOR' AND r.subject_wiki_id IS NOT NULL AND r.object_text IS NOT NULL AND r.object_text <> '' GROUP BY 1""",
)
def guarded_memberships(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a player played for a club by names: equal, or one holds the other, and a province that the asked name holds stands in the club's, too."""
    names = table(spark, sf, "club_parsed").filter("name IS NOT NULL").select(F.col("wiki_id").alias("club"), F.lower("name").alias("name")).distinct()
    m = played(spark, sf).join(names, "club").select(F.col("player").alias("subject_wiki_id"), F.col("name").alias("club")).distinct()
    places = [r["name"].lower() for r in table(spark, sf, "provinces_reference").collect()]  # a list of fixed size
    r = table(spark, sf, "relation").filter("predicate = 'PLAYED_FOR' AND subject_wiki_id IS NOT NULL AND object_text <> ''").select("relation_id", "subject_wiki_id", F.lower("object_text").alias("asked"))
    # the provinces are looked for once a mention, not once a pair
    r = r.withColumn("places", F.array_compact(F.array(*[F.when(F.contains("asked", F.lit(p)), F.lit(p)) for p in places])))
    inside = F.contains("club", "asked") | F.contains("asked", "club")
    fits = (F.col("club") == F.col("asked")) | (inside & F.forall("places", lambda p: F.contains("club", p)))
    return r.join(m, "subject_wiki_id", "left").groupBy("relation_id").agg(F.coalesce(F.max(fits), F.lit(False)).alias("played"))


_NAMES_SQL = "SELECT wiki_id AS id, min(name) AS name FROM {t} WHERE wiki_id IS NOT NULL AND name IS NOT NULL GROUP BY 1"
_EDGE_FACTS = """SELECT '{kind}' AS kind, {hops} AS hops, e.edge_id AS fid, e.s AS sid, s.name AS s, o.name AS o, [w1.name, w2.name, w3.name] AS others FROM e{kind} e JOIN ({subjects}) s ON s.id = e.s JOIN ({objects}) o ON o.id = e.o
LEFT JOIN e{kind} x1 ON x1.edge_id = e.edge_id + 1 LEFT JOIN ({objects}) w1 ON w1.id = x1.o LEFT JOIN e{kind} x2 ON x2.edge_id = e.edge_id + 2 LEFT JOIN ({objects}) w2 ON w2.id = x2.o LEFT JOIN e{kind} x3 ON x3.edge_id = e.edge_id + 3 LEFT JOIN ({objects}) w3 ON w3.id = x3.o"""
_LIST_FACTS = """SELECT '{kind}' AS kind, {hops} AS hops, f.player AS fid, f.player AS sid, s.name AS s, f.v AS o, [{others}] AS others FROM ({facts}) f JOIN ({subjects}) s ON s.id = f.player JOIN v{kind} l ON l.v = f.v"""
#: (kind, hops, statement, question, of several) of the facts that questions are made of.
KINDS = {
    "played": (1, "{} từng chơi cho {}.", "{} có từng chơi cho {} không?", "{} từng chơi cho đội nào?"), "coached": (1, "{} từng dẫn dắt {}.", "{} có từng dẫn dắt {} không?", "{} từng dẫn dắt đội nào?"),
    "teammate": (1, "{} là đồng đội của {}.", "{} có phải đồng đội của {} không?", "Ai là đồng đội của {}?"), "born": (1, "{} quê ở {}.", "{} có quê ở {} không?", "{} quê ở đâu?"),
    "national": (1, "{} từng khoác áo {}.", "{} có từng khoác áo {} không?", "{} từng khoác áo đội tuyển nào?"), "position": (1, "{} chơi ở vị trí {}.", "{} có chơi ở vị trí {} không?", "{} chơi ở vị trí nào?"),
    "based": (1, "{} đặt tại {}.", "{} có đặt tại {} không?", "{} đặt tại đâu?"),
    "home_club": (3, "{} từng chơi cho một đội ở quê của {}.", "{} có từng chơi cho một đội ở quê của {} không?", "{} từng chơi cho một đội ở quê của ai?"),
    "club_province": (2, "{} từng chơi cho một đội ở {}.", "{} có từng chơi cho một đội ở {} không?", "{} từng chơi cho một đội ở tỉnh nào?"),
}
_EDGES = {"played": ("played_for", "from_player_id", "to_club_id", "player_parsed", "club_parsed"), "coached": ("coached", "from_coach_id", "to_club_id", "coach_parsed", "club_parsed"), "teammate": ("teammate", "player1_id", "player2_id", "player_parsed", "player_parsed")}
_PROVINCES_SQL = f"SELECT p.player, b.province AS v FROM ({PLAYED_SQL}) p JOIN ({BASED_SQL}) b ON b.club = p.club"
_LISTS = {"born": (f"SELECT player, province AS v FROM ({BORN_SQL})", "SELECT name AS v, province_id AS no FROM provinces_reference"), "national": (f"SELECT player, team AS v FROM ({NATIONAL_SQL})", "SELECT name AS v, row_number() OVER (ORDER BY wiki_id) AS no FROM national_team_parsed"),
          "position": (f"SELECT player, code AS v FROM ({POSITION_SQL})", "SELECT position_code AS v, row_number() OVER (ORDER BY position_id) AS no FROM positions_reference"), "club_province": (f"SELECT DISTINCT player, v FROM ({_PROVINCES_SQL})", "SELECT name AS v, province_id AS no FROM provinces_reference"), "based": (f"SELECT club AS player, province AS v FROM ({BASED_SQL})", "SELECT name AS v, province_id AS no FROM provinces_reference")}


def _facts_sql() -> str:
    ctes, parts = [], []
    for kind, (t, s, o, subjects, objects) in _EDGES.items():
        ctes.append(f"e{kind} AS (SELECT edge_id, {s} AS s, {o} AS o FROM {t} WHERE {s} IS NOT NULL AND {o} IS NOT NULL)")
        parts.append(_EDGE_FACTS.format(kind=kind, hops=KINDS[kind][0], subjects=_NAMES_SQL.format(t=subjects), objects=_NAMES_SQL.format(t=objects)))
    for kind, (facts, values) in _LISTS.items():
        ctes.append(f"v{kind} AS ({values})")
        size = f"(SELECT count(*) FROM v{kind})"
        others = ", ".join(f"(SELECT min(w.v) FROM v{kind} w WHERE w.no = (l.no - 1 + {i}) % {size} + 1)" for i in (1, 2, 3))
        parts.append(_LIST_FACTS.format(kind=kind, hops=KINDS[kind][0], facts=facts, others=others, subjects=_NAMES_SQL.format(t="club_parsed" if kind == "based" else "player_parsed")))
    names = _NAMES_SQL.format(t="player_parsed")
    ctes += [f"hp AS ({PAIR_SQL})", f"hn AS ({names})", "hx AS (SELECT hp.a, list_sort(list(DISTINCT hn.name))[1:3] AS others FROM hp JOIN hn ON hn.id = hp.b WHERE hp.club_there IS NULL GROUP BY 1)"]
    parts.append(f"SELECT 'home_club', {KINDS['home_club'][0]}, hp.a, hp.a, s.name, o.name, coalesce(hx.others, []) FROM hp JOIN hn s ON s.id = hp.a JOIN hn o ON o.id = hp.b LEFT JOIN hx ON hx.a = hp.a WHERE hp.club_there IS NOT NULL")
    return f"WITH {', '.join(ctes)}, f AS ({' UNION ALL '.join(parts)}), t AS (SELECT kind, sid, list(DISTINCT o) AS truth FROM f GROUP BY 1, 2) SELECT f.kind, f.hops, f.fid, f.s, f.o, list_sort(list_filter(list_distinct(f.others), lambda w: w IS NOT NULL AND w <> f.s AND NOT list_contains(t.truth, w))) AS wrong FROM f JOIN t ON t.kind = f.kind AND t.sid = f.sid"


def _edge_facts(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    t, s, o, subjects, objects = _EDGES[kind]
    names = lambda name: table(spark, sf, name).filter("wiki_id IS NOT NULL AND name IS NOT NULL").groupBy("wiki_id").agg(F.min("name").alias("name"))
    e = table(spark, sf, t).filter(F.col(s).isNotNull() & F.col(o).isNotNull()).select("edge_id", F.col(s).alias("sid"), F.col(o).alias("oid"))
    named = e.join(names(objects).select(F.col("wiki_id").alias("oid"), F.col("name").alias("o")), "oid").select("edge_id", "sid", "o")
    # the objects of the three edges that follow: every edge gives its object to the three before it
    given = named.select(F.explode(F.array(*[F.col("edge_id") - i for i in (1, 2, 3)])).alias("edge_id"), F.col("o").alias("other")).groupBy("edge_id").agg(F.collect_set("other").alias("others"))
    named = named.join(names(subjects).select(F.col("wiki_id").alias("sid"), F.col("name").alias("s")), "sid").join(given, "edge_id", "left")
    return named.select(F.lit(kind).alias("kind"), F.lit(KINDS[kind][0]).alias("hops"), F.col("edge_id").alias("fid"), "sid", "s", "o", F.coalesce("others", F.array().cast("array<string>")).alias("others"))


def _list_facts(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    places = [r["name"] for r in table(spark, sf, "provinces_reference").orderBy("province_id").collect()]  # lists of fixed size
    if kind == "based":
        facts, values = based(spark, sf).select(F.col("club").alias("player"), F.col("province").alias("o")), places
    elif kind == "born":
        facts, values = born(spark, sf).withColumnRenamed("province", "o"), places
    elif kind == "national":
        facts, values = national(spark, sf).withColumnRenamed("team", "o"), [r["name"] for r in table(spark, sf, "national_team_parsed").orderBy("wiki_id").collect()]
    elif kind == "position":
        facts, values = positions(spark, sf).withColumnRenamed("code", "o"), [r["position_code"] for r in table(spark, sf, "positions_reference").orderBy("position_id").collect()]
    else:
        facts, values = played(spark, sf).join(based(spark, sf), "club").select("player", F.col("province").alias("o")).distinct(), places
    following = spark.createDataFrame([(v, [values[(i + n) % len(values)] for n in (1, 2, 3)]) for i, v in enumerate(values)], "o string, others array<string>")
    subjects = table(spark, sf, "club_parsed" if kind == "based" else "player_parsed")
    names = subjects.filter("wiki_id IS NOT NULL AND name IS NOT NULL").groupBy(F.col("wiki_id").alias("player")).agg(F.min("name").alias("s"))
    found = facts.join(F.broadcast(following), "o").join(names, "player")
    return found.select(F.lit(kind).alias("kind"), F.lit(KINDS[kind][0]).alias("hops"), F.col("player").alias("fid"), F.col("player").alias("sid"), "s", "o", "others")


def _pair_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of three hops: a player of a club in the home province of another; the others are up to three pairs of the player for which that doesn't hold."""
    names = table(spark, sf, "player_parsed").filter("wiki_id IS NOT NULL AND name IS NOT NULL").groupBy("wiki_id").agg(F.min("name").alias("name"))
    named = lambda i, c: names.select(F.col("wiki_id").alias(i), F.col("name").alias(c))
    pairs = materialize(pair_checks(spark, sf).select("a", "b", F.col("club_there").isNotNull().alias("holds")).join(named("b", "o"), "b"), "pairs")
    others = pairs.filter("NOT holds").groupBy("a").agg(F.slice(F.array_sort(F.collect_set("o")), 1, 3).alias("others"))
    found = pairs.filter("holds").join(named("a", "s"), "a").join(others, "a", "left")
    return found.select(F.lit("home_club").alias("kind"), F.lit(KINDS["home_club"][0]).alias("hops"), F.col("a").alias("fid"), F.col("a").alias("sid"), "s", "o", F.coalesce("others", F.array().cast("array<string>")).alias("others"))


def question_facts(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, hops, fid, s, o, wrong): facts with a subject, an object and up to three objects that aren't the subject's."""
    f = materialize(reduce(DataFrame.unionByName, [*[_edge_facts(spark, sf, k) for k in _EDGES], *[_list_facts(spark, sf, k) for k in _LISTS], _pair_facts(spark, sf)]), "facts")
    truth = f.groupBy("kind", "sid").agg(F.collect_set("o").alias("truth"))  # the different objects of one subject
    wrong = F.array_sort(F.filter(F.array_except("others", "truth"), lambda w: w != F.col("s")))
    return f.join(truth, ["kind", "sid"]).select("kind", "hops", "fid", "s", "o", wrong.alias("wrong"))


#: (type, answer, how many) of the strata of a set of 200 questions: 40 % statements, 30 % questions, 30 % choices.
STRATA = (("TF", "true", 40), ("TF", "false", 40), ("YN", "yes", 30), ("YN", "no", 30), ("MCQ", "choice", 60))


def _filled(template: str, s: Column, o: Column) -> Column:
    parts = template.split("{}")
    return F.concat(*[x for i, p in enumerate(parts) for x in ((F.lit(p),) if i == 0 else ((s if i == 1 else o), F.lit(p)))])


def _filled_sql(template: str, o: str) -> str:
    parts = template.split("{}")
    return " || ".join(x for i, p in enumerate(parts) for x in ((f"'{p}'",) if i == 0 else (("s" if i == 1 else o), f"'{p}'")))


def _by_kind_sql(which: int, o: str) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {_filled_sql(v[which], o)}" for k, v in KINDS.items()) + " END"


BANK_SQL = f"""WITH f AS ({_facts_sql()}), q AS (
SELECT *, 'TF' AS type, 'true' AS answer, o AS shown FROM f UNION ALL SELECT *, 'TF', 'false', wrong[1] FROM f WHERE len(wrong) > 0 UNION ALL SELECT *, 'YN', 'yes', o FROM f UNION ALL SELECT *, 'YN', 'no', wrong[1] FROM f WHERE len(wrong) > 0 UNION ALL SELECT *, 'MCQ', 'choice', o FROM f WHERE len(wrong) > 0),
r AS (SELECT *, md5(type || answer || kind || CAST(fid AS VARCHAR) || o) AS h FROM q), k AS (SELECT *, row_number() OVER (PARTITION BY type, answer ORDER BY h, kind, fid, o) AS rn FROM r)
SELECT row_number() OVER (ORDER BY md5(h || '#n'), kind, fid, o)::INT AS no, type, kind, hops::INT AS hops, CASE WHEN type = 'MCQ' THEN o ELSE answer END AS answer, s AS subject, shown AS object, CASE type WHEN 'TF' THEN {_by_kind_sql(1, 'shown')} WHEN 'YN' THEN {_by_kind_sql(2, 'shown')} ELSE {_by_kind_sql(3, "''")} END AS question,
CASE WHEN type = 'MCQ' THEN list_sort(list_append(wrong, o)) END AS choices FROM k WHERE rn <= CASE type WHEN 'TF' THEN 40 WHEN 'YN' THEN 30 ELSE 60 END"""


@query("question_bank", BANK_SQL)
def question_bank(spark: SparkSession, sf: str) -> DataFrame:
    """A balanced set of 200 questions: true and false statements, yes-or-no questions, choices of up to four; over nine kinds of facts of one to three hops, shuffled and numbered.

    A false object is drawn among those that aren't the subject's, so no negative has to be rejected; each stratum keeps the
    first by hash.
    """
    return bank(question_facts(spark, sf))


def bank(f: DataFrame) -> DataFrame:
    """The question set of facts (kind, hops, fid, s, o, wrong)."""
    some = F.size("wrong") > 0
    variants = F.array(
        F.struct(F.lit("TF").alias("type"), F.lit("true").alias("answer"), F.col("o").alias("shown")), F.when(some, F.struct(F.lit("TF").alias("type"), F.lit("false").alias("answer"), F.get("wrong", F.lit(0)).alias("shown"))),
        F.struct(F.lit("YN").alias("type"), F.lit("yes").alias("answer"), F.col("o").alias("shown")), F.when(some, F.struct(F.lit("YN").alias("type"), F.lit("no").alias("answer"), F.get("wrong", F.lit(0)).alias("shown"))),
        F.when(some, F.struct(F.lit("MCQ").alias("type"), F.lit("choice").alias("answer"), F.col("o").alias("shown"))),
    )
    q = f.select("*", F.inline(F.array_compact(variants)))
    q = q.withColumn("h", F.md5(F.concat("type", "answer", "kind", F.col("fid").cast("string"), "o"))).withColumn("stratum", F.concat("type", "answer"))
    picked = stats.top_per_group(q, "stratum", [F.col(c) for c in ("h", "kind", "fid", "o")], max(n for _, _, n in STRATA))
    order = Window.partitionBy("stratum").orderBy("h", "kind", "fid", "o")
    wanted = F.lit(0)
    for t, a, n in STRATA:
        wanted = F.when(F.col("stratum") == t + a, n).otherwise(wanted)
    picked = picked.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= wanted)  # of at most 60 a stratum
    text = F.lit(None).cast("string")
    for k, v in KINDS.items():
        shown = F.when(F.col("type") == "TF", _filled(v[1], F.col("s"), F.col("shown"))).when(F.col("type") == "YN", _filled(v[2], F.col("s"), F.col("shown"))).otherwise(_filled(v[3], F.col("s"), F.lit("")))
        text = F.when(F.col("kind") == k, shown).otherwise(text)
    no = F.row_number().over(Window.orderBy(F.md5(F.concat("h", F.lit("#n"))), "kind", "fid", "o"))  # of the set's 200 rows
    choice = F.col("type") == "MCQ"
    return picked.select(no.alias("no"), "type", "kind", "hops", F.when(choice, F.col("o")).otherwise(F.col("answer")).alias("answer"), F.col("s").alias("subject"), F.col("shown").alias("object"), text.alias("question"), F.when(choice, F.array_sort(F.concat("wrong", F.array("o")))).alias("choices"))


@query(
    "bank_accuracy",
    f"""WITH b AS ({BANK_SQL}), r AS (SELECT DISTINCT lower(subject_text) AS s, lower(object_text) AS o FROM relation WHERE subject_text IS NOT NULL AND object_text IS NOT NULL),
    a AS (SELECT b.*, CASE WHEN b.type = 'TF' THEN CASE WHEN r.s IS NOT NULL THEN 'true' ELSE 'false' END ELSE CASE WHEN r.s IS NOT NULL THEN 'yes' ELSE 'no' END END AS given FROM b LEFT JOIN r ON r.s = lower(b.subject) AND r.o = lower(b.object) WHERE b.type <> 'MCQ')
    SELECT type, hops, kind, answer, count(*)::BIGINT AS n, round(avg((given = answer)::INT), 6) AS accuracy FROM a GROUP BY GROUPING SETS ((type), (hops), (kind), (answer), ())""",
)
def bank_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """How well relations from text alone answer the questions of the set: accuracy by type, hops, kind, expected answer and in all."""
    b = question_bank(spark, sf).filter("type <> 'MCQ'").withColumn("k", F.lower("subject")).withColumn("l", F.lower("object"))
    r = table(spark, sf, "relation").select(F.lower("subject_text").alias("k"), F.lower("object_text").alias("l")).dropna().distinct().withColumn("there", F.lit(True))
    given = F.when(F.col("type") == "TF", F.when(F.col("there"), "Đúng.").otherwise("Sai.")).otherwise(F.when(F.col("there"), "Có.").otherwise("Không."))
    a = r.join(F.broadcast(b), ["k", "l"], "right").withColumn("ok", X.answers_match(given, F.col("answer")).cast("int"))
    return stats.grouped_sets(a, [["type"], ["hops"], ["kind"], ["answer"], []], F.count("*").alias("n"), F.round(F.avg("ok"), 6).alias("accuracy"))


@query(
    "existence_checks",
    f"""WITH f AS ({_facts_sql()}), asked AS (SELECT DISTINCT kind, s, o FROM f UNION SELECT DISTINCT kind, s, wrong[1] FROM f WHERE len(wrong) > 0), n AS (SELECT DISTINCT kind, s, o FROM f)
    SELECT a.kind, a.s, a.o, n.s IS NOT NULL AS holds FROM asked a LEFT JOIN n ON n.kind = a.kind AND n.s = a.s AND n.o = a.o""",
)
def existence_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a fact holds by the names of its ends, for nine kinds of facts: every fact, and one that its subject hasn't."""
    f = question_facts(spark, sf)
    known = f.select("kind", "s", "o").distinct()
    asked = known.unionByName(f.select("kind", "s", F.get("wrong", F.lit(0)).alias("o")).filter("o IS NOT NULL")).distinct()
    return asked.join(known.withColumn("holds", F.lit(True)), ["kind", "s", "o"], "left").select("kind", "s", "o", F.coalesce("holds", F.lit(False)).alias("holds"))


@query(
    "missing_locations",
    f"SELECT club, province FROM ({BASED_SQL}) EXCEPT SELECT c.wiki_id, p.name FROM club_parsed c JOIN provinces_reference p ON c.ground IN ('Sân ' || p.name, 'Sân vận động ' || p.name)",
)
def missing_locations(spark: SparkSession, sf: str) -> DataFrame:
    """Edges from club to province that its ground's name implies and that the graph, which takes exact names, lacks."""
    p = table(spark, sf, "provinces_reference").select(F.col("name").alias("province"), F.explode(F.array(F.concat(F.lit("Sân "), "name"), F.concat(F.lit("Sân vận động "), "name"))).alias("ground"))
    there = table(spark, sf, "club_parsed").select(F.col("wiki_id").alias("club"), "ground").join(F.broadcast(p), "ground").select("club", "province")
    return based(spark, sf).join(there, ["club", "province"], "left_anti")
