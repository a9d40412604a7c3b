"""Queries of strict recognition, linking, validation and import of what texts tell."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.operators import similarity, stats, textops
from pitchlake.plans.projections import CLUB_PREFIXES
from pitchlake.plans.registry import query
from pitchlake.plans.stats import EDGES_SQL, edges
from pitchlake.plans.text import PATTERNS
from pitchlake.session import table

_KINDS = (("player_parsed", "PLAYER"), ("club_parsed", "CLUB"), ("coach_parsed", "COACH"), ("national_team_parsed", "NATIONAL_TEAM"))
_DICTIONARY_SQL = " UNION ALL ".join(f"SELECT lower(name) AS r, '{k}' AS kind, min(wiki_id) AS wiki_id FROM {t} WHERE name IS NOT NULL GROUP BY 1" for t, k in _KINDS)


def dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """(kind, name, wiki_id) of all kinds of entities: the least id of each folded name of a kind."""
    parts = [table(spark, sf, t).filter("name IS NOT NULL").groupBy(F.lower("name").alias("name")).agg(F.min("wiki_id").alias("wiki_id")).withColumn("kind", F.lit(k)) for t, k in _KINDS]
    return reduce(DataFrame.unionByName, parts)


#: Letters that a name needs to count, by kind.
LEAST_LETTERS = {"PLAYER": 5, "CLUB": 5, "COACH": 4, "NATIONAL_TEAM": 5}
_PLAIN_SQL = """' ' || regexp_replace(regexp_replace(lower({c}), '[,.;:!?()"]', ' ', 'g'), ' +', ' ', 'g') || ' '"""


@query(
    "strict_mentions",
    f"""WITH n AS (SELECT * FROM ({_DICTIONARY_SQL}) WHERE length(r) >= CASE kind WHEN 'COACH' THEN 4 ELSE 5 END), c AS (SELECT relation_id, {_PLAIN_SQL.format(c='context')} AS t FROM relation WHERE context IS NOT NULL)
    SELECT DISTINCT c.relation_id, n.kind, n.wiki_id FROM c JOIN n ON contains(c.t, ' ' || n.r || ' ')""",
)
def strict_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Known names of all kinds in each sentence, at word bounds and of a least length."""
    least = F.lit(0)
    for k, n in LEAST_LETTERS.items():
        least = F.when(F.col("kind") == k, n).otherwise(least)
    names = dictionary(spark, sf).filter(F.length("name") >= least)
    # of equal names every kind counts
    return textops.dictionary_mentions(table(spark, sf, "relation"), "relation_id", "context", names, "name", "wiki_id", ["kind"])


@query("recognised_entities")
def recognised_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Entities of each sentence: what patterns and the dictionary find, overlaps resolved (pattern before dictionary, longer first), linked by name.

    (Greedy resolution isn't SQL; tested on a small case and against slices of the text.)
    """
    r = table(spark, sf, "relation").filter("context IS NOT NULL").select("relation_id", "context")
    spans = r.select("relation_id", F.explode(textops.pattern_spans(F.col("context"), PATTERNS)).alias("s")).select("relation_id", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"), F.col("s.type").alias("kind"), F.lit(None).cast("bigint").alias("wiki_id"), F.lit(0).alias("priority"))
    found = textops.dictionary_spans(r, "relation_id", "context", dictionary(spark, sf), "name", ["kind", "wiki_id"]).withColumn("priority", F.lit(1))
    return textops.recognised(spans.unionByName(found), "relation_id", ["kind", "wiki_id"])


# Fixed values: (subject type, object type, trigger words, predicate, confidence) of relations by co-occurrence.
TRIGGERS = (
    ("PLAYER", "CLUB", ("thi đấu", "chơi cho", "khoác áo", "cầu thủ", "gia nhập", "chuyển sang"), "PLAYED_FOR", 0.75), ("PLAYER", "NATIONAL_TEAM", ("đội tuyển", "quốc gia", "khoác áo"), "PLAYED_FOR_NATIONAL", 0.8),
    ("CLUB", "CLUB", ("thắng", "thua", "hòa", "scored against"), "PLAYED_AGAINST", 0.7), ("COACH", "CLUB", ("huấn luyện", "dẫn dắt", "hlv"), "COACHED", 0.75), ("NATIONAL_TEAM", "CLUB", ("thắng", "thua", "hòa"), "PLAYED_AGAINST", 0.7),
)


@query(
    "triggered_relations",
    " UNION ALL ".join(
        f"SELECT relation_id, '{p}' AS found, {c}::DOUBLE AS confidence, left(context, 200) AS shown FROM relation WHERE subject_type = '{s}' AND object_type = '{o}' AND ({' OR '.join(f"contains(lower(context), '{w}')" for w in words)})"
        for s, o, words, p, c in TRIGGERS
    ),
)
def triggered_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by the types of two entities of a sentence and a trigger word in it."""
    r = table(spark, sf, "relation")
    found = F.lit(None).cast("struct<found:string,confidence:double>")
    for s, o, words, p, c in TRIGGERS:
        fits = (F.col("subject_type") == s) & (F.col("object_type") == o) & X.contains_any(F.col("context"), words)
        found = F.when(fits, F.struct(F.lit(p).alias("found"), F.lit(c).alias("confidence"))).otherwise(found)
    return r.withColumn("f", found).filter("f IS NOT NULL").select("relation_id", "f.found", "f.confidence", F.left("context", F.lit(200)).alias("shown"))


# Fixed values: (verb, predicate, confidence) of relations whose words stand in the order subject, verb, object.
ORDERED = (("thi đấu cho", "PLAYED_FOR", 0.95), ("dẫn dắt", "COACHED", 0.95), ("đeo băng đội trưởng", "CAPTAINED", 0.9))
NEAR = 100


@query(
    "ordered_relations",
    f"""SELECT relation_id, CASE {' '.join(f"WHEN v{i} > s AND v{i} < o THEN '{p}'" for i, (_, p, _) in enumerate(ORDERED))} ELSE 'RELATED' END AS found, CASE {' '.join(f"WHEN v{i} > s AND v{i} < o THEN {c}" for i, (_, _, c) in enumerate(ORDERED))} ELSE 0.6 END::DOUBLE AS confidence
    FROM (SELECT relation_id, strpos(lower(context), lower(subject_text)) AS s, strpos(lower(context), lower(object_text)) AS o, {', '.join(f"strpos(lower(context), '{v}') AS v{i}" for i, (v, _, _) in enumerate(ORDERED))} FROM relation WHERE subject_text <> '' AND object_text <> '')
    WHERE s > 0 AND o > 0 AND ({' OR '.join(f'(v{i} > s AND v{i} < o)' for i in range(len(ORDERED)))} OR abs(o - s) < {NEAR})""",
)
def ordered_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by the order of subject, verb and object in a sentence; without a verb those whose ends stand near each other."""
    r = table(spark, sf, "relation").filter("subject_text <> '' AND object_text <> ''")
    low = F.lower("context")
    at = r.select("relation_id", low.alias("c"), F.instr(low, F.lower("subject_text")).alias("s"), F.instr(low, F.lower("object_text")).alias("o")).filter("s > 0 AND o > 0")
    found = F.when(F.abs(F.col("o") - F.col("s")) < NEAR, F.struct(F.lit("RELATED").alias("found"), F.lit(0.6).alias("confidence")))
    for verb, predicate, confidence in reversed(ORDERED):
        v = F.locate(verb, F.col("c"))
        found = F.when((v > F.col("s")) & (v < F.col("o")), F.struct(F.lit(predicate).alias("found"), F.lit(confidence).alias("confidence"))).otherwise(found)
    return at.withColumn("f", found).filter("f IS NOT NULL").select("relation_id", "f.found", "f.confidence")


@query("best_similar_clubs")
def best_similar_clubs(spark: SparkSession, sf: str) -> DataFrame:
    """Each spelling of a club with the club name that is most similar, exact ones first, from a token-set similarity of 0.85 on.

    (Not in SQL; tested against brute force over all pairs.)
    """
    t = table(spark, sf, "teammate").select(F.col("club_name").alias("spelling")).filter("spelling IS NOT NULL").distinct()
    c = table(spark, sf, "club_parsed").select("name", "wiki_id")
    return similarity.best_match(t, "spelling", c, "name", "wiki_id", 0.85)


@query("similar_mentions")
def similar_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions deduplicated against the known names: equal or of a similarity of 0.9 and more to one. (Not in SQL; see ``best_similar_clubs``.)"""
    e = table(spark, sf, "entity").filter("entity_type = 'CLUB'").select("text").filter("text IS NOT NULL").distinct()
    return similarity.best_match(e, "text", table(spark, sf, "club_parsed").select("name", "wiki_id"), "name", "wiki_id", 0.9)


@query(
    "first_id_triples",
    "SELECT subject_wiki_id, predicate, object_wiki_id, min(relation_id) AS relation_id FROM relation WHERE subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL GROUP BY 1, 2, 3",
)
def first_id_triples(spark: SparkSession, sf: str) -> DataFrame:
    """Relations deduplicated by the ids of subject and object and the predicate: the first stays."""
    r = table(spark, sf, "relation").filter("subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL")
    return r.groupBy("subject_wiki_id", "predicate", "object_wiki_id").agg(F.min("relation_id").alias("relation_id"))


#: Ordered rules of the strict validator with the reason for which a relation is rejected.
_ENDS = {"PLAYED_FOR": ("PLAYER", "CLUB"), "CAPTAINED": ("PLAYER", "CLUB"), "TRANSFERRED_TO": ("PLAYER", "CLUB"), "SIGNED_WITH": ("PLAYER", "CLUB"), "DEFEATED": ("CLUB", "CLUB"), "LOST_TO": ("CLUB", "CLUB"), "DREW_WITH": ("CLUB", "CLUB"), "SCORED_AGAINST": ("PLAYER", "CLUB")}
_STRICT_SQL = f"""CASE WHEN coalesce(predicate, '') = '' THEN 'no predicate' WHEN coalesce(trim(subject_text, ' '), '') = '' OR coalesce(trim(object_text, ' '), '') = '' THEN 'no text' WHEN length(subject_text) < 4 OR length(object_text) < 4 THEN 'too short'
WHEN subject_wiki_id IS NULL THEN 'subject unknown' WHEN object_wiki_id IS NULL THEN 'object unknown' WHEN subject_wiki_id = object_wiki_id THEN 'same ends' WHEN NOT coalesce({' OR '.join(f"(predicate = '{p}' AND subject_type = '{s}' AND object_type = '{o}')" for p, (s, o) in _ENDS.items())}, false) THEN 'types' WHEN coalesce(confidence, 0) < 0.7 THEN 'confidence' ELSE 'accepted' END"""


@query("strict_rejections", f"SELECT reason, count(*)::BIGINT AS n FROM (SELECT {_STRICT_SQL} AS reason FROM relation) GROUP BY 1")
def strict_rejections(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by the first of eight ordered rules that rejects them, with the accepted ones."""
    return table(spark, sf, "relation").groupBy(strict_reason().alias("reason")).agg(F.count("*").alias("n"))


def strict_reason():
    """The first rule that rejects a relation, or ``accepted``."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    types = F.lit(False)
    for p, (s, o) in _ENDS.items():
        types = types | ((F.col("predicate") == p) & (F.col("subject_type") == s) & (F.col("object_type") == o))
    return (
        F.when(F.coalesce("predicate", F.lit("")) == "", "no predicate").when(blank("subject_text") | blank("object_text"), "no text").when((F.length("subject_text") < 4) | (F.length("object_text") < 4), "too short")
        .when(F.col("subject_wiki_id").isNull(), "subject unknown").when(F.col("object_wiki_id").isNull(), "object unknown").when(F.col("subject_wiki_id") == F.col("object_wiki_id"), "same ends")
        .when(~F.coalesce(types, F.lit(False)), "types").when(F.coalesce("confidence", F.lit(0.0)) < 0.7, "confidence").otherwise("accepted")
    )


_STRIPPED_SQL = "regexp_replace(lower(name), '^(câu lạc bộ|đội bóng|clb)[ ]+', '')"


@query(
    "matched_entities",
    f"""WITH k AS (SELECT lower(name) AS key, wiki_id, 0 AS ord FROM club_parsed WHERE name IS NOT NULL UNION ALL SELECT lower(full_name), wiki_id, 1 FROM club_parsed WHERE full_name IS NOT NULL UNION ALL SELECT {_STRIPPED_SQL}, wiki_id, 2 FROM club_parsed WHERE name IS NOT NULL UNION ALL SELECT 'wiki:' || wiki_id, wiki_id, 3 FROM club_parsed WHERE wiki_id IS NOT NULL),
    b AS (SELECT key, arg_min(wiki_id, row(ord, wiki_id)) AS wiki_id, min(ord) AS ord FROM k WHERE wiki_id IS NOT NULL GROUP BY 1), r AS (SELECT relation_id, unnest([lower(trim(object_text, ' ')), regexp_replace(lower(trim(object_text, ' ')), '^(câu lạc bộ|đội bóng|clb)[ ]+', ''), 'wiki:' || object_wiki_id]) AS key, unnest([0, 1, 2]) AS way FROM relation WHERE object_type = 'CLUB')
    SELECT r.relation_id, arg_min(b.wiki_id, row(r.way, b.ord)) AS found_id, min(r.way * 10 + b.ord)::INT AS rule FROM r JOIN b ON b.key = r.key GROUP BY 1""",
)
def matched_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Existing club of each mention by its keys: name, full name, name without prefix, wiki id; the first key that is known decides."""
    c = table(spark, sf, "club_parsed").filter("wiki_id IS NOT NULL")
    prefixes = [p.lower() for p in CLUB_PREFIXES]
    own = F.array(F.lower("name"), F.lower("full_name"), X.without_prefix(F.lower("name"), prefixes), F.concat(F.lit("wiki:"), F.col("wiki_id").cast("string")))
    keys = c.select("wiki_id", F.posexplode(own).alias("ord", "key")).filter("key IS NOT NULL").groupBy("key").agg(F.min(F.struct("ord", "wiki_id")).alias("b"))
    text = F.lower(F.trim("object_text"))
    asked = F.array(text, X.without_prefix(text, prefixes), F.concat(F.lit("wiki:"), F.col("object_wiki_id").cast("string")))
    r = table(spark, sf, "relation").filter("object_type = 'CLUB'").select("relation_id", F.posexplode(asked).alias("way", "key")).filter("key IS NOT NULL")
    best = r.join(keys, "key").groupBy("relation_id").agg(F.min(F.struct("way", F.col("b.ord").alias("ord"), F.col("b.wiki_id").alias("wiki_id"))).alias("m"))
    return best.select("relation_id", F.col("m.wiki_id").alias("found_id"), (F.col("m.way") * 10 + F.col("m.ord")).alias("rule"))


_PLAN_SQL = f"""WITH e AS (SELECT DISTINCT src, dst FROM ({EDGES_SQL})), r AS (SELECT *, {_STRICT_SQL} AS reason FROM relation), f AS (SELECT relation_id, row_number() OVER (PARTITION BY subject_wiki_id, predicate, object_wiki_id ORDER BY relation_id) AS rn FROM r WHERE reason = 'accepted')
SELECT r.relation_id, r.predicate, CASE WHEN r.reason <> 'accepted' THEN 'reject' WHEN f.rn > 1 THEN 'repeated' WHEN e.src IS NOT NULL THEN 'keep' ELSE 'create' END AS action FROM r LEFT JOIN f ON f.relation_id = r.relation_id LEFT JOIN e ON e.src = r.subject_wiki_id AND e.dst = r.object_wiki_id"""


@query("pending_changes", f"SELECT predicate, action, count(*)::BIGINT AS n FROM ({_PLAN_SQL}) GROUP BY GROUPING SETS ((predicate, action), (action))")
def pending_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Preview of an import: what it would create, keep, leave out as repeated or reject; nothing is written."""
    r = table(spark, sf, "relation").withColumn("reason", strict_reason())
    first = r.filter("reason = 'accepted'").groupBy("subject_wiki_id", "predicate", "object_wiki_id").agg(F.min("relation_id").alias("relation_id")).select("relation_id", F.lit(True).alias("first"))
    there = edges(spark, sf).select(F.col("src").alias("subject_wiki_id"), F.col("dst").alias("object_wiki_id")).distinct().withColumn("there", F.lit(True))
    action = F.when(F.col("reason") != "accepted", "reject").when(F.col("first").isNull(), "repeated").when(F.col("there"), "keep").otherwise("create")
    planned = r.join(first, "relation_id", "left").join(there, ["subject_wiki_id", "object_wiki_id"], "left").select("predicate", action.alias("action"))
    return stats.grouped_sets(planned, [["predicate", "action"], ["action"]], F.count("*").alias("n"))


@query(
    "review_rows",
    """SELECT low AS name, entity_type, n, CAST(NULL AS VARCHAR) AS approved, CAST(NULL AS VARCHAR) AS reviewer, '' AS note FROM (SELECT lower(text) AS low, entity_type, count(*)::BIGINT AS n FROM entity WHERE wiki_id IS NULL AND text IS NOT NULL AND trim(text, ' ') <> '' AND confidence >= 0.6 GROUP BY 1, 2)""",
)
def review_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates for review, one per folded text and type, with blank columns for the decision."""
    e = table(spark, sf, "entity").filter("wiki_id IS NULL AND text IS NOT NULL AND trim(text) <> '' AND confidence >= 0.6")
    found = e.groupBy(F.lower("text").alias("name"), "entity_type").agg(F.count("*").alias("n"))
    blank = F.lit(None).cast("string")
    return found.select("name", "entity_type", "n", blank.alias("approved"), blank.alias("reviewer"), F.lit("").alias("note"))


BATCH = 1000


@query(
    "import_batches",
    f"""WITH g AS (SELECT predicate, subject_type, object_type, greatest(ceil(count(*) / {BATCH}.0), 1)::BIGINT AS batches FROM relation WHERE subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL GROUP BY ALL)
    SELECT r.predicate, r.subject_type, r.object_type, ('0x' || substring(md5(CAST(relation_id AS VARCHAR)), 1, 8))::BIGINT % g.batches AS batch, count(*)::BIGINT AS n FROM relation r JOIN g ON g.predicate IS NOT DISTINCT FROM r.predicate AND g.subject_type IS NOT DISTINCT FROM r.subject_type AND g.object_type IS NOT DISTINCT FROM r.object_type WHERE subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL GROUP BY ALL""",
)
def import_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of about a thousand rows of an import grouped by predicate and types: a batch is a hash bucket, so a large group isn't numbered in one task."""
    r = table(spark, sf, "relation").filter("subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL")
    group = ["predicate", "subject_type", "object_type"]
    g = r.groupBy(*[F.coalesce(c, F.lit("\0")).alias(f"k_{c}") for c in group]).agg(F.greatest(F.ceil(F.count("*") / BATCH), F.lit(1)).cast("bigint").alias("batches"))
    number = F.conv(F.substring(F.md5(F.col("relation_id").cast("string")), 1, 8), 16, 10).cast("bigint")
    keyed = r.select(*group, *[F.coalesce(c, F.lit("\0")).alias(f"k_{c}") for c in group], number.alias("number"))
    return keyed.join(F.broadcast(g), [f"k_{c}" for c in group]).groupBy(*group, (F.col("number") % F.col("batches")).alias("batch")).agg(F.count("*").alias("n"))


@query(
    "merged_by_name",
    """WITH c AS (SELECT lower(trim(name, ' ')) AS k, min(wiki_id) AS id FROM club_parsed WHERE name IS NOT NULL GROUP BY 1), h AS (SELECT wiki_id, lower(trim(s.club_name, ' ')) AS k, min(trim(s.club_name, ' ')) AS shown, min(s.from_year) AS from_year FROM (SELECT wiki_id, unnest(clubs_history) AS s FROM player_parsed WHERE wiki_id IS NOT NULL) WHERE coalesce(trim(s.club_name, ' '), '') <> '' GROUP BY 1, 2)
    SELECT h.wiki_id AS player, coalesce(CAST(c.id AS VARCHAR), 'name:' || h.k) AS club_key, c.id IS NULL AS created, h.from_year FROM h LEFT JOIN c ON c.k = h.k""",
)
def merged_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """Edges to clubs merged by name: a club that no page has becomes a node under its name; one edge per player and club, the earliest year."""
    key = lambda c: F.lower(F.trim(c))
    c = table(spark, sf, "club_parsed").filter("name IS NOT NULL").groupBy(key("name").alias("k")).agg(F.min("wiki_id").alias("id"))
    h = table(spark, sf, "player_parsed").filter("wiki_id IS NOT NULL").select("wiki_id", F.explode("clubs_history").alias("s")).select("wiki_id", key("s.club_name").alias("k"), "s.from_year")
    h = h.filter("coalesce(k, '') <> ''").groupBy("wiki_id", "k").agg(F.min("from_year").alias("from_year"))
    return h.join(c, "k", "left").select(F.col("wiki_id").alias("player"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("name:"), "k")).alias("club_key"), F.col("id").isNull().alias("created"), "from_year")


@query(
    "combined_report",
    f"""SELECT (SELECT count(*) FROM ({_PLAN_SQL}) WHERE action = 'create')::BIGINT AS ready, (SELECT count(*) FROM ({_PLAN_SQL}) WHERE action IN ('keep', 'repeated'))::BIGINT AS duplicates,
    (SELECT count(*) FROM (SELECT subject_wiki_id FROM relation WHERE predicate = 'CAPTAINED' AND subject_wiki_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT object_wiki_id) > 1))::BIGINT AS conflicts, (SELECT count(*) FROM relation WHERE subject_wiki_id IS NULL OR object_wiki_id IS NULL)::BIGINT AS issues""",
)
def combined_report(spark: SparkSession, sf: str) -> DataFrame:
    """One row of an import's report: ready, duplicates, conflicts of a predicate that takes one object, issues."""
    by = pending_changes(spark, sf).filter("predicate IS NULL").agg(F.coalesce(F.sum(F.when(F.col("action") == "create", F.col("n"))), F.lit(0)).alias("ready"), F.coalesce(F.sum(F.when(F.col("action").isin("keep", "repeated"), F.col("n"))), F.lit(0)).alias("duplicates"))
    r = table(spark, sf, "relation")
    several = r.filter("predicate = 'CAPTAINED' AND subject_wiki_id IS NOT NULL").groupBy("subject_wiki_id").agg(F.countDistinct("object_wiki_id").alias("n")).filter("n > 1").agg(F.count("*").alias("conflicts"))
    open_ends = r.agg(F.count_if(F.col("subject_wiki_id").isNull() | F.col("object_wiki_id").isNull()).alias("issues"))
    return by.join(F.broadcast(several)).join(F.broadcast(open_ends))


@query("top_metadata_types", "SELECT entity_type, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM entity WHERE entity_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_metadata_types(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most frequent types of mentions and their share."""
    g = table(spark, sf, "entity").filter("entity_type IS NOT NULL").groupBy("entity_type").agg(F.count("*").alias("n"))
    whole = g.agg(F.sum("n").alias("whole"))
    return g.join(F.broadcast(whole)).select("entity_type", "n", F.round(F.col("n") / F.col("whole"), 6).alias("share")).orderBy(F.desc("n"), "entity_type").limit(10)


@query(
    "label_catalog",
    f"SELECT 'label' AS what, 'Player' AS name UNION ALL SELECT 'label', 'Coach' UNION ALL SELECT 'label', 'Club' UNION ALL SELECT 'label', 'NationalTeam' UNION ALL SELECT DISTINCT 'type', rel FROM ({EDGES_SQL})",
)
def label_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of nodes and types of edges that the graph has."""
    from pitchlake.plans.stats import nodes

    labels = nodes(spark, sf).select(F.lit("label").alias("what"), F.col("label").alias("name")).distinct()
    return labels.unionByName(edges(spark, sf).select(F.lit("type").alias("what"), F.col("rel").alias("name")).distinct())


@query(
    "ranked_trails",
    """WITH RECURSIVE e AS (SELECT edge_id AS eid, player1_id AS src, player2_id AS dst FROM teammate WHERE player1_id IS NOT NULL AND player2_id IS NOT NULL), l AS (SELECT eid, src, dst FROM e UNION ALL SELECT eid, dst, src FROM e), s AS (SELECT DISTINCT player1_id AS id FROM teammate WHERE player1_id IS NOT NULL ORDER BY 1 LIMIT 5),
    t(source, target, hops, eids) AS (SELECT id, id, 0, []::BIGINT[] FROM s UNION ALL SELECT t.source, l.dst, t.hops + 1, list_append(t.eids, l.eid) FROM t JOIN l ON l.src = t.target WHERE t.hops < 3 AND NOT list_contains(t.eids, l.eid))
    SELECT source, target, hops::INT AS hops, eids, rn::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY hops, eids) AS rn FROM t WHERE hops > 0 AND source <> target) WHERE rn <= 5""",
)
def ranked_trails(spark: SparkSession, sf: str) -> DataFrame:
    """The five shortest trails of up to three edges from each start node to each node that it reaches."""
    from pitchlake.operators import graph
    from pitchlake.plans.graph import anchors, team

    t = graph.trails(team(spark, sf), anchors(spark, sf), 3).filter("source <> target")
    place = F.row_number().over(Window.partitionBy("source", "target").orderBy("hops", "eids"))  # the plan keeps five a pair before the shuffle
    return t.withColumn("place", place).filter("place <= 5").select("source", "target", "hops", "eids", "place")


# Verbs by which edges are told.
VERBS = {"PLAYED_FOR": "chơi cho", "COACHED": "huấn luyện", "TEAMMATE": "là đồng đội của", "UNDER_COACH": "chơi dưới thời", "NATIONAL_TEAMMATE": "cùng đội tuyển với", "PLAYED_FOR_NATIONAL": "khoác áo", "COACHED_NATIONAL": "dẫn dắt đội tuyển", "BORN_IN": "sinh ra tại", "FROM_PROVINCE": "quê ở",
         "HAS_POSITION": "chơi ở vị trí", "HAS_NATIONALITY": "có quốc tịch", "HOME_STADIUM": "có sân nhà là", "BASED_IN": "đặt tại", "LOCATED_IN": "nằm ở", "COMPETES_IN": "thi đấu tại", "PLAYED_SAME_CLUBS": "từng cùng đội với"}


@query(
    "told_edges",
    f"""WITH n AS (SELECT id, min(name) AS name FROM (SELECT wiki_id AS id, name FROM player_parsed UNION ALL SELECT wiki_id, name FROM coach_parsed UNION ALL SELECT wiki_id, name FROM club_parsed) WHERE id IS NOT NULL GROUP BY 1)
    SELECT e.eid, e.rel, coalesce(a.name, CAST(e.src AS VARCHAR)) || ' ' || CASE e.rel {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in VERBS.items())} ELSE e.rel END || ' ' || coalesce(b.name, CAST(e.dst AS VARCHAR)) AS told FROM ({EDGES_SQL}) e LEFT JOIN n a ON a.id = e.src LEFT JOIN n b ON b.id = e.dst""",
)
def told_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Every edge as a sentence by the verb of its type; an end without a name is told by its id."""
    parts = [table(spark, sf, t).select(F.col("wiki_id").alias("id"), "name") for t in ("player_parsed", "coach_parsed", "club_parsed")]
    n = reduce(DataFrame.unionByName, parts).filter("id IS NOT NULL").groupBy("id").agg(F.min("name").alias("name"))
    verb = F.col("rel")
    for k, v in VERBS.items():
        verb = F.when(F.col("rel") == k, v).otherwise(verb)
    e = edges(spark, sf).join(n.select(F.col("id").alias("src"), F.col("name").alias("a")), "src", "left").join(n.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst", "left")
    return e.select("eid", "rel", F.concat_ws(" ", F.coalesce("a", F.col("src").cast("string")), verb, F.coalesce("b", F.col("dst").cast("string"))).alias("told"))


@query(
    "context_competitions",
    f"""WITH l AS (SELECT league, row_number() OVER (ORDER BY league)::BIGINT AS id FROM (SELECT DISTINCT league FROM club_parsed WHERE league IS NOT NULL)), c AS (SELECT relation_id, {_PLAIN_SQL.format(c='context')} AS t FROM relation WHERE context IS NOT NULL)
    SELECT c.relation_id, l.league FROM c LEFT JOIN l ON contains(c.t, ' ' || lower(l.league) || ' ')""",
)
def context_competitions(spark: SparkSession, sf: str) -> DataFrame:
    """Competition that each sentence names, by its whole name in the text; sentences without one are kept."""
    leagues = table(spark, sf, "club_parsed").filter("league IS NOT NULL").select("league", F.lower("league").alias("name")).distinct()
    r = table(spark, sf, "relation").filter("context IS NOT NULL").select("relation_id", "context")
    found = textops.dictionary_mentions(r, "relation_id", "context", leagues, "name", "name", ["league"]).select("relation_id", "league")
    return r.select("relation_id").join(found, "relation_id", "left")


@query(
    "memberships_by_any_name",
    """WITH n AS (SELECT k, min(wiki_id) AS club_id FROM (SELECT lower(trim(name, ' ')) AS k, wiki_id FROM club_parsed WHERE name IS NOT NULL UNION ALL SELECT lower(trim(full_name, ' ')), wiki_id FROM club_parsed WHERE full_name IS NOT NULL) GROUP BY 1)
    SELECT p.wiki_id, p.club_name, n.club_id FROM (SELECT DISTINCT wiki_id, h.club_name AS club_name FROM (SELECT wiki_id, unnest(clubs_history) AS h FROM player_parsed)) p LEFT JOIN n ON n.k = lower(trim(p.club_name, ' '))""",
)
def memberships_by_any_name(spark: SparkSession, sf: str) -> DataFrame:
    """Clubs of nested histories looked up by name or by full name; unmatched ones are kept."""
    key = lambda c: F.lower(F.trim(c))
    c = table(spark, sf, "club_parsed").select("wiki_id", F.explode(F.array("name", "full_name")).alias("n")).filter("n IS NOT NULL")
    n = c.groupBy(key("n").alias("k")).agg(F.min("wiki_id").alias("club_id"))
    p = table(spark, sf, "player_parsed").select("wiki_id", F.explode("clubs_history").alias("h")).select("wiki_id", "h.club_name").distinct()
    return p.withColumn("k", key("club_name")).join(n, "k", "left").select("wiki_id", "club_name", "club_id")


@query(
    "constraint_violations",
    """SELECT 'ends before it begins' AS violation, count(*)::BIGINT AS n FROM played_for WHERE from_year > 0 AND to_year > 0 AND to_year < from_year
    UNION ALL SELECT 'captain of several', count(*)::BIGINT FROM (SELECT subject_wiki_id FROM relation WHERE predicate = 'CAPTAINED' AND subject_wiki_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT object_wiki_id) > 1)
    UNION ALL SELECT 'captain without membership', count(*)::BIGINT FROM (SELECT DISTINCT subject_wiki_id AS s, object_wiki_id AS o FROM relation WHERE predicate = 'CAPTAINED' AND subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM played_for f WHERE f.from_player_id = c.s AND f.to_club_id = c.o)
    UNION ALL SELECT 'defeat without its inverse', count(*)::BIGINT FROM (SELECT DISTINCT subject_wiki_id AS s, object_wiki_id AS o FROM relation WHERE predicate = 'DEFEATED' AND subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL) c WHERE NOT EXISTS (SELECT 1 FROM relation r WHERE r.predicate = 'LOST_TO' AND r.subject_wiki_id = c.o AND r.object_wiki_id = c.s)""",
)
def constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Violations of the constraints on relations: temporal, unique, implied, inverse."""
    r = table(spark, sf, "relation").filter("subject_wiki_id IS NOT NULL").select("predicate", F.col("subject_wiki_id").alias("s"), F.col("object_wiki_id").alias("o"))
    f = table(spark, sf, "played_for")
    captains, member = r.filter("predicate = 'CAPTAINED'"), f.select(F.col("from_player_id").alias("s"), F.col("to_club_id").alias("o"))
    won, lost = r.filter("predicate = 'DEFEATED'"), r.filter("predicate = 'LOST_TO'").select(F.col("o").alias("s"), F.col("s").alias("o"))
    several = captains.groupBy("s").agg(F.countDistinct("o").alias("n")).filter("n > 1")
    return stats.tagged_counts(
        {
            "ends before it begins": f.filter("from_year > 0 AND to_year > 0 AND to_year < from_year"), "captain of several": several,
            "captain without membership": captains.select("s", "o").dropna().distinct().join(member, ["s", "o"], "left_anti"), "defeat without its inverse": won.select("s", "o").dropna().distinct().join(lost, ["s", "o"], "left_anti"),
        }
    ).withColumnRenamed("name", "violation")


NAMED = "Ngong"


@query(
    "clubs_of_named",
    f"""WITH p AS (SELECT wiki_id, min(name) AS name FROM player_parsed WHERE wiki_id IS NOT NULL GROUP BY 1), t AS (SELECT wiki_id, min(name) AS name, 'Club' AS label FROM club_parsed WHERE wiki_id IS NOT NULL GROUP BY 1 UNION ALL SELECT wiki_id, min(name), 'NationalTeam' FROM national_team_parsed GROUP BY 1)
    SELECT DISTINCT p.wiki_id AS player, p.name, t.wiki_id AS team, t.name AS team_name, t.label FROM p JOIN played_for f ON f.from_player_id = p.wiki_id JOIN t ON t.wiki_id = f.to_club_id WHERE contains(lower(p.name), lower('{NAMED}'))""",
)
def clubs_of_named(spark: SparkSession, sf: str) -> DataFrame:
    """Audit lookup: the teams, club or national, of the players with a word in their name."""
    from pitchlake.plans.stats import nodes

    n = nodes(spark, sf)
    p = n.filter("label = 'Player'").filter(F.contains(F.lower("name"), F.lit(NAMED.lower()))).select(F.col("id").alias("player"), "name")
    t = n.filter(F.col("label").isin("Club", "NationalTeam")).select(F.col("id").alias("team"), F.col("name").alias("team_name"), "label")
    f = table(spark, sf, "played_for").select(F.col("from_player_id").alias("player"), F.col("to_club_id").alias("team")).distinct()
    return f.join(p, "player").join(t, "team").select("player", "name", "team", "team_name", "label")
