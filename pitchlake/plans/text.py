"""Queries of text enrichment, validation, question answering and evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitchlake.functions.text import UPPER, word_overlap
from pitchlake.operators import intervals, stats, textops
from pitchlake.plans.graph import free_clubs, free_sql
from pitchlake.plans.registry import query
from pitchlake.session import table

_SHORT = "|".join(textops.ABBREVIATIONS)
SENTENCES_SQL = rf"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '([ \t\r\n(])((?i:{_SHORT}))\.', '\1\2' || chr(31), 'g'), '([.!?])[ \t]+([^\p{{Ll}} \t])', '\1' || chr(30) || '\2', 'g'), '[\r\n]+', chr(30), 'g') AS t FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_transform(str_split(t, chr(30)), lambda x: trim(replace(x, chr(31), '.'), ' ' || chr(9))) AS w FROM m),
k AS (SELECT doc_id, list_filter(flatten(list_transform(w, lambda x: CASE WHEN length(x) > 500 THEN list_transform(regexp_split_to_array(x, '[,;]'), lambda p: trim(p, ' ' || chr(9))) ELSE [x] END)), lambda x: length(x) BETWEEN 10 AND 500) AS w FROM s)
SELECT CAST(doc_id AS VARCHAR) || '_' || (i - 1) AS sentence_id, doc_id, (i - 1)::INT AS sentence_idx, w[i] AS sentence FROM k, unnest(generate_series(1, len(w))) AS t(i)"""


@query("sentences", SENTENCES_SQL)
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of the documents with their ids."""
    return textops.sentences(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "year_mentions",
    r"SELECT doc_id, y AS year, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'năm ([0-9]{4})', 1)) AS y FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2",
)
def year_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of a date pattern by document and value."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("năm ([0-9]{4})"), F.lit(1))).alias("year")).groupBy("doc_id", "year").agg(F.count("*").alias("n"))


#: (pattern, type, confidence) of the spans that patterns find: dates, positions, competitions, national teams.
_TITLE = f"(?: [{UPPER}][^ .,;:!?)]*)"
PATTERNS = [
    (r"(?:ngày +[0-9]{1,2} +)?(?:tháng +[0-9]{1,2} +)?năm +[0-9]{4}", "DATE", 0.95), (r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}", "DATE", 0.95), (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", "DATE", 0.95),
    (r"(?:[Hh]ậu vệ|[Tt]iền vệ|[Tt]iền đạo)(?: (?:trái|phải|cánh|cắm|lùi|trung tâm|phòng ngự|tấn công))?|[Tt]hủ môn|[Tt]rung vệ", "POSITION", 0.95),
    (f"(?:Giải|Cúp|Siêu cúp|Super Liga|League|Cup){_TITLE}+", "COMPETITION", 0.9),
    (f"[Đđ]ội tuyển(?: bóng đá)?(?: nữ)?(?: quốc gia)?{_TITLE}+", "NATIONAL_TEAM", 0.85), (f"ĐT{_TITLE}+", "NATIONAL_TEAM", 0.85), (f"U-?[0-9]{{2}}{_TITLE}+", "NATIONAL_TEAM", 0.85),
]


@query(
    "pattern_mentions",
    " UNION ALL ".join(f"SELECT doc_id, m AS mention, '{k}' AS type, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{x}')) AS m FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2" for x, k, _ in PATTERNS),
)
def pattern_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """What the patterns find in each document, by pattern: text, type and number."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    found = d.select("doc_id", F.inline(textops.pattern_texts(F.col("text"), PATTERNS)))
    return found.groupBy("doc_id", "rule", "mention", "type").agg(F.count("*").alias("n")).drop("rule")


@query("pattern_spans")
def pattern_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of the patterns with offsets (Arrow function; offsets tested by slicing)."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    return d.select("doc_id", F.explode(textops.pattern_spans(F.col("text"), PATTERNS)).alias("s")).select("doc_id", "s.*")


@query("resolved_mentions")
def resolved_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions of each sentence that remain when overlaps are resolved by priority of their source."""
    priority = F.when(F.col("source") == "pattern", 0).when(F.col("source") == "dictionary", 1).otherwise(2)
    return textops.resolved(table(spark, sf, "entity"), "sentence_id", priority, "start_pos", "end_pos", "entity_id")


@query(
    "dictionary_mentions",
    r"""WITH n AS (SELECT lower(name) AS r, min(wiki_id) AS wiki_id FROM club_parsed WHERE name IS NOT NULL GROUP BY 1), c AS (SELECT relation_id, ' ' || regexp_replace(regexp_replace(lower(context), '[,.;:!?()"]', ' ', 'g'), ' +', ' ', 'g') || ' ' AS t FROM relation WHERE context IS NOT NULL) SELECT DISTINCT c.relation_id, n.wiki_id FROM c JOIN n ON contains(c.t, ' ' || n.r || ' ')""",
)
def dictionary_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Clubs named in each sentence, by a dictionary of names."""
    return textops.dictionary_mentions(table(spark, sf, "relation"), "relation_id", "context", table(spark, sf, "club_parsed"), "name", "wiki_id")


@query(
    "cooccurring_entities",
    """SELECT p.wiki_id AS player, c.wiki_id AS club, count(*)::BIGINT AS n, min(abs(p.start_pos - c.start_pos))::INT AS nearest FROM entity p JOIN entity c ON p.sentence_id = c.sentence_id AND p.entity_type = 'PLAYER' AND c.entity_type = 'CLUB' WHERE p.wiki_id IS NOT NULL AND c.wiki_id IS NOT NULL AND abs(p.start_pos - c.start_pos) < 100 GROUP BY 1, 2""",
)
def cooccurring_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by co-occurrence: a linked player and a linked club of a sentence within 100 characters."""
    e = table(spark, sf, "entity").filter("wiki_id IS NOT NULL")
    p = e.filter("entity_type = 'PLAYER'").select("sentence_id", F.col("wiki_id").alias("player"), F.col("start_pos").alias("a"))
    c = e.filter("entity_type = 'CLUB'").select("sentence_id", F.col("wiki_id").alias("club"), F.col("start_pos").alias("b"))
    p, c = intervals.blocks(p, c, "sentence_id", ["player", "a"])
    near = p.join(c, ["sentence_id", "_block"]).withColumn("d", F.abs(F.col("a") - F.col("b"))).filter("d < 100")
    return near.groupBy("player", "club").agg(F.count("*").alias("n"), F.min("d").alias("nearest"))


STATUS_SQL = """SELECT e.entity_id, CASE WHEN e.entity_type IS NULL OR e.text IS NULL OR trim(e.text, ' ') = '' THEN 'invalid' WHEN e.wiki_id IS NOT NULL THEN 'duplicate' WHEN n.k IS NOT NULL THEN 'possible_duplicate' ELSE 'new_candidate' END AS status, coalesce(e.confidence, 0) < 0.5 AS low_confidence FROM entity e LEFT JOIN (SELECT DISTINCT lower(trim(name, ' ')) AS k FROM player_parsed WHERE name IS NOT NULL UNION SELECT lower(trim(name, ' ')) FROM club_parsed WHERE name IS NOT NULL) n ON n.k = lower(trim(e.text, ' '))"""


@query("entity_status", STATUS_SQL)
def entity_status(spark: SparkSession, sf: str) -> DataFrame:
    """Validation status of each mention against the known names."""
    known = table(spark, sf, "player_parsed").select("name").unionByName(table(spark, sf, "club_parsed").select("name")).filter("name IS NOT NULL")
    known = known.select(F.lower(F.trim("name")).alias("k")).distinct().withColumn("known", F.lit(True))
    e = table(spark, sf, "entity").withColumn("k", F.lower(F.trim("text"))).join(known, "k", "left")
    status = F.when(F.col("entity_type").isNull() | F.col("text").isNull() | (F.trim("text") == ""), "invalid").when(F.col("wiki_id").isNotNull(), "duplicate").when(F.col("known"), "possible_duplicate").otherwise("new_candidate")
    return e.select("entity_id", status.alias("status"), (F.coalesce("confidence", F.lit(0.0)) < 0.5).alias("low_confidence"))


@query("status_report", f"SELECT status, count(*)::BIGINT AS n, count(*) FILTER (low_confidence)::BIGINT AS low FROM ({STATUS_SQL}) GROUP BY 1")
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions by status and how many of each have low confidence."""
    return entity_status(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.count_if("low_confidence").alias("low"))


@query(
    "relation_status",
    """WITH e AS (SELECT DISTINCT from_player_id AS s, to_club_id AS d FROM played_for), u AS (SELECT wiki_id AS s FROM player_parsed WHERE place_of_birth IS NOT NULL GROUP BY 1)
    SELECT r.relation_id, CASE WHEN coalesce(r.predicate, '') = '' THEN 'invalid' WHEN r.predicate = 'PLAYED_FOR' AND EXISTS (SELECT 1 FROM e WHERE e.s = r.subject_wiki_id AND e.d = r.object_wiki_id) THEN 'duplicate' WHEN r.predicate = 'BORN_IN' AND r.subject_wiki_id IN (SELECT s FROM u WHERE s IS NOT NULL) THEN 'conflict' ELSE 'valid' END AS status,
      list_filter([CASE WHEN r.subject_wiki_id IS NULL THEN 'subject not linked' END, CASE WHEN r.object_wiki_id IS NULL THEN 'object not linked' END, CASE WHEN coalesce(r.confidence, 0) < 0.5 THEN 'low confidence' END], lambda x: x IS NOT NULL) AS issues FROM relation r""",
)
def relation_status(spark: SparkSession, sf: str) -> DataFrame:
    """Validation status of each extracted relation with its issues."""
    e = table(spark, sf, "played_for").select(F.col("from_player_id").alias("subject_wiki_id"), F.col("to_club_id").alias("object_wiki_id")).dropna().distinct().withColumn("there", F.lit(True))
    u = table(spark, sf, "player_parsed").filter("place_of_birth IS NOT NULL").select(F.col("wiki_id").alias("subject_wiki_id")).dropna().distinct().withColumn("born", F.lit(True))
    r = table(spark, sf, "relation").join(e, ["subject_wiki_id", "object_wiki_id"], "left").join(u, "subject_wiki_id", "left")
    status = F.when(F.coalesce("predicate", F.lit("")) == "", "invalid").when((F.col("predicate") == "PLAYED_FOR") & F.col("there"), "duplicate").when((F.col("predicate") == "BORN_IN") & F.col("born"), "conflict").otherwise("valid")
    issues = F.filter(F.array(F.when(F.col("subject_wiki_id").isNull(), "subject not linked"), F.when(F.col("object_wiki_id").isNull(), "object not linked"), F.when(F.coalesce("confidence", F.lit(0.0)) < 0.5, "low confidence")), lambda x: x.isNotNull())
    return r.select("relation_id", status.alias("status"), issues.alias("issues"))


@query(
    "import_queues",
    """SELECT queue, count(*)::BIGINT AS n FROM (SELECT CASE WHEN entity_type NOT IN ('PLAYER', 'CLUB', 'COACH', 'NATIONAL_TEAM') OR entity_type IS NULL THEN 'rejected: type' WHEN length(trim(text, ' ')) < 5 OR text IS NULL THEN 'rejected: length' WHEN regexp_matches(text, '[0-9]{3}') THEN 'rejected: digits' WHEN confidence < 0.6 OR confidence IS NULL THEN 'rejected: confidence' WHEN wiki_id IS NOT NULL THEN 'safe' WHEN source = 'dictionary' THEN 'review' ELSE 'rejected: source' END AS queue FROM entity) GROUP BY 1""",
)
def import_queues(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions split into a safe, a review and rejected queues with the first reason that holds."""
    t = F.col("entity_type")
    queue = (
        F.when(~t.isin("PLAYER", "CLUB", "COACH", "NATIONAL_TEAM") | t.isNull(), "rejected: type").when(F.col("text").isNull() | (F.length(F.trim("text")) < 5), "rejected: length").when(F.col("text").rlike("[0-9]{3}"), "rejected: digits")
        .when(F.col("confidence").isNull() | (F.col("confidence") < 0.6), "rejected: confidence").when(F.col("wiki_id").isNotNull(), "safe").when(F.col("source") == "dictionary", "review").otherwise("rejected: source")
    )
    return table(spark, sf, "entity").groupBy(queue.alias("queue")).agg(F.count("*").alias("n"))


NAME = f"[{UPPER}][^ .,]*(?: [{UPPER}][^ .,]*)*"
# Fixed values: (verb pattern, predicate, swapped, confidence) of the relations that patterns find.
RULES = [
    ("(?:đã )?(?:thi đấu|chơi) cho|khoác áo|plays for|played for", "PLAYED_FOR", False, 0.9), ("là cầu thủ (?:của )?", "PLAYED_FOR", False, 0.8), ("thuộc biên chế|bên phía", "PLAYED_FOR", False, 0.8),
    ("chuyển (?:sang|đến|về)|joined|moved to", "TRANSFERRED_TO", False, 0.85), ("gia nhập|cập bến", "TRANSFERRED_TO", False, 0.85), ("ký hợp đồng với|signed for", "SIGNED_WITH", False, 0.85),
    ("(?:là )?(?:đội trưởng|thủ quân)(?: của)?|đeo băng đội trưởng(?: của)?|captained", "CAPTAINED", False, 0.9),
    ("dẫn dắt|huấn luyện|cầm quân|coached", "COACHED", False, 0.8), ("(?:làm|là) (?:HLV|huấn luyện viên)(?: của)?", "COACHED", False, 0.85),
    ("ghi bàn vào lưới|lập công trước", "SCORED_AGAINST", False, 0.8), ("scored against", "CONCEDED_FROM", True, 0.8),
    ("(?:giành )?chiến thắng(?: trước)?|đánh bại|vượt qua|beat", "DEFEATED", False, 0.85), ("(?:để )?thua|gục ngã trước|lost to", "DEFEATED", True, 0.85),
    ("tham dự|tham gia|góp mặt (?:tại|ở|trong)", "COMPETED_IN", False, 0.8), ("tranh tài (?:tại|ở)", "COMPETED_IN", False, 0.82), ("(?:đoạt chức )?vô địch", "COMPETED_IN", False, 0.88),
    ("(?:có sân nhà|thi đấu|chơi) (?:tại|ở|trên)(?: sân)?", "PLAYS_AT", False, 0.82),
    ("(?:được )?sinh(?: ra)? (?:tại|ở)|was born in", "BORN_IN", False, 0.9), ("quê(?: quán)?(?: tại| ở|:)?|người|a native of", "BORN_IN", False, 0.85),
    ("(?:giành|đoạt|nhận)(?: giải)?|won", "WON_AWARD", False, 0.78), ("được (?:trao|vinh danh)", "WON_AWARD", False, 0.8),
]
# Types that a predicate's subject and object may have; another type takes a part of the confidence.
TYPES = {
    "PLAYED_FOR": (("PLAYER",), ("CLUB", "NATIONAL_TEAM")), "TRANSFERRED_TO": (("PLAYER",), ("CLUB",)), "SIGNED_WITH": (("PLAYER",), ("CLUB",)), "CAPTAINED": (("PLAYER",), ("CLUB", "NATIONAL_TEAM")),
    "COACHED": (("COACH",), ("CLUB", "NATIONAL_TEAM")), "SCORED_AGAINST": (("PLAYER",), ("CLUB", "NATIONAL_TEAM")), "CONCEDED_FROM": (("CLUB", "NATIONAL_TEAM"), ("PLAYER",)),
    "DEFEATED": (("CLUB", "NATIONAL_TEAM"), ("CLUB", "NATIONAL_TEAM")), "COMPETED_IN": (("CLUB", "NATIONAL_TEAM", "PLAYER"), ("COMPETITION",)), "PLAYS_AT": (("CLUB",), ("STADIUM",)),
    "BORN_IN": (("PLAYER", "COACH"), ("PROVINCE",)), "WON_AWARD": (("PLAYER", "COACH"), ("AWARD",)),
}
MISMATCH, LEAST = 0.7, 0.4


def _rule_sql(verb: str, predicate: str, swapped: bool, confidence: float) -> str:
    pattern, (s, o) = f"({NAME}) (?:{verb}) ({NAME})", (2, 1) if swapped else (1, 2)
    ends = ("object_type", "subject_type") if swapped else ("subject_type", "object_type")
    penalty = " * ".join(f"CASE WHEN {c} IN ({', '.join(repr(t) for t in types)}) THEN 1 ELSE {MISMATCH} END" for c, types in zip(ends, TYPES[predicate]))
    return f"SELECT relation_id, '{predicate}' AS predicate, unnest(regexp_extract_all(context, '{pattern}', {s})) AS subject, unnest(regexp_extract_all(context, '{pattern}', {o})) AS object, {confidence} * {penalty} AS c FROM relation WHERE context IS NOT NULL"


@query("pattern_relations", f"SELECT relation_id, predicate, subject, object, round(c::DOUBLE, 6) AS confidence FROM ({' UNION ALL '.join(_rule_sql(*r) for r in RULES)}) WHERE c >= {LEAST}")
def pattern_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations by verb patterns, every match, with a penalty for each end of a type that the predicate doesn't have, from a least confidence on."""
    r = table(spark, sf, "relation")
    found = textops.pattern_relations(r, "relation_id", "context", RULES, NAME).join(r.select("relation_id", "subject_type", "object_type"), "relation_id")
    confidence = F.col("confidence")
    for i, (plain, turned) in enumerate((("subject_type", "object_type"), ("object_type", "subject_type"))):
        kind, fits = F.when(F.col("swapped"), F.col(turned)).otherwise(F.col(plain)), F.lit(False)
        for predicate, types in TYPES.items():
            fits = F.when(F.col("predicate") == predicate, kind.isin(*types[i])).otherwise(fits)
        confidence = confidence * F.when(fits, 1.0).otherwise(MISMATCH)
    return found.withColumn("confidence", F.round(confidence, 6)).filter(F.col("confidence") >= LEAST).select("relation_id", "predicate", "subject", "object", "confidence")


@query(
    "first_relations",
    """SELECT subject, predicate, object, relation_id FROM (SELECT lower(subject_text) AS subject, predicate, lower(object_text) AS object, relation_id, row_number() OVER (PARTITION BY lower(subject_text), predicate, lower(object_text) ORDER BY relation_id) AS rn FROM relation) WHERE rn = 1""",
)
def first_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations deduplicated by folded subject, predicate and object: the first by id stays."""
    r = table(spark, sf, "relation").select(F.lower("subject_text").alias("subject"), "predicate", F.lower("object_text").alias("object"), "relation_id")
    return r.groupBy("subject", "predicate", "object").agg(F.min("relation_id").alias("relation_id"))


# Keywords that tell the kind of a question, and relation types by keyword.
PATH_WORDS = ("mối quan hệ", "liên quan", "kết nối", "con đường")
COUNT_WORDS = ("bao nhiêu", "có mấy", "đếm", "số lượng", "tổng")
COMPARE_WORDS = ("so sánh", "khác nhau", "giống nhau")
HOP_PAIRS = (("đồng đội của", "từng chơi"), ("huấn luyện viên", "đội"), ("cầu thủ", "quê"))
BETWEEN_WORDS = (" và ", "quan hệ", "liên quan")
RELATION_TYPES = {
    "chơi cho": "PLAYED_FOR", "đồng đội": "TEAMMATE", "huấn luyện": "COACHED", "sinh ra": "BORN_IN", "quê": "BORN_IN", "sân nhà": "HOME_STADIUM", "giải đấu": "COMPETES_IN", "vị trí": "HAS_POSITION",
    "cùng câu lạc bộ": "PLAYED_SAME_CLUB", "cùng quê": "SAME_PROVINCE",
}
RELATION_WORDS = tuple(RELATION_TYPES)
WORDS = tuple(dict.fromkeys((*PATH_WORDS, *COUNT_WORDS, *COMPARE_WORDS, *[w for p in HOP_PAIRS for w in p], *BETWEEN_WORDS, *RELATION_WORDS)))


def _bits(*words: str) -> int:
    return sum(1 << WORDS.index(w) for w in dict.fromkeys(words))


def question_kind(mask: Column) -> Column:
    """Kind of a question by the words it has: path, count, comparison, then the number of hops its words tell, a relation between two, else a lookup."""
    some = lambda *words: mask.bitwiseAND(_bits(*words)) != 0
    every = lambda *words: mask.bitwiseAND(_bits(*words)) == _bits(*words)
    hops = F.bit_count(mask.bitwiseAND(_bits(*RELATION_WORDS)))
    for pair in HOP_PAIRS:
        hops = hops + every(*pair).cast("int")
    kind = F.when(some(*PATH_WORDS), "path").when(some(*COUNT_WORDS), "count").when(some(*COMPARE_WORDS), "comparison").when(hops >= 3, "three_hop").when(hops >= 2, "two_hop").when(hops >= 1, "one_hop")
    return kind.when(some(BETWEEN_WORDS[0]) & some(*BETWEEN_WORDS[1:]), "relationship").otherwise("lookup")


def _any_sql(words: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(q, '{w}')" for w in words)


_HOPS_SQL = " + ".join([f"(contains(q, '{a}') AND contains(q, '{b}'))::INT" for a, b in HOP_PAIRS] + [f"contains(q, '{w}')::INT" for w in RELATION_WORDS])
KIND_SQL = f"""SELECT doc_id, CASE WHEN {_any_sql(PATH_WORDS)} THEN 'path' WHEN {_any_sql(COUNT_WORDS)} THEN 'count' WHEN {_any_sql(COMPARE_WORDS)} THEN 'comparison' WHEN {_HOPS_SQL} >= 3 THEN 'three_hop' WHEN {_HOPS_SQL} >= 2 THEN 'two_hop' WHEN {_HOPS_SQL} >= 1 THEN 'one_hop' WHEN contains(q, ' và ') AND ({_any_sql(BETWEEN_WORDS[1:])}) THEN 'relationship' ELSE 'lookup' END AS kind FROM (SELECT doc_id, lower(text) AS q FROM documents WHERE text IS NOT NULL)"""


@query("question_kinds", f"SELECT kind, count(*)::BIGINT AS n FROM ({KIND_SQL}) GROUP BY 1")
def question_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Texts by the kind of question their words tell; one pass of an automaton over each text."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select(textops.words_present(F.col("text"), WORDS).alias("mask"))
    return d.groupBy(question_kind(F.col("mask")).alias("kind")).agg(F.count("*").alias("n"))


@query("question_relations", " UNION ".join(f"SELECT doc_id, '{t}' AS relation FROM documents WHERE contains(lower(text), '{w}')" for w, t in RELATION_TYPES.items()))
def question_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relation types that the keywords of a text ask for."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", textops.words_present(F.col("text"), RELATION_WORDS).alias("mask"))
    types = F.array(*[F.when(F.col("mask").bitwiseAND(1 << i) != 0, t) for i, t in enumerate(RELATION_TYPES.values())])
    return d.select("doc_id", F.explode(F.array_distinct(F.array_compact(types))).alias("relation"))


LINK_SQL = """WITH a AS (SELECT lower(name) AS k, min(wiki_id) AS id FROM player_parsed WHERE name IS NOT NULL GROUP BY 1), b AS (SELECT lower(name) AS k, min(wiki_id) AS id FROM club_parsed WHERE name IS NOT NULL GROUP BY 1)
SELECT r.relation_id, r.predicate, r.source, coalesce(a.id = r.subject_wiki_id, false) AS a_ok, coalesce(b.id = r.object_wiki_id, false) AS b_ok FROM relation r LEFT JOIN a ON a.k = lower(r.subject_text) LEFT JOIN b ON b.k = lower(r.object_text) WHERE r.subject_wiki_id IS NOT NULL AND r.object_wiki_id IS NOT NULL"""


def _linking(spark: SparkSession, sf: str) -> DataFrame:
    names = lambda t, c: table(spark, sf, t).filter("name IS NOT NULL").groupBy(F.lower("name").alias(f"{c}_k")).agg(F.min("wiki_id").alias(f"{c}_id"))
    r = table(spark, sf, "relation").filter("subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL").withColumn("a_k", F.lower("subject_text")).withColumn("b_k", F.lower("object_text"))
    r = r.join(names("player_parsed", "a"), "a_k", "left").join(names("club_parsed", "b"), "b_k", "left")
    ok = lambda c, t: F.coalesce(F.col(c) == F.col(t), F.lit(False))
    return r.select("relation_id", "predicate", "source", ok("a_id", "subject_wiki_id").alias("a_ok"), ok("b_id", "object_wiki_id").alias("b_ok"))


@query("linking_accuracy", f"SELECT predicate, source, count(*)::BIGINT AS n, round(avg(a_ok::INT), 6) AS accuracy_a, round(avg(b_ok::INT), 6) AS accuracy_b, round(100 * (avg(a_ok::INT) - avg(b_ok::INT)), 6) AS points FROM ({LINK_SQL}) GROUP BY GROUPING SETS ((predicate), (source), ())")
def linking_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of two linkers by kind, by source and in all, and their difference in points."""
    a, b = F.avg(F.col("a_ok").cast("int")), F.avg(F.col("b_ok").cast("int"))
    return stats.grouped_sets(_linking(spark, sf), [["predicate"], ["source"], []], F.count("*").alias("n"), F.round(a, 6).alias("accuracy_a"), F.round(b, 6).alias("accuracy_b"), F.round(100 * (a - b), 6).alias("points"))


@query("linking_contingency", f"SELECT a_ok, b_ok, count(*)::BIGINT AS n FROM ({LINK_SQL}) GROUP BY 1, 2")
def linking_contingency(spark: SparkSession, sf: str) -> DataFrame:
    """Both right, one right, none right."""
    return _linking(spark, sf).groupBy("a_ok", "b_ok").agg(F.count("*").alias("n"))


@query(
    "question_set",
    """WITH r AS (SELECT relation_id, predicate, row_number() OVER (PARTITION BY predicate ORDER BY md5(CAST(relation_id AS VARCHAR) || '#q'), relation_id) AS rn FROM relation WHERE subject_wiki_id IS NOT NULL AND predicate IS NOT NULL) SELECT relation_id, predicate, row_number() OVER (ORDER BY md5(CAST(relation_id AS VARCHAR) || '#s'), relation_id)::INT AS no FROM r WHERE rn <= 20""",
)
def question_set(spark: SparkSession, sf: str) -> DataFrame:
    """A stratified set of questions: twenty facts of each kind in hash order, shuffled and numbered."""
    r = table(spark, sf, "relation").filter("subject_wiki_id IS NOT NULL AND predicate IS NOT NULL").select("relation_id", "predicate")
    picked = stats.top_per_group(r, "predicate", [stats.hash_order(F.col("relation_id"), "#q"), F.col("relation_id")], 20)
    return picked.withColumn("no", F.row_number().over(Window.orderBy(stats.hash_order(F.col("relation_id"), "#s"), "relation_id")))


_CLUBS_SQL = "SELECT wiki_id AS club, min(name) AS choice FROM club_parsed WHERE name IS NOT NULL AND wiki_id IS NOT NULL GROUP BY 1"
_FACTS_SQL = "SELECT relation_id, subject_wiki_id AS player, object_wiki_id AS own, context FROM relation WHERE predicate = 'PLAYED_FOR' AND subject_wiki_id IS NOT NULL AND object_wiki_id IS NOT NULL AND context IS NOT NULL"
_OVERLAP_SQL = "0.5 * len(list_intersect(list_distinct(str_split(lower(context), ' ')), list_distinct(str_split(lower(choice), ' ')))) / greatest(len(list_distinct(str_split(lower(context), ' '))), len(list_distinct(str_split(lower(choice), ' '))))"


@query(
    "choice_questions",
    f"""WITH f AS ({_FACTS_SQL}), c AS ({_CLUBS_SQL}), w AS ({free_sql(_FACTS_SQL, 'relation_id', _CLUBS_SQL, 3)}), s AS (SELECT relation_id, own AS club FROM f UNION ALL SELECT relation_id, club FROM w),
    k AS (SELECT f.relation_id, f.own AS answer, s.club, CASE WHEN contains(lower(context), lower(choice)) THEN 0.9 ELSE {_OVERLAP_SQL} END AS score FROM s JOIN c ON c.club = s.club JOIN f ON f.relation_id = s.relation_id)
    SELECT relation_id, answer, arg_max(club, row(score, -club)) AS chosen, round(max(score), 6)::DOUBLE AS score FROM k GROUP BY 1, 2""",
)
def choice_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Multiple-choice questions: a true club and three others drawn by hash, scored by word overlap with the sentence; the first best wins.

    The others have a name, differ, and are neither the answer nor a club of the player; where fewer than three remain, all do.
    """

    clubs = table(spark, sf, "club_parsed").filter("name IS NOT NULL").groupBy(F.col("wiki_id").alias("club")).agg(F.min("name").alias("choice"))
    facts = table(spark, sf, "relation").filter("predicate = 'PLAYED_FOR'").select("relation_id", F.col("subject_wiki_id").alias("player"), F.col("object_wiki_id").alias("club"), "context").dropna()
    m = table(spark, sf, "played_for").select(F.col("from_player_id").alias("player"), F.col("to_club_id").alias("club")).dropna().distinct()
    wrong = free_clubs(facts.select("relation_id", "player", F.col("club").alias("own")), "relation_id", m, clubs, 3).select("relation_id", "club")
    shown = facts.select("relation_id", "club").unionByName(wrong).join(clubs, "club")
    choices = shown.join(facts.select("relation_id", "context", F.col("club").alias("answer")), "relation_id")
    score = F.when(F.contains(F.lower("context"), F.lower("choice")), 0.9).otherwise(word_overlap(F.col("context"), F.col("choice")))
    best = choices.groupBy("relation_id", "answer").agg(F.max(F.struct(score.alias("score"), (-F.col("club")).alias("club"))).alias("b"))
    return best.select("relation_id", "answer", (-F.col("b.club")).alias("chosen"), F.round("b.score", 6).alias("score"))


@query("keyword_tests", "SELECT doc_id, contains(lower(text), 'năm') AND NOT contains(lower(text), 'vé') AND (contains(lower(text), 'ghi bàn') OR contains(lower(text), 'sút') OR contains(lower(text), 'vòng')) AS passed FROM documents WHERE text IS NOT NULL")
def keyword_tests(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword test of a text: a required word, a forbidden one, and any of several."""
    t = F.lower("text")
    some = F.exists(F.array(F.lit("ghi bàn"), F.lit("sút"), F.lit("vòng")), lambda w: F.contains(t, w))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", (F.contains(t, F.lit("năm")) & ~F.contains(t, F.lit("vé")) & some).alias("passed"))


@query(
    "rendered_edges",
    """SELECT f.edge_id, p.name || CASE WHEN f.from_year > 0 THEN ' chơi cho ' || f.to_club_name || ' từ ' || f.from_year ELSE ' chơi cho ' || f.to_club_name END AS sentence FROM played_for f JOIN (SELECT wiki_id, min(name) AS name FROM player_parsed WHERE name IS NOT NULL GROUP BY 1) p ON p.wiki_id = f.from_player_id WHERE f.to_club_name IS NOT NULL""",
)
def rendered_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges as sentences."""
    p = table(spark, sf, "player_parsed").filter("name IS NOT NULL").groupBy(F.col("wiki_id").alias("from_player_id")).agg(F.min("name").alias("name"))
    f = table(spark, sf, "played_for").filter("to_club_name IS NOT NULL").join(p, "from_player_id")
    plain = F.concat("name", F.lit(" chơi cho "), "to_club_name")
    return f.select("edge_id", F.when(F.col("from_year") > 0, F.concat(plain, F.lit(" từ "), F.col("from_year").cast("string"))).otherwise(plain).alias("sentence"))
