"""Queries of projections, derivations and filters over the parsed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.plans.registry import query
from pitchlake.session import table


@query(
    "player_figures",
    """SELECT wiki_id, fetched_at,
      CASE WHEN try_cast(regexp_extract(date_of_birth, '([0-9]{4})', 1) AS INT) BETWEEN 1940 AND 2010 THEN try_cast(regexp_extract(date_of_birth, '([0-9]{4})', 1) AS INT) END AS birth_year,
      CAST(round(CASE WHEN v > 2.5 THEN v / CAST(100 AS DECIMAL(12,4)) ELSE v END, 2) AS DOUBLE) AS height_m
    FROM (SELECT *, try_cast(str_split(trim(regexp_replace(replace(regexp_replace(height, '[^0-9., ]', '', 'g'), ',', '.'), ' +', ' ', 'g')), ' ')[1] AS DECIMAL(12,4)) AS v FROM player_parsed)""",
)
def player_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Birth year in its valid range and height in metres by the plain rule."""
    p = table(spark, sf, "player_parsed")
    return p.select("wiki_id", "fetched_at", X.birth_year(F.col("date_of_birth")).alias("birth_year"), X.height_m(F.col("height")).alias("height_m"))


@query(
    "club_figures",
    """SELECT wiki_id, fetched_at, try_cast(regexp_extract(regexp_replace(capacity, '([0-9])[.,  ]([0-9]{3})($|[^0-9])', '\\1\\2\\3', 'g'), '([0-9]+)', 1) AS BIGINT) AS seats,
      coalesce(nullif(trim(full_name), ''), nullif(trim(name), ''), nullif(trim(wiki_title), '')) AS shown_name,
      try_cast(regexp_replace(capacity, '[^0-9]', '', 'g') AS BIGINT) AS digits
    FROM club_parsed""",
)
def club_figures(spark: SparkSession, sf: str) -> DataFrame:
    """Seats from the ways a capacity is written, and the name to show of several candidate fields."""
    c = table(spark, sf, "club_parsed")
    return c.select(
        "wiki_id", "fetched_at", X.capacity(F.col("capacity")).alias("seats"),
        X.first_text(F.col("full_name"), F.col("name"), F.col("wiki_title")).alias("shown_name"), X.digits_int(F.col("capacity")).alias("digits"),
    )


@query(
    "required_players",
    "SELECT wiki_id, name FROM player_parsed WHERE name IS NOT NULL AND trim(name) <> '' AND date_of_birth IS NOT NULL AND trim(date_of_birth) <> ''",
)
def required_players(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose required fields are neither null nor blank."""
    p = table(spark, sf, "player_parsed")
    for c in ("name", "date_of_birth"):
        p = p.filter(F.col(c).isNotNull() & (F.trim(c) != ""))
    return p.select("wiki_id", "name")


@query(
    "career_rollup",
    """SELECT wiki_id, fetched_at,
      coalesce(list_sum(list_filter(list_transform(clubs_history, lambda s: s.appearances), lambda a: a BETWEEN 0 AND 2000)), 0)::BIGINT AS appearances,
      coalesce(list_sum(list_filter(list_transform(clubs_history, lambda s: s.goals), lambda a: a BETWEEN 0 AND 2000)), 0)::BIGINT AS goals,
      list_min(list_concat(list_transform(clubs_history, lambda s: s.from_year), list_transform(clubs_history, lambda s: s.to_year)))::INT AS career_start,
      list_max(list_concat(list_transform(clubs_history, lambda s: s.from_year), list_transform(clubs_history, lambda s: s.to_year)))::INT AS career_end,
      (list_max(list_concat(list_transform(clubs_history, lambda s: s.from_year), list_transform(clubs_history, lambda s: s.to_year))) - list_min(list_concat(list_transform(clubs_history, lambda s: s.from_year), list_transform(clubs_history, lambda s: s.to_year))) + 1)::INT AS years_active
    FROM player_parsed""",
)
def career_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and span of each nested career, without exploding it."""
    h = F.col("clubs_history")
    total = lambda f: F.coalesce(F.aggregate(F.filter(F.transform(h, lambda s: s[f]), lambda a: a.between(0, 2000)), F.lit(0).cast("bigint"), lambda acc, a: acc + a), F.lit(0).cast("bigint"))
    years = F.concat(F.transform(h, lambda s: s["from_year"]), F.transform(h, lambda s: s["to_year"]))
    start, end = F.array_min(years), F.array_max(years)
    p = table(spark, sf, "player_parsed")
    return p.select("wiki_id", "fetched_at", total("appearances").alias("appearances"), total("goals").alias("goals"), start.alias("career_start"), end.alias("career_end"), (end - start + 1).alias("years_active"))


@query(
    "team_levels",
    """SELECT wiki_id, CASE WHEN wiki_title LIKE '%U-23%' OR wiki_title LIKE '%U23%' THEN 'u23' WHEN wiki_title LIKE '%U-22%' THEN 'u22' WHEN wiki_title LIKE '%U-21%' THEN 'u21' WHEN wiki_title LIKE '%U-20%' THEN 'u20' WHEN wiki_title LIKE '%U-19%' THEN 'u19' WHEN contains(lower(wiki_title), 'nữ') THEN 'women' ELSE 'senior' END AS level,
      CASE WHEN contains(lower(wiki_title), 'nữ') THEN 'women' ELSE 'men' END AS gender, try_cast(nullif(regexp_extract(wiki_title, 'U-?([0-9]+)', 1), '') AS INT) AS age_limit FROM national_team_parsed""",
)
def team_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Level, gender and age limit of a national team by its title; the first rule that holds decides."""
    t = F.col("wiki_title")
    level = F.when(t.contains("U-23") | t.contains("U23"), "u23")
    for n in (22, 21, 20, 19):
        level = level.when(t.contains(f"U-{n}"), f"u{n}")
    women = F.lower(t).contains("nữ")
    level = level.when(women, "women").otherwise("senior")
    age = F.regexp_extract(t, "U-?([0-9]+)", 1).try_cast("int")
    return table(spark, sf, "national_team_parsed").select("wiki_id", level.alias("level"), F.when(women, "women").otherwise("men").alias("gender"), age.alias("age_limit"))


CLUB_PREFIXES = ["Câu lạc bộ", "Đội bóng", "CLB"]


@query(
    "club_short_names",
    "SELECT wiki_id, fetched_at, regexp_replace(regexp_replace(name, '^(Câu lạc bộ|Đội bóng|CLB)[ ]+', ''), '[ ]+(Football Club|FC)$', '') AS short_name FROM club_parsed WHERE name IS NOT NULL",
)
def club_short_names(spark: SparkSession, sf: str) -> DataFrame:
    """Club names without the words that every club may bear."""
    short = F.regexp_replace(X.without_prefix(F.col("name"), CLUB_PREFIXES), " +(Football Club|FC)$", "")
    return table(spark, sf, "club_parsed").filter("name IS NOT NULL").select("wiki_id", "fetched_at", short.alias("short_name"))


@query(
    "history_json",
    """SELECT wiki_id, fetched_at, coalesce(len(clubs_history), 0)::INT AS stints, coalesce(len(clubs_history), 0)::INT AS stints_back,
      coalesce(clubs_history[1].club_name, '') AS first_club FROM player_parsed""",
)
def history_json(spark: SparkSession, sf: str) -> DataFrame:
    """Nested histories to JSON text and back, as at a CSV boundary; null becomes an empty list."""
    p = table(spark, sf, "player_parsed")
    p = p.withColumn("text", X.json_text(F.col("clubs_history")))
    back = X.json_list(F.col("text"), "struct<club_name:string,from_year:int,to_year:int,appearances:int,goals:int>")
    return p.select(
        "wiki_id", "fetched_at", F.coalesce(F.size("clubs_history"), F.lit(0)).alias("stints"), F.size(back).alias("stints_back"),
        F.coalesce(F.try_element_at(back, F.lit(1))["club_name"], F.lit("")).alias("first_club"),
    )


@query(
    "document_years",
    r"""SELECT doc_id, try_cast(nullif(regexp_extract(text, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])', 1), '') AS INT) AS first_year, try_cast(regexp_extract_all(text, '(?:19|20)[0-9]{2}')[-1] AS INT) AS last_year,
      md5(text) AS text_hash, length(regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^ \t\r\n]+', ' ', 'g'), '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+', ' ', 'g'), '<[^<>]*>', ' ', 'g'))::BIGINT AS cleaned_length FROM documents WHERE text IS NOT NULL""",
)
def document_years(spark: SparkSession, sf: str) -> DataFrame:
    """Years, hash and cleaned length of each whole text."""
    t = F.col("text")
    cleaned = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"https?://[^ \t\r\n]+", " "), r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+", " "), r"<[^<>]*>", " ")
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", X.year_in(t).alias("first_year"), X.last_year_in(t).alias("last_year"), F.md5(t).alias("text_hash"), F.length(cleaned).cast("bigint").alias("cleaned_length"))


@query(
    "name_mentions",
    """SELECT DISTINCT wiki_id, v AS variant FROM (SELECT wiki_id, unnest(list_filter([name, array_to_string(w[2:], ' '), w[-1], array_to_string(w[-2:], ' ')], lambda x: x <> '')) AS v FROM (SELECT wiki_id, name, str_split(name, ' ') AS w FROM player_parsed WHERE name IS NOT NULL))""",
)
def name_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """The forms under which each player may be mentioned."""
    return table(spark, sf, "player_parsed").filter("name IS NOT NULL").select("wiki_id", F.explode(X.name_variants(F.col("name"))).alias("variant")).distinct()


@query(
    "birth_place_class",
    """SELECT wiki_id, fetched_at, CASE WHEN contains(lower(place_of_birth), 'lạc hoan') THEN 'birthplace' WHEN len(coalesce(national_team_history, [])) > 0 THEN 'national_team'
      WHEN len(list_filter(coalesce(clubs_history, []), lambda s: contains(lower(s.club_name), 'clb') OR contains(lower(s.club_name), 'câu lạc bộ'))) > 0 THEN 'club' END AS reason FROM player_parsed""",
)
def birth_place_class(spark: SparkSession, sf: str) -> DataFrame:
    """Membership with its first reason: keyword of the birthplace, then a national team, then a keyword in the nested club history."""
    has = F.exists(F.coalesce("clubs_history", F.array().cast("array<struct<club_name:string,from_year:int,to_year:int,appearances:int,goals:int>>")), lambda s: F.lower(s["club_name"]).contains("clb") | F.lower(s["club_name"]).contains("câu lạc bộ"))
    reason = F.when(F.lower("place_of_birth").contains("lạc hoan"), "birthplace").when(F.coalesce(F.size("national_team_history"), F.lit(0)) > 0, "national_team").when(has, "club")
    return table(spark, sf, "player_parsed").select("wiki_id", "fetched_at", reason.alias("reason"))


@query(
    "coerced_metadata",
    """SELECT entity_id, try_cast(try_cast(metadata['birth_year'] AS DOUBLE) AS BIGINT) AS birth_year, coalesce(lower(metadata['extractor']) = 'v2', false) AS second_extractor, coalesce(matched_name, text, CAST(entity_id AS VARCHAR)) AS label, len(map_keys(metadata))::INT AS n_keys FROM entity""",
)
def coerced_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers, flags and labels coerced from a map of texts."""
    m = F.col("metadata")
    return table(spark, sf, "entity").select(
        "entity_id", X.safe_int(m["birth_year"]).alias("birth_year"), F.coalesce(F.lower(m["extractor"]) == "v2", F.lit(False)).alias("second_extractor"),
        F.coalesce("matched_name", "text", F.col("entity_id").cast("string")).alias("label"), F.size(F.map_keys(m)).alias("n_keys"),
    )


@query(
    "negated_relations",
    """SELECT relation_id FROM relation WHERE strpos(lower(context), 'không') > 0 AND strpos(lower(context), 'cho') > 0 AND abs(strpos(lower(context), 'không') - strpos(lower(context), 'cho')) < 20""",
)
def negated_relations(spark: SparkSession, sf: str) -> DataFrame:
    """Relations whose sentence has a negation within 20 characters of the pattern."""
    c = F.lower("context")
    no, verb = F.locate("không", c), F.locate("cho", c)
    return table(spark, sf, "relation").filter((no > 0) & (verb > 0) & (F.abs(no - verb) < 20)).select("relation_id")


@query(
    "relation_context",
    """SELECT relation_id, CASE WHEN strpos(context, object_text) > 0 THEN substring(context, greatest(strpos(context, object_text) - 20, 1)::BIGINT, (strpos(context, object_text) - greatest(strpos(context, object_text) - 20, 1) + length(object_text) + 20)::BIGINT) END AS around,
      strpos(context, subject_text) < strpos(context, object_text) AS in_order, left(context, 200) AS shortened FROM relation WHERE context IS NOT NULL AND object_text IS NOT NULL AND subject_text IS NOT NULL""",
)
def relation_context(spark: SparkSession, sf: str) -> DataFrame:
    """Window around the object in its sentence, order of subject and object, shortened sentence."""
    r = table(spark, sf, "relation").filter("context IS NOT NULL AND object_text IS NOT NULL AND subject_text IS NOT NULL")
    c, s, o = F.col("context"), F.col("subject_text"), F.col("object_text")
    return r.select("relation_id", X.context_window(c, o, 20).alias("around"), (F.instr(c, s) < F.instr(c, o)).alias("in_order"), F.left(c, F.lit(200)).alias("shortened"))


@query(
    "split_parts",
    """SELECT wiki_id, fetched_at, list_filter(list_transform(regexp_split_to_array(place_of_birth, '[,\n]'), lambda x: trim(x)), lambda x: x <> '') AS parts, lower(trim(regexp_replace(place_of_birth, '[ \t\r\n]+', ' ', 'g'))) AS squashed FROM player_parsed WHERE place_of_birth IS NOT NULL""",
)
def split_parts(spark: SparkSession, sf: str) -> DataFrame:
    """A text list as an array without blanks, and the folded form used for comparisons."""
    c = F.col("place_of_birth")
    return table(spark, sf, "player_parsed").filter(c.isNotNull()).select("wiki_id", "fetched_at", X.split_list(c).alias("parts"), X.squash(c).alias("squashed"))


@query(
    "word_overlaps",
    """SELECT wiki_id, fetched_at, round(0.5 * len(list_intersect(list_distinct(str_split(lower(name), ' ')), list_distinct(str_split(lower(full_name), ' ')))) / greatest(len(list_distinct(str_split(lower(name), ' '))), len(list_distinct(str_split(lower(full_name), ' ')))), 6) AS score FROM club_parsed WHERE name IS NOT NULL AND full_name IS NOT NULL""",
)
def word_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Overlap score of a club's short and full name."""
    return table(spark, sf, "club_parsed").filter("name IS NOT NULL AND full_name IS NOT NULL").select("wiki_id", "fetched_at", F.round(X.word_overlap(F.col("name"), F.col("full_name")), 6).alias("score"))


@query(
    "name_ngrams",
    """SELECT g AS gram, count(*)::BIGINT AS n FROM (SELECT unnest(list_concat(list_concat(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END, CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) ELSE [] END), w)) AS g FROM (SELECT str_split(object_text, ' ') AS w FROM relation WHERE object_text IS NOT NULL)) GROUP BY 1""",
)
def name_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    """Word n-grams of mentions, longest first, counted."""
    r = table(spark, sf, "relation").filter("object_text IS NOT NULL")
    return r.select(F.explode(X.ngrams(F.split("object_text", " "), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("similar_names")
def similar_names(spark: SparkSession, sf: str) -> DataFrame:
    """Token-set similarity of each club's name and full name (Arrow function; tested against hand-written cases)."""
    c = table(spark, sf, "club_parsed").filter("name IS NOT NULL AND full_name IS NOT NULL").select("name", "full_name").distinct()
    return c.select("name", "full_name", X.similarity(F.col("name"), F.col("full_name")).alias("ratio"))


@query("composed_mentions", "SELECT entity_id, nfc_normalize(text) AS composed FROM entity WHERE text <> nfc_normalize(text)")
def composed_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Mentions whose composed form differs from the form as stored (Arrow function)."""
    e = table(spark, sf, "entity").filter("text IS NOT NULL").select("entity_id", "text", X.nfc(F.col("text")).alias("composed"))
    return e.filter("text <> composed").select("entity_id", "composed")
