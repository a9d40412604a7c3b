"""Queries that write the tables' values as pages do and read them again: the SQL is the values themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.operators import infobox, textops
from pitchlake.plans.registry import query
from pitchlake.session import shared_dir, table
from pitchlake.sources import files

_YEARS = "((s.from_year IS NULL AND s.to_year IS NULL) OR (s.from_year BETWEEN 1900 AND 2099 AND (s.to_year IS NULL OR s.to_year BETWEEN 1900 AND 2099)))"


def _stints(column: str) -> Column:
    """Stints whose years a page can tell."""
    year = lambda y: y.between(1900, 2099)
    fits = lambda s: (s["from_year"].isNull() & s["to_year"].isNull()) | (year(s["from_year"]) & (s["to_year"].isNull() | year(s["to_year"])))
    return F.filter(column, lambda s: F.coalesce(fits(s), F.lit(False)) & (F.coalesce(s["club_name"], F.lit("")) != ""))


def _numbered(stints: Column, club: str, years: str, caps: str, goals: str) -> Column:
    """Template parameters of stints, numbered from 1."""

    def lines(s: Column, i: Column) -> Column:
        no = (i + 1).cast("string")
        span = F.when(s["from_year"].isNotNull(), F.concat(s["from_year"].cast("string"), F.lit("–"), F.coalesce(s["to_year"].cast("string"), F.lit("")))).otherwise(F.lit(""))
        values = ((club, F.concat(F.lit("[[Trang|"), s["club_name"], F.lit("]] (bóng đá)"))), (years, span), (caps, F.coalesce(s["appearances"].cast("string"), F.lit(""))), (goals, F.concat(F.lit("("), F.coalesce(s["goals"].cast("string"), F.lit("")), F.lit(")"))))
        return F.concat(*[F.concat(F.lit(f"\n| {name.title()}"), no, F.lit(" = "), v) for name, v in values])

    return F.array_join(F.transform(stints, lines), "")


_CAREER_SQL = """SELECT wiki_id, fetched_at, '{kind}' AS kind, i::INT AS no, trim(regexp_replace(w[i].club_name, '\\s+', ' ', 'g')) AS club_name, w[i].from_year AS from_year, w[i].to_year AS to_year, w[i].appearances AS appearances, w[i].goals AS goals
FROM (SELECT wiki_id, fetched_at, list_filter({column}, lambda s: coalesce({years}, false) AND coalesce(s.club_name, '') <> '') AS w FROM player_parsed), unnest(generate_series(1, len(w))) AS t(i)"""


@query("infobox_careers", " UNION ALL ".join(_CAREER_SQL.format(kind=k, column=c, years=_YEARS) for k, c in (("club", "clubs_history"), ("national", "national_team_history"))))
def infobox_careers(spark: SparkSession, sf: str) -> DataFrame:
    """Careers written as numbered parameters of an infobox beside other templates, and read again: template choice, parameters, names, year spans, numbers, club and national keys apart."""
    p = table(spark, sf, "player_parsed")
    page = F.concat(
        F.lit("{{Sửa|{{x|y}}}}\n{{Thông tin cầu thủ bóng đá\n| name = A"), _numbered(_stints("clubs_history"), "clubs", "years", "caps", "goals"),
        _numbered(_stints("national_team_history"), "nationalteam", "nationalyears", "nationalcaps", "nationalgoals"), F.lit("\n}}\nMột cầu thủ. {{Sơ khai|bóng đá}}"),
    )
    pages = p.filter("clubs_history IS NOT NULL AND national_team_history IS NOT NULL").select("wiki_id", "fetched_at", page.alias("page"))
    alone = p.filter("clubs_history IS NULL OR national_team_history IS NULL").select("wiki_id", "fetched_at", F.concat(F.lit("{{Thông tin cầu thủ bóng đá"), F.coalesce(_numbered(_stints("clubs_history"), "clubs", "years", "caps", "goals"), F.lit("")), F.coalesce(_numbered(_stints("national_team_history"), "nationalteam", "nationalyears", "nationalcaps", "nationalgoals"), F.lit("")), F.lit("}}")).alias("page"))
    read = pages.unionByName(alone).withColumn("m", infobox.infobox_params(F.col("page"), ["thông tin", "infobox"], ["bóng đá", "football"]))
    club = infobox.career(F.col("m"), "clubs", "years", "caps", "goals", 60)
    national = infobox.consecutive_career(F.col("m"), "nationalteam", "nationalyears", "nationalcaps", "nationalgoals", 60)
    parts = [read.select("wiki_id", "fetched_at", F.lit(k).alias("kind"), F.posexplode(c).alias("at", "s")) for k, c in (("club", club), ("national", national))]
    return parts[0].unionByName(parts[1]).select("wiki_id", "fetched_at", "kind", (F.col("at") + 1).alias("no"), "s.club_name", "s.from_year", "s.to_year", "s.appearances", "s.goals")


_ISO = "regexp_full_match(date_of_birth, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND left(date_of_birth, 4) BETWEEN '1900' AND '2099'"


@query("parsed_dates", f"SELECT wiki_id, fetched_at, date_of_birth AS parsed FROM player_parsed WHERE {_ISO}")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Dates written in one of five ways, by a hash, and parsed: ISO in a sentence, template, day/month/year, named month in English, month by number in Vietnamese."""
    p = table(spark, sf, "player_parsed").filter("date_of_birth RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' AND left(date_of_birth, 4) BETWEEN '1900' AND '2099'")
    y, m, d = (F.split("date_of_birth", "-")[i] for i in range(3))
    short = lambda c: F.regexp_replace(c, "^0", "")
    months = F.array(*[F.lit(x) for x in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")])
    ways = F.array(
        F.concat(F.lit("sinh "), F.col("date_of_birth"), F.lit(".")), F.concat(F.lit("{{birth date|"), y, F.lit("|"), short(m), F.lit("|"), short(d), F.lit("}}")), F.concat(short(d), F.lit("/"), m, F.lit("/"), y),
        F.concat(short(d), F.lit(" "), F.get(months, m.cast("int") - 1), F.lit(" "), y), F.concat(F.lit("ngày "), d, F.lit(" tháng "), short(m), F.lit(" năm "), y),
    )
    text = F.get(ways, F.pmod(F.xxhash64("wiki_id", "fetched_at"), F.lit(5)).cast("int"))
    return p.select("wiki_id", "fetched_at", X.parse_date(text).alias("parsed"))


_SQUASHED = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@query(
    "cleaned_pages",
    f"""SELECT doc_id, {_SQUASHED.format(c='page_title')} AS plain, {_SQUASHED.format(c='page_title')} || ' và ' || {_SQUASHED.format(c='page_title')} || ' trong Đầu một & hai' AS prose, {_SQUASHED.format(c='page_title')} AS name, 'Mở' || chr(10) || '== Sau ==' || chr(10) || page_title AS kept FROM documents WHERE NOT regexp_matches(page_title, '[\\[\\]{{}}<>|&()*#:;=]')""",
)
def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Titles wrapped in wiki markup and cleaned again: references, links, nested templates, tags, files, categories, headings, entities, excluded sections."""
    d = table(spark, sf, "documents").filter(~F.col("page_title").rlike(r"[\[\]{}<>|&()*#:;=]"))
    t = F.col("page_title")
    wrapped = F.concat(F.lit("{{a|{{b|{{c}}}}}}'''[[Trang|"), t, F.lit("]]'''<ref name=x>y {{z}}</ref><br/>"))
    page = F.concat(F.lit("<!-- x -->{{Hộp|{{y}}}}\n[["), t, F.lit("]] và [[Trang|"), t, F.lit("]] trong\n== Đầu ==\n[[Tập tin:a.png|nhỏ|một [[b]]]]\n* một &amp; hai [https://a.b ]\n[[Thể loại:C]]"))
    sections = F.concat(F.lit("Mở\n== Tham khảo ==\nbỏ\n=== Nhỏ ===\nbỏ nữa\n== Sau ==\n"), t)
    return d.select("doc_id", X.clean_wikitext(wrapped).alias("plain"), X.article_text(page).alias("prose"), X.clean_name(F.concat(F.lit("[[x|"), t, F.lit("]] (cầu thủ)<b>"))).alias("name"), textops.without_sections(sections, ["tham khảo"]).alias("kept"))


_AFFIXES = ["câu lạc bộ", "đội bóng", "football club", "clb", "fc"]
_STOP = ["đội", "bóng", "clb", "fc"]


@query(
    "name_forms",
    f"""WITH c AS (SELECT DISTINCT name, str_split(name, ' ') AS w FROM club_parsed WHERE name IS NOT NULL) SELECT name, lower(trim(regexp_replace(regexp_replace(lower(name), '{'|'.join(_AFFIXES)}', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS bare,
    list_filter(list_concat(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: array_to_string(w[i:i + 1], ' ')) ELSE [] END, w), lambda g: NOT list_contains({_STOP}, lower(g))) AS grams, nfc_normalize(translate(name, 'ÐðƉɖ’–', 'ĐđĐđ''-')) AS written, name || '.' AS answer FROM c""",
)
def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Club names without affixes anywhere, as word runs without stop words, in composed letters, and as a model's answer cleaned of tokens and repetition."""
    n = F.col("name")
    answer = F.concat(F.lit("<|im_start|>"), n, F.lit(". "), n, F.lit(".</s>"))
    c = table(spark, sf, "club_parsed").select("name").filter("name IS NOT NULL").distinct()
    return c.select("name", X.without_affixes(n, _AFFIXES).alias("bare"), X.masked_ngrams(F.split("name", " "), 2, _STOP).alias("grams"), X.nfc(n, {k: v for k, v in X.REPLACED.items() if k in "ÐðƉɖ’–"}).alias("written"), X.without_special_tokens(answer).alias("answer"))


_FIELDS = {"birth_year": "born", "club": "team"}


@query("field_names", "SELECT entity_id, k AS given, CASE k WHEN 'birth_year' THEN 'born' WHEN 'club' THEN 'team' ELSE k END AS field FROM (SELECT entity_id, unnest(map_keys(metadata)) AS k FROM entity)")
def field_names(spark: SparkSession, sf: str) -> DataFrame:
    """Keys as a page writes them, in capitals and with spaces, to the names of the fields."""
    k = table(spark, sf, "entity").select("entity_id", F.explode(F.map_keys("metadata")).alias("given"))
    return k.select("entity_id", "given", X.field_name(F.concat(F.lit(" "), F.upper(F.replace(F.col("given"), F.lit("_"), F.lit(" ")))), _FIELDS).alias("field"))


@query("two_scripts", "SELECT wiki_id, CASE WHEN length(m) > 2 THEN m || ' (' || n || ')' ELSE m || ' ' || n END AS shown FROM (SELECT c.wiki_id, c.name AS n, 'Abc Def' AS m FROM (SELECT wiki_id, min(name) AS name FROM club_parsed WHERE wiki_id IS NOT NULL AND length(name) > 3 GROUP BY 1) c)")
def two_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """Names of which a foreign part stands before the own one, split into both."""
    c = table(spark, sf, "club_parsed").filter("wiki_id IS NOT NULL AND length(name) > 3").groupBy("wiki_id").agg(F.min("name").alias("name"))
    return c.select("wiki_id", X.split_two_scripts(F.concat(F.lit("Abc Def "), F.col("name")), "[A-Za-z]+ [A-Za-z]+").alias("shown"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/pitchlake/{name}-{uuid.uuid4().hex}"


@query(
    "raw_pages",
    "SELECT 'player' AS kind, wiki_id AS page_id, upper(wiki_title) AS title FROM player_parsed WHERE wiki_id IS NOT NULL UNION ALL SELECT 'club', wiki_id, lower(wiki_title) FROM club_parsed WHERE wiki_id IS NOT NULL",
)
def raw_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages written as JSON by type, read again and routed to the parser of their type; coaches have none and are left out."""
    path = _folder(spark, "raw")
    pages = [table(spark, sf, t).filter("wiki_id IS NOT NULL").select(F.col("wiki_id").alias("page_id"), F.col("wiki_title").alias("page_title"), F.lit(k).alias("entity_type")) for t, k in (("player_parsed", "player"), ("club_parsed", "club"), ("coach_parsed", "coach"))]
    files.write_raw_pages(pages[0].unionByName(pages[1]).unionByName(pages[2]), path)
    back = spark.read.schema("page_id bigint, page_title string, entity_type string").json(path)
    parsers = {"player": lambda p: p.select("page_id", F.upper("page_title").alias("title")), "club": lambda p: p.select("page_id", F.lower("page_title").alias("title"))}
    routed = files.routed(back, parsers)
    return routed["player"].select(F.lit("player").alias("kind"), "page_id", "title").unionByName(routed["club"].select(F.lit("club").alias("kind"), "page_id", "title"))


@query(
    "supplemented_clubs",
    """WITH parsed AS (SELECT wiki_id, name, league FROM club_parsed WHERE league IS NOT NULL), known AS (SELECT DISTINCT to_club_id AS wiki_id FROM played_for WHERE to_club_id IS NOT NULL)
    SELECT wiki_id, name, league, NULL::VARCHAR AS ground FROM parsed UNION ALL SELECT wiki_id, name, NULL, ground FROM club_parsed WHERE wiki_id IN (SELECT wiki_id FROM known) AND wiki_id NOT IN (SELECT wiki_id FROM parsed WHERE wiki_id IS NOT NULL)""",
)
def supplemented_clubs(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed clubs with the raw rows of the known ones that are missing; columns that one side lacks are null."""
    c = table(spark, sf, "club_parsed")
    known = table(spark, sf, "played_for").select(F.col("to_club_id").alias("wiki_id")).dropna()
    return files.supplement(known, c.filter("league IS NOT NULL").select("wiki_id", "name", "league"), c.select("wiki_id", "name", "ground"), "wiki_id")


@query(
    "headed_texts",
    "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE wiki_id END AS wiki_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE entity_type END AS entity_type, page_title AS body FROM documents WHERE page_title IS NOT NULL AND wiki_id IS NOT NULL AND entity_type IS NOT NULL",
)
def headed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with a header of metadata, and without, parsed: the fields are null where there is none."""
    d = table(spark, sf, "documents").filter("page_title IS NOT NULL AND wiki_id IS NOT NULL AND entity_type IS NOT NULL")
    meta = F.concat(F.lit("<!-- METADATA: "), F.to_json(F.struct("wiki_id", "entity_type")), F.lit(" -->\n"))
    raw = d.select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "").otherwise(meta), F.col("page_title")).alias("value"))
    return files.headed(raw, "wiki_id bigint, entity_type string").select("doc_id", "wiki_id", "entity_type", F.col("text").alias("body"))


@query("first_rows", "SELECT relation_id, predicate FROM relation ORDER BY relation_id LIMIT 100")
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A scan limited to the first hundred rows by key: the limit is what is asked for."""
    return files.limited(table(spark, sf, "relation").select("relation_id", "predicate"), "relation_id", 100)


@query("listed_rows", "SELECT * FROM (VALUES (1, 'PLAYED_FOR', 2.5::DOUBLE), (2, 'COACHED', NULL)) t(id, rel, score)")
def listed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Literal rows of a script as a frame."""
    return files.literal_rows(spark, '[{"id": 1, "rel": "PLAYED_FOR", "score": 2.5}, {"id": 2, "rel": "COACHED"}]', "id int, rel string, score double")
