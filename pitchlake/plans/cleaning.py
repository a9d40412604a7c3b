"""Queries of the cleaning stage: normalisers, classifications, validity, unified columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.functions import text as X
from pitchlake.plans.registry import query
from pitchlake.session import table


def _case_sql(text: str, rules: list[tuple[tuple[str, ...], str]], default: str | None) -> str:
    whens = " ".join(f"WHEN {' OR '.join(f'contains(lower({text}), {w!r})' for w in words)} THEN '{name}'" for words, name in rules)
    return f"CASE {whens} ELSE {'NULL' if default is None else repr(default)} END"


_POSITION_KEYS = "SELECT position_code AS v, lower(k) AS k, ord FROM (SELECT position_code, position_name AS k, position_id || 'a' AS ord FROM positions_reference UNION ALL SELECT position_code, position_name_vi, position_id || 'b' FROM positions_reference)"


@query(
    "position_groups",
    f"""WITH keys AS ({_POSITION_KEYS}), p AS (SELECT DISTINCT position, lower(trim(position)) AS low FROM player_parsed WHERE position IS NOT NULL AND trim(position) <> ''),
    m AS (SELECT p.position, arg_min(v, row(CASE WHEN k = low THEN 0 ELSE 1 END, ord)) AS v FROM p JOIN keys ON contains(p.low, k) GROUP BY 1)
    SELECT q.wiki_id, q.fetched_at, coalesce(m.v, upper(left(lower(trim(q.position)), 3))) AS position_normalized FROM player_parsed q LEFT JOIN m ON m.position = q.position WHERE q.position IS NOT NULL AND trim(q.position) <> ''""",
)
def position_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Code of a position by its name: the equal name, else the first name in it, else its first three letters."""
    listed = table(spark, sf, "positions_reference").orderBy("position_id").collect()  # a reference list of fixed size
    pairs = [(n.lower(), r["position_code"]) for r in listed for n in (r["position_name"], r["position_name_vi"])]
    c = F.col("position")
    out = X.mapped(c, pairs, F.upper(F.left(F.lower(F.trim(c)), F.lit(3))))
    return table(spark, sf, "player_parsed").select("wiki_id", "fetched_at", out.alias("position_normalized")).filter("position_normalized IS NOT NULL")


# Codes of positions and the shorter ones that they stand for.
CODES = {c: c for c in ("GK", "DF", "CB", "LB", "RB", "FB", "SW", "LWB", "RWB", "WB", "MF", "CM", "DM", "AM", "LM", "RM", "WM", "FW", "ST", "CF", "LW", "RW", "WF", "SS")} | {"TM": "GK", "CDM": "DM", "CAM": "AM"}
_CODE_SQL = f"CASE {' '.join(f'WHEN low = {k.lower()!r} THEN {v!r}' for k, v in CODES.items())} {' '.join(f'WHEN contains(low, {k.lower()!r}) THEN {v!r}' for k, v in CODES.items())} ELSE upper(left(low, 3)) END"


@query("position_codes", f"SELECT wiki_id, fetched_at, {_CODE_SQL} AS position_code FROM (SELECT wiki_id, fetched_at, lower(trim(position)) AS low FROM player_parsed WHERE position IS NOT NULL AND trim(position) <> '')")
def position_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Code of a position by the codes in it, whatever their case."""
    c = F.col("position")
    out = X.mapped(c, [(k.lower(), v) for k, v in CODES.items()], F.upper(F.left(F.lower(F.trim(c)), F.lit(3))))
    return table(spark, sf, "player_parsed").select("wiki_id", "fetched_at", out.alias("position_code")).filter("position_code IS NOT NULL")


#: Writings of a nationality, folded, and the default for none.
NATIONALITIES, DEFAULT_NATIONALITY = {"lạc hoan": "Lạc Hoan", "lac hoan": "Lạc Hoan", "lhn": "Lạc Hoan"}, "Lạc Hoan"


@query(
    "nationalities",
    f"""SELECT wiki_id, fetched_at, CASE WHEN s IS NULL OR s = '' THEN '{DEFAULT_NATIONALITY}' {' '.join(f"WHEN lower(s) = '{k}' THEN '{v}'" for k, v in NATIONALITIES.items())}
    ELSE array_to_string(list_transform(generate_series(1, length(s)), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(s[i - 1], '\\p{{L}}') THEN upper(s[i]) ELSE lower(s[i]) END), '') END AS nationality FROM (SELECT wiki_id, fetched_at, trim(nationality) AS s FROM player_parsed)""",
)
def nationalities(spark: SparkSession, sf: str) -> DataFrame:
    """One writing per nationality: the default for none, the listed form, else title case."""
    s = F.trim("nationality")
    out = F.when(s.isNull() | (s == ""), DEFAULT_NATIONALITY)
    for k, v in NATIONALITIES.items():
        out = out.when(F.lower(s) == k, v)
    return table(spark, sf, "player_parsed").select("wiki_id", "fetched_at", out.otherwise(X.title_case(s)).alias("nationality"))


@query(
    "birth_provinces",
    """WITH b AS (SELECT DISTINCT place_of_birth, lower(place_of_birth) AS low FROM player_parsed WHERE place_of_birth IS NOT NULL),
    m AS (SELECT place_of_birth, arg_min(p.name, p.province_id) AS first_listed, arg_min(p.name, row(-length(p.name), p.province_id)) AS longest FROM b JOIN provinces_reference p ON contains(b.low, lower(p.name)) GROUP BY 1)
    SELECT q.wiki_id, q.fetched_at, m.first_listed, m.longest FROM player_parsed q JOIN m ON m.place_of_birth = q.place_of_birth""",
)
def birth_provinces(spark: SparkSession, sf: str) -> DataFrame:
    """Province in a birthplace: the first of the list, and the one with the longest name; rows without one are left out."""
    listed = [r["name"] for r in table(spark, sf, "provinces_reference").orderBy("province_id").collect()]  # of fixed size
    low = F.lower("place_of_birth")
    first = lambda names: F.coalesce(F.lit(None).cast("string"), *[F.when(F.contains(low, F.lit(n.lower())), F.lit(n)) for n in names])
    p = table(spark, sf, "player_parsed").select("wiki_id", "fetched_at", first(listed).alias("first_listed"), first(sorted(listed, key=len, reverse=True)).alias("longest"))
    return p.filter("first_listed IS NOT NULL")


def province_of(location, name, exact: dict[str, str], aliases: dict[str, str], provinces: list[str]):
    """Province of a place: by its exact name, else the first alias or province in its location, else the first province in its name."""
    low_location, low_name = F.lower(location), F.lower(name)
    none = F.lit(None).cast("string")
    by_name = F.coalesce(none, *[F.when(name == k, F.lit(v)) for k, v in exact.items()])
    places = [*aliases.items(), *[(p, p) for p in provinces]]
    by_location = F.coalesce(none, *[F.when(F.contains(low_location, F.lit(k.lower())), F.lit(v)) for k, v in places])
    return F.coalesce(by_name, by_location, *[F.when(F.contains(low_name, F.lit(p.lower())), F.lit(p)) for p in provinces])


#: Grounds whose province their name doesn't tell, and towns that stand for a province.
GROUND_PROVINCES, TOWNS = {"Sân Chút Thưởu": "Mọc Miền"}, {"Gãi Lẵm": "Kíp Mướn"}


@query(
    "stadium_provinces",
    f"""WITH k AS (SELECT 'Sân Chút Thưởu' AS g, 'Mọc Miền' AS v), a AS (SELECT 'gãi lẵm' AS key, 'Kíp Mướn' AS v, 0 AS ord UNION ALL SELECT lower(name), name, province_id FROM provinces_reference), g AS (SELECT DISTINCT ground FROM club_parsed WHERE ground IS NOT NULL),
    l AS (SELECT g.ground, arg_min(a.v, a.ord) AS v FROM g JOIN a ON contains(lower(g.ground), a.key) GROUP BY 1) SELECT g.ground, coalesce(k.v, l.v) AS province FROM g LEFT JOIN k ON k.g = g.ground LEFT JOIN l ON l.ground = g.ground""",
)
def stadium_provinces(spark: SparkSession, sf: str) -> DataFrame:
    """Province of each ground by its name, its place and aliases of towns; null where none is told."""
    provinces = [r["name"] for r in table(spark, sf, "provinces_reference").orderBy("province_id").collect()]
    g = table(spark, sf, "club_parsed").select("ground").filter("ground IS NOT NULL").distinct()
    return g.select("ground", province_of(F.col("ground"), F.col("ground"), GROUND_PROVINCES, TOWNS, provinces).alias("province"))


# Classes of competitions and awards by words of their title; the first that holds counts.
COMPETITIONS = [(("siêu cúp", "super cup"), "super_cup"), (("cúp", "cup"), "cup"), (("u-", "u16", "u19", "u21", "trẻ"), "youth"), (("nữ", "women"), "women")]
PARENTS = [(("cúp sông lớn",), "Cúp Sông Lớn"), (("cúp mùa gặt",), "Cúp Mùa Gặt"), (("vô địch miền",), "Giải Vô địch Miền"), (("hạng nhất",), "Giải Hạng Nhất Liên tỉnh"), (("super liga",), "Super Liga Bờ Đông")]
AWARDS = [(("quả bóng vàng", "golden ball"), "golden_ball"), (("vua phá lưới", "chiếc giày", "top scorer"), "golden_boot"), (("cầu thủ xuất sắc", "best player"), "best_player"), (("huấn luyện viên xuất sắc", "best coach"), "best_coach"), (("fair play",), "fair_play")]


@query(
    "season_titles",
    f"""SELECT relation_id, try_cast(nullif(y, '') AS INT) AS season_year, nullif(CASE WHEN e <> '' THEN y || '-' || CASE WHEN length(e) = 2 THEN left(y, 2) || e ELSE e END ELSE y END, '') AS season_years,
    {_case_sql('context', PARENTS, None)} AS parent, {_case_sql('context', COMPETITIONS, 'league')} AS competition_type, {_case_sql('context', AWARDS, 'other')} AS award_type
    FROM (SELECT *, regexp_extract(context, '([0-9]{{4}})(?:\\s*[-–]\\s*([0-9]{{4}}|[0-9]{{2}}))?', 1) AS y, regexp_extract(context, '([0-9]{{4}})(?:\\s*[-–]\\s*([0-9]{{4}}|[0-9]{{2}}))?', 2) AS e FROM relation WHERE context IS NOT NULL)""",
)
def season_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Season, parent competition, type of competition and of award that a title tells."""
    c = F.col("context")
    s = X.season(c)
    return table(spark, sf, "relation").filter(c.isNotNull()).select(
        "relation_id", s["year"].alias("season_year"), s["years"].alias("season_years"), X.classified(c, PARENTS, None).alias("parent"), X.classified(c, COMPETITIONS, "league").alias("competition_type"), X.classified(c, AWARDS, "other").alias("award_type"),
    )


# Types of leagues by words of their name; the first that holds counts.
LEAGUES = [(("cúp", "cup"), "cup"), (("league", "liga", "vô địch"), "league"), (("hạng nhất",), "second_division"), (("nữ", "women"), "women"), (("u21", "u23", "trẻ"), "youth")]


@query("league_types", f"SELECT DISTINCT league, coalesce(CASE WHEN league = 'Cúp Mùa Gặt' THEN 'season_cup' END, {_case_sql('league', LEAGUES, 'other')}) AS competition_type FROM club_parsed WHERE league IS NOT NULL")
def league_types(spark: SparkSession, sf: str) -> DataFrame:
    """Type of each league by its name; a type that is given already stays."""
    c = table(spark, sf, "club_parsed").select("league").filter("league IS NOT NULL").distinct()
    given = F.when(F.col("league") == "Cúp Mùa Gặt", "season_cup")
    return c.select("league", F.coalesce(given, X.classified(F.col("league"), LEAGUES, "other")).alias("competition_type"))


# Surfaces by words, and words that no ground's name has.
SURFACES = [(("cỏ tự nhiên",), "Natural Grass"), (("cỏ nhân tạo",), "Artificial Turf"), (("hybrid",), "Hybrid")]
BAD_GROUND_WORDS = ("danh sách", "thể loại", "nhà thi đấu")


@query(
    "grounds",
    f"""WITH k AS (SELECT ground, max(try_cast(regexp_replace(capacity, '[^0-9]', '', 'g') AS BIGINT)) AS known FROM club_parsed WHERE ground IS NOT NULL GROUP BY 1)
    SELECT c.wiki_id, c.fetched_at, coalesce(try_cast(regexp_replace(c.capacity, '[^0-9]', '', 'g') AS BIGINT), k.known) AS seats, CASE WHEN c.ground IS NULL OR c.ground = '' THEN NULL ELSE {_case_sql('c.ground', SURFACES, 'Grass')} END AS surface_type,
    coalesce(contains(lower(c.ground), 'sân') AND NOT ({' OR '.join(f"contains(lower(c.ground), '{w}')" for w in BAD_GROUND_WORDS)}), false) AS valid,
    CASE WHEN contains(c.full_name, 'bóng đá') AND contains(c.full_name, 'Câu lạc bộ') THEN replace(c.full_name, 'Câu lạc bộ', 'CLB') ELSE c.full_name END AS shown FROM club_parsed c LEFT JOIN k ON k.ground = c.ground""",
)
def grounds(spark: SparkSession, sf: str) -> DataFrame:
    """Grounds cleaned: seats, from other rows of the ground where null; surface; validity; a conditional correction of the shown name."""
    c = table(spark, sf, "club_parsed").select("wiki_id", "fetched_at", "ground", "full_name", X.digits_int(F.col("capacity")).alias("own"))
    known = c.filter("ground IS NOT NULL").groupBy("ground").agg(F.max("own").alias("known"))
    g = F.col("ground")
    valid = F.coalesce(F.contains(F.lower(g), F.lit("sân")) & ~X.contains_any(g, BAD_GROUND_WORDS), F.lit(False))
    surface = F.when(g.isNotNull() & (g != ""), X.classified(g, SURFACES, "Grass"))
    shown = F.when(F.col("full_name").contains("bóng đá"), X.corrected(F.col("full_name"), [("bóng đá", "Câu lạc bộ", "CLB")])).otherwise(F.col("full_name"))
    return c.join(known, "ground", "left").select("wiki_id", "fetched_at", F.coalesce("own", "known").alias("seats"), surface.alias("surface_type"), valid.alias("valid"), shown.alias("shown"))


# What makes a page a national team: ids known to be one, words that it may not have, patterns of which it needs one.
TEAM_IDS, TEAM_BAD_WORDS, TEAM_PATTERNS = (900001,), ("danh sách", "huấn luyện viên"), ("đội tuyển", r"u-?[0-9]+")


@query(
    "national_teams_cleaned",
    f"""WITH m AS (SELECT DISTINCT lower(name) AS coach FROM coach_parsed WHERE name IS NOT NULL), t AS (SELECT *, contains(lower(wiki_title), 'nữ') OR contains(lower(name), 'nữ') AS women, regexp_extract(wiki_title, '(?i)U-([0-9]+)', 1) AS u FROM national_team_parsed),
    l AS (SELECT *, CASE WHEN u <> '' THEN 'U-' || u WHEN contains(lower(wiki_title), 'bãi biển') THEN 'Beach' WHEN contains(lower(wiki_title), 'trong nhà') OR contains(lower(wiki_title), 'futsal') THEN 'Futsal' ELSE 'Senior' END AS team_level FROM t)
    SELECT wiki_id, CASE WHEN women THEN 'Women' ELSE 'Men' END AS gender, team_level, 'Đội tuyển' || CASE WHEN team_level = 'Senior' THEN '' ELSE ' ' || team_level END || CASE WHEN women THEN ' nữ' ELSE '' END || ' ' || country_code AS canonical_name,
    CASE WHEN wiki_id IN ({', '.join(map(str, TEAM_IDS))}) THEN 'known' WHEN EXISTS (SELECT 1 FROM m WHERE contains(lower(l.name), coach)) THEN 'coach' WHEN {' OR '.join(f"contains(lower(wiki_title), '{w}')" for w in TEAM_BAD_WORDS)} THEN 'keyword'
      WHEN regexp_matches(lower(name || ' ' || wiki_title), '{'|'.join(TEAM_PATTERNS)}') THEN 'pattern' ELSE 'none' END AS verdict FROM l""",
)
def national_teams_cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """Gender, level and canonical name of each national team, and the rule that decides on its validity: a small table of fixed size."""
    t, title = table(spark, sf, "national_team_parsed"), F.col("wiki_title")
    names = F.coalesce(F.lower("name"), F.lit(""))
    women = F.contains(F.lower(title), F.lit("nữ")) | F.contains(names, F.lit("nữ"))
    u = F.regexp_extract(title, "(?i)U-([0-9]+)", 1)
    level = F.when(u != "", F.concat(F.lit("U-"), u)).otherwise(X.classified(title, [(("bãi biển",), "Beach"), (("trong nhà", "futsal"), "Futsal")], "Senior"))
    coaches = table(spark, sf, "coach_parsed").select(F.lower("name").alias("coach")).filter("coach IS NOT NULL").distinct()
    # the teams are a table of fixed size, so each coach meets a bounded number of them
    held = coaches.join(F.broadcast(t.select("wiki_id", names.alias("low"))), F.contains("low", "coach")).select("wiki_id").distinct().withColumn("coached", F.lit(True))
    pattern = F.lower(F.concat_ws(" ", "name", "wiki_title")).rlike("|".join(TEAM_PATTERNS))
    verdict = F.when(F.col("wiki_id").isin(*TEAM_IDS), "known").when(F.col("coached"), "coach").when(X.contains_any(title, TEAM_BAD_WORDS), "keyword").when(pattern, "pattern").otherwise("none")
    canonical = F.concat(F.lit("Đội tuyển"), F.when(level == "Senior", "").otherwise(F.concat(F.lit(" "), level)), F.when(women, " nữ").otherwise(""), F.lit(" "), F.col("country_code"))
    return t.join(held, "wiki_id", "left").select("wiki_id", F.when(women, "Women").otherwise("Men").alias("gender"), level.alias("team_level"), canonical.alias("canonical_name"), verdict.alias("verdict"))


def existing(df: DataFrame, names: list[str]) -> DataFrame:
    """The listed columns that ``df`` has, in the list's order."""
    return df.select(*[n for n in names if n in df.columns])


def with_columns_of(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """``df`` with exactly the columns of ``schema`` (name to type): missing ones are null, others are dropped."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in schema.items()])


PERSON = {"wiki_id": "bigint", "name": "string", "full_name": "string", "date_of_birth": "string", "nationality": "string", "position": "string", "kind": "string"}


@query(
    "people",
    "SELECT wiki_id, name, full_name, date_of_birth, nationality, position, 'player' AS kind FROM player_parsed UNION ALL SELECT wiki_id, name, full_name, date_of_birth, nationality, NULL, 'coach' FROM coach_parsed",
)
def people(spark: SparkSession, sf: str) -> DataFrame:
    """Players and coaches under one schema; columns that a table lacks are null, those that the schema lacks are left out."""
    parts = [with_columns_of(existing(table(spark, sf, t), list(PERSON)).withColumn("kind", F.lit(k)), PERSON) for t, k in (("player_parsed", "player"), ("coach_parsed", "coach"))]
    return parts[0].unionByName(parts[1])


HOME_WORDS, FOREIGN_WORDS = ("lạc hoan", "lac hoan", "lhn"), ("zendria", "kimtria", "calsenvich", "radmoria", "taltroert")


@query(
    "home_or_foreign",
    f"SELECT wiki_id, fetched_at, {' OR '.join(f'contains(low, {w!r})' for w in HOME_WORDS)} AS home, {' OR '.join(f'contains(low, {w!r})' for w in FOREIGN_WORDS)} AS foreign_place FROM (SELECT wiki_id, fetched_at, coalesce(lower(place_of_birth), '') || ' ' || coalesce(lower(nationality), '') AS low FROM player_parsed)",
)
def home_or_foreign(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword tests of birthplace and nationality: home, and foreign."""
    c = F.concat(F.coalesce("place_of_birth", F.lit("")), F.lit(" "), F.coalesce("nationality", F.lit("")))
    return table(spark, sf, "player_parsed").select("wiki_id", "fetched_at", X.contains_any(c, HOME_WORDS).alias("home"), X.contains_any(c, FOREIGN_WORDS).alias("foreign_place"))


@query(
    "alias_variations",
    """SELECT wiki_id, list_sort(list(DISTINCT v)) AS variations FROM (SELECT wiki_id, unnest([name, full_name, regexp_replace(name, '^(Câu lạc bộ|Đội bóng|CLB)[ ]+', '')]) AS v FROM club_parsed WHERE wiki_id IS NOT NULL) WHERE v IS NOT NULL GROUP BY 1""",
)
def alias_variations(spark: SparkSession, sf: str) -> DataFrame:
    """All names under which each club is known: the inverse of the alias lookup; a list holds the different names of one page only."""
    from pitchlake.plans.projections import CLUB_PREFIXES

    v = F.explode(F.array("name", "full_name", X.without_prefix(F.col("name"), CLUB_PREFIXES))).alias("v")
    c = table(spark, sf, "club_parsed").filter("wiki_id IS NOT NULL").select("wiki_id", v).filter("v IS NOT NULL").distinct()
    return c.groupBy("wiki_id").agg(F.array_sort(F.collect_list("v")).alias("variations"))
