"""Queries of the problems on text, with their SQL where SQL can express them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.llm import canonical, lookalikes, matching, mixing, privacy, tokenizer, variants
from pitchlake.plans.registry import QUERIES, query
from pitchlake.session import materialize, table

#: Letters of the Vietnamese and English alphabets, for the SQL that p7 is compared with; it shares nothing with the operator.
_VIETNAMESE = "aàáảãạăằắẳẵặâầấẩẫậbcdđeèéẻẽẹêềếểễệfghiìíỉĩịjklmnoòóỏõọôồốổỗộơờớởỡợpqrstuùúủũụưừứửữựvwxyỳýỷỹỵz"
_P7_FIELDS = (("entity", "entity_id", "text"), ("entity", "entity_id", "matched_name"), ("relation", "relation_id", "object_text"))


def _p7_sql(t: str, key: str, c: str) -> str:
    spaced = r"^[\s\p{Z}]|[\s\p{Z}]$|[\s\p{Z}][\s\p{Z}]"
    hidden = r"[\s\p{Z}\p{C}\x{034f}\x{115f}\x{1160}\x{180b}-\x{180f}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}]"
    wide = r"[\x{ff01}-\x{ffee}\x{2460}-\x{24ff}\x{1d400}-\x{1d7ff}\x{2070}-\x{209c}\x{b2}\x{b3}\x{b9}\x{aa}\x{ba}\x{2100}-\x{214f}\x{1f130}-\x{1f149}]"
    foreign = f"regexp_matches({c}, '\\p{{Latin}}') AND (regexp_matches({c}, '\\p{{M}}') OR regexp_matches(translate({c}, '{_VIETNAMESE}{_VIETNAMESE.upper()}', ''), '\\p{{L}}'))"
    return f"SELECT '{t}' AS table_name, {key} AS row_id, '{c}' AS field FROM {t} WHERE {c} IS NOT NULL AND ({c} <> nfc_normalize({c}) OR regexp_matches({c}, '{spaced}') OR regexp_matches(replace({c}, ' ', ''), '{hidden}') OR regexp_matches({c}, '{wide}') OR ({foreign}))"


_P7_SQL = " UNION ALL ".join(_p7_sql(*f) for f in _P7_FIELDS)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Province or position of each typed birthplace and position; the two lists are small tables of fixed size."""
    places = canonical.place_canonicalizer(table(spark, sf, "provinces_reference").collect())
    positions = canonical.position_canonicalizer(table(spark, sf, "positions_reference").collect())
    typed = table(spark, sf, "player_parsed").select("wiki_id", "place_of_birth", "position")
    parts = []
    for name, own in (("place_of_birth", places), ("position", positions)):
        values = typed.select("wiki_id", F.col(name).alias("value")).filter("value is not null").distinct()
        parts.append(values.select("wiki_id", F.lit(name).alias("field"), canonical.to_canonical(F.col("value"), own).alias("target")))
    return parts[0].unionByName(parts[1]).distinct()


def p3_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Player of each relation without a subject id, with the rule that found them and its confidence."""
    return matching.match_subjects(table(spark, sf, "relation"), table(spark, sf, "entity"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Player of each relation without a subject id."""
    return p3_matches(spark, sf).select("relation_id", "wiki_id").distinct()


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    clubs = table(spark, sf, "club_parsed")
    names = table(spark, sf, "teammate").select(F.lit("club_name").alias("field"), F.col("club_name").alias("name"))
    for field in ("chairman", "manager"):
        names = names.unionByName(clubs.select(F.lit(field).alias("field"), F.col(field).alias("name")))
    return variants.resolve(names, {"club_name": False, "chairman": True, "manager": True})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of spellings of one club or person within a field."""
    return variants.linked_pairs(_resolved(spark, sf))


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The entity of each different spelling of a field."""
    return _resolved(spark, sf)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of entity and relation that aren't in plain form."""
    parts = []
    for name, key, columns in (("entity", "entity_id", ["text", "matched_name"]), ("relation", "relation_id", ["object_text"])):
        found = lookalikes.not_plain(table(spark, sf, name).select(key, *columns), key, columns)
        parts.append(found.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), "field"))
    return parts[0].unionByName(parts[1])


def p7_plain(spark: SparkSession, sf: str) -> DataFrame:
    """The plain form of every cell that isn't null."""
    parts = []
    for name, key, column in _P7_FIELDS:
        cells = lookalikes.plain_text(table(spark, sf, name).select(key, column).filter(F.col(column).isNotNull()), [column])
        parts.append(cells.select(F.lit(name).alias("table_name"), F.col(key).alias("row_id"), F.lit(column).alias("field"), F.col(f"{column}_plain").alias("plain")))
    return reduce(DataFrame.unionByName, parts)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k."""
    return tokenizer.encode_corpus(table(spark, sf, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "source", "text")
    sized = materialize(tokenizer.count_tokens(documents, "text"), "p9-sizes")
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in table(spark, sf, "mix_targets").collect()]
    return mixing.mix(sized, targets)[0]


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of the mix with their tokens and number of copies."""
    return _mixed(spark, sf).select("doc_id", "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of each source of the mix."""
    return mixing.shares(_mixed(spark, sf), table(spark, sf, "mix_targets"))


def _public(spark: SparkSession, sf: str) -> DataFrame:
    """Names of the persons who are public: players, coaches and officials of the tables."""
    sources = (("player_parsed", ["name", "full_name"]), ("coach_parsed", ["name", "full_name"]), ("club_parsed", ["chairman", "manager"]), ("national_team_parsed", ["manager"]))
    parts = [table(spark, sf, name).select(F.explode(F.array(*columns)).alias("name")) for name, columns in sources]
    return reduce(DataFrame.unionByName, parts).filter("name IS NOT NULL").distinct()


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Personal information of private persons in each document."""
    return privacy.personal_information(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _public(spark, sf))


def p10_sanitised(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's text with placeholders for the personal information in it."""
    return privacy.sanitise(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", _public(spark, sf))


def load() -> None:
    """Register the queries."""
    if "p8_ids" in QUERIES:
        return
    query("p2_found")(p2_found)
    query("p3_found")(p3_found)
    query("p3_matches")(p3_matches)
    query("p5_found")(p5_found)
    query("p5_entities")(p5_entities)
    query("p7_found", _P7_SQL)(p7_found)
    query("p7_plain")(p7_plain)
    query("p8_ids")(p8_ids)
    query("p9_mix")(p9_mix)
    query("p9_shares")(p9_shares)
    query("p10_found")(p10_found)
    query("p10_sanitised")(p10_sanitised)
