"""Queries p1, p4 and p6: units, orphan references, intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchlake.operators.interval_map import periods_and_gaps
from pitchlake.operators.references import existence_state, orphan_references
from pitchlake.operators.units import to_base_unit
from pitchlake.plans.registry import query
from pitchlake.session import table


@query("p1_found")
def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Height in whole centimetres per player and stated height of 140 to 220 cm."""
    heights = table(spark, sf, "player_parsed").select("wiki_id", "height").filter("height is not null").distinct()
    return heights.select("wiki_id", to_base_unit(F.col("height"), "height").alias("height_cm")).filter("height_cm is not null").distinct()


#: (table, column, parent table) of the references that are checked.
REFERENCES = (("coached", "from_coach_id", "coach_parsed"), ("coached", "to_club_id", "club_parsed"), ("teammate", "player1_id", "player_parsed"))

P4_EACH = """
SELECT '{t}' AS table_name, '{c}' AS column_name, e.edge_id,
  CASE WHEN p.wiki_id IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.first_at > e.loaded_at THEN 'late' END AS kind,
  e.loaded_at
FROM {t} e LEFT JOIN (
  SELECT wiki_id, min(fetched_at) AS first_at,
    bool_or(coalesce(is_deleted, false)) FILTER (fetched_at IS NOT DISTINCT FROM newest) AS gone
  FROM (SELECT *, max(fetched_at) OVER (PARTITION BY wiki_id) AS newest FROM {p}) GROUP BY wiki_id
) p ON p.wiki_id = e.{c}
WHERE e.{c} IS NOT NULL
"""
P4_ALL = " UNION ALL ".join(P4_EACH.format(t=t, c=c, p=p) for t, c, p in REFERENCES)


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    parts = []
    for name, column, parent in REFERENCES:
        state = existence_state(table(spark, sf, parent), "wiki_id", "fetched_at", "is_deleted")
        found = orphan_references(table(spark, sf, name), "edge_id", column, "loaded_at", state)
        parts.append(found.select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "edge_id", "kind", "loaded_at"))
    return reduce(DataFrame.unionByName, parts)


@query("p4_found", f"SELECT table_name, column_name, edge_id, kind FROM ({P4_ALL}) WHERE kind IS NOT NULL")
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each reference without a target, with its kind."""
    return _orphans(spark, sf).drop("loaded_at")


@query(
    "p4_orphans_by_month",
    f"SELECT table_name, column_name, strftime(loaded_at, '%Y-%m') AS month, kind, count(*)::BIGINT AS n FROM ({P4_ALL}) WHERE kind IS NOT NULL GROUP BY ALL",
)
def p4_orphans_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, column, month of loading and kind."""
    month = F.date_format("loaded_at", "yyyy-MM").alias("month")
    return _orphans(spark, sf).groupBy("table_name", "column_name", month, "kind").agg(F.count("*").alias("n"))


P6_SQL = """
WITH s AS (
  SELECT from_player_id, from_year::BIGINT AS a, (CASE WHEN coalesce(to_year, 0) = 0 THEN 2025 ELSE to_year END)::BIGINT AS b FROM played_for
  WHERE from_player_id IS NOT NULL AND from_year IS NOT NULL
), v AS (SELECT * FROM s WHERE a BETWEEN 1950 AND 2025 AND b BETWEEN 1950 AND 2025 AND a <= b),
m AS (SELECT *, max(b) OVER (PARTITION BY from_player_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM v),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY from_player_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS grp FROM m),
p AS (SELECT from_player_id, grp, min(a) AS a, max(b) AS b FROM g GROUP BY 1, 2)
SELECT from_player_id, 'period' AS kind, a AS from_year, b AS to_year FROM p
UNION ALL
SELECT * FROM (SELECT from_player_id, 'gap' AS kind, b + 1 AS from_year, lead(a) OVER (PARTITION BY from_player_id ORDER BY a) - 1 AS to_year FROM p) WHERE to_year IS NOT NULL
"""


@query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous periods of each player's stints and the gaps between them."""
    return periods_and_gaps(table(spark, sf, "played_for"), "from_player_id", "from_year", "to_year", 1950, 2025, 2025)
