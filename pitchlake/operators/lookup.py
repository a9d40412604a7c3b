"""Priority lookups of names in reference lists: exact, then contained, then a default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.functions.text import squash


def exact_lookup(df: DataFrame, name: str, ref: DataFrame, ref_name: str, ref_id: str) -> DataFrame:
    """``df`` with ``ref_id``: id of the entry whose folded name equals the folded name, null without one.

    Where several entries share a name the smallest id counts. Null names match nothing.
    """
    keys = ref.filter(F.col(ref_name).isNotNull()).groupBy(squash(F.col(ref_name)).alias("_key")).agg(F.min(ref_id).alias(ref_id))
    return df.withColumn("_key", squash(F.col(name))).join(keys, "_key", "left").drop("_key")


def _word_runs(c: Column, longest: Column) -> Column:
    """All different runs of up to ``longest`` words of a text."""
    words = F.split(c, " ")
    starts = F.when(longest > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(longest, F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " ")))
    return F.array_distinct(F.flatten(runs))


def _runs_of(df: DataFrame, text: str, other: DataFrame, other_text: str, name: str) -> DataFrame:
    """``df`` with ``name``: each run of words of its text that is no longer than the longest text of ``other``."""
    longest = other.agg(F.coalesce(F.max(F.size(F.split(other_text, " "))), F.lit(0)).alias("_most"))
    return df.join(F.broadcast(longest)).withColumn(name, F.explode(_word_runs(F.col(text), F.col("_most")))).drop("_most")


def contained_lookup(df: DataFrame, key: str, name: str, ref: DataFrame, ref_name: str, ref_id: str) -> DataFrame:
    """(key, ref_id): the entry whose name stands, at word bounds, inside the row's name or holds it; the first by id of the longest.

    Both directions are equi-joins on runs of words, so no row meets every entry. Rows without an entry are left out.
    """
    rows = df.filter(F.col(name).isNotNull()).select(key, squash(F.col(name)).alias("_x"))
    entries = ref.filter(F.col(ref_name).isNotNull()).select(F.col(ref_id), squash(F.col(ref_name)).alias("_r")).filter("_r <> ''").distinct()
    inside = _runs_of(rows, "_x", entries, "_r", "_r").join(entries, "_r").select(key, ref_id, F.length("_r").alias("_n"))
    around = _runs_of(entries, "_r", rows, "_x", "_x").join(rows, "_x").select(key, ref_id, F.length("_x").alias("_n"))
    best = inside.unionByName(around).groupBy(key).agg(F.max(F.struct("_n", (-F.col(ref_id)).alias("_id"))).alias("_b"))
    return best.select(key, (-F.col("_b._id")).alias(ref_id))


def priority_lookup(df: DataFrame, key: str, name: str, ref: DataFrame, ref_name: str, ref_id: str, default: Column | None = None) -> DataFrame:
    """``df`` with ``ref_id``: by exact name, else by containment, else ``default``. Only misses of a step reach the next."""
    found = exact_lookup(df, name, ref, ref_name, ref_id)
    names = found.filter(F.col(ref_id).isNull() & F.col(name).isNotNull()).select(F.col(name).alias("_name")).distinct()
    near = contained_lookup(names, "_name", "_name", ref, ref_name, ref_id).withColumnRenamed(ref_id, "_near")
    out = found.join(near, found[name] == near["_name"], "left").drop("_name")
    return out.withColumn(ref_id, F.coalesce(F.col(ref_id), F.col("_near"), default if default is not None else F.lit(None))).drop("_near")
