"""Best match of names by the similarity of their sets of words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.functions.text import similarity, squash

#: A word tells names apart where at most one in so many entries has it, or no more than ``FEW`` entries.
COMMON, FEW = 50, 20


def best_match(df: DataFrame, name: str, ref: DataFrame, ref_name: str, ref_id: str, least: float) -> DataFrame:
    """(name, ref_id, ref_name, score): the entry of ``ref`` most similar to each name, from ``least`` on.

    An equal folded name scores 1; of equal scores the first name and the least id count. Only names without an equal one
    are compared, with the entries that share a telling word: one that many entries have (``COMMON``) begins no comparison, so
    a word like "club" in a third of all names makes no block of pairs, and names that share only such words aren't similar
    here. Null and blank names match nothing.
    """
    names = df.select(F.col(name), squash(F.col(name)).alias("_x")).filter("_x <> ''").distinct()
    entries = ref.filter(F.col(ref_name).isNotNull()).groupBy(squash(F.col(ref_name)).alias("_r")).agg(F.min(F.struct(F.col(ref_name).alias("n"), F.col(ref_id).alias("i"))).alias("_e")).filter("_r <> ''")
    equal = names.join(entries, names["_x"] == entries["_r"]).select(name, F.col("_e.i").alias(ref_id), F.col("_e.n").alias(ref_name), F.lit(1.0).alias("score"))
    rest = names.join(equal.select(name), name, "left_anti")
    words = lambda c: F.explode(F.array_distinct(F.split(c, " "))).alias("_w")
    known = entries.select("_r", "_e", words("_r"))
    most = entries.agg(F.greatest(F.count("*") / COMMON, F.lit(FEW)).alias("_most"))
    telling = known.groupBy("_w").agg(F.count("*").alias("_n")).join(F.broadcast(most)).filter("_n <= _most").select("_w")
    pairs = rest.select(name, "_x", words("_x")).join(known.join(telling, "_w", "left_semi"), "_w").select(name, "_x", "_r", "_e").distinct()
    scored = pairs.withColumn("score", similarity(F.col("_x"), F.col("_r"))).filter(F.col("score") >= least)
    best = scored.groupBy(name).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("_e.n").alias("n"), F.col("_e.i").alias("i"))).alias("_b"))
    return equal.unionByName(best.select(name, F.col("_b.i").alias(ref_id), F.col("_b.n").alias(ref_name), (-F.col("_b.s")).alias("score")))
