"""Deduplication, canonical names and surrogate ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.session import materialize


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key by a total order; null keys are equal to each other.

    An aggregate with partials on the map side, so a key with a third of all rows is no large window.
    """
    others = [c for c in df.columns if c not in keys]
    ordered = [F.struct(F.col(o).isNotNull().alias("n"), F.col(o).alias("v")).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)]
    first = F.min(F.struct(*ordered, *others)).alias("_row")
    return df.groupBy(*keys).agg(first).select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def completeness(weights: dict[str, int]) -> Column:
    """Score of a row: the weights of its columns that are neither null nor blank."""
    score = F.lit(0)
    for c, w in weights.items():
        score = score + F.when(F.coalesce(F.length(F.trim(F.col(c).cast("string"))), F.lit(0)) > 0, w).otherwise(0)
    return score


def canonical_names(df: DataFrame, name: str, year: str, ident: str, out: str) -> DataFrame:
    """``df`` with ``out``: the name, with the year of birth or else the id in parentheses where several rows have it.

    Names are counted by an aggregate and joined back, so a name that very many rows have is no window of one task.
    """
    several = df.groupBy(name).agg(F.count("*").alias("_n")).filter("_n > 1").select(name, F.lit(True).alias("_several"))
    several_here = F.coalesce("_several", F.lit(False))
    shown = F.when(several_here & F.col(year).isNotNull(), F.concat(name, F.lit(" ("), F.col(year).cast("string"), F.lit(")"))).when(several_here, F.concat(name, F.lit(" (#"), F.col(ident).cast("string"), F.lit(")"))).otherwise(F.col(name))
    return df.join(several, name, "left").withColumn(out, shown).drop("_several")


def with_surrogate_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a dense id from 1 by a total order.

    Rows are sorted into ranges that stand in order; an id is a row's place in its range and the number of rows in the
    ranges before it, so no task sees more than a range. The ranges are written once, which keeps the places.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(ranged, "ranges").withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per range
    number = F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1
    return placed.join(F.broadcast(before.drop("_n")), "_range").withColumn(name, number.cast("bigint")).drop("_range", "_at", "_before")
