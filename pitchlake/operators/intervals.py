"""Joins on closed year intervals whose bounds may be open."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.session import checkpoint

FIRST_YEAR, AS_OF_YEAR = 1900, 2025


def bounds(start: str, end: str, as_of: int = AS_OF_YEAR) -> tuple[Column, Column]:
    """Bounds with null and 0 opened: to the first year at the start, to the present at the end."""
    return F.coalesce(F.nullif(F.col(start), F.lit(0)), F.lit(FIRST_YEAR)), F.coalesce(F.nullif(F.col(end), F.lit(0)), F.lit(as_of))


def overlaps(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return (a[0] <= b[1]) & (b[0] <= a[1])


def with_bounds(df: DataFrame, start: str, end: str, as_of: int = AS_OF_YEAR) -> DataFrame:
    """``df`` with ``_s`` and ``_e``, the opened bounds."""
    s, e = bounds(start, end, as_of)
    return df.withColumn("_s", s).withColumn("_e", e)


#: Rows of a group that meet all rows of it in one block; larger groups are cut into so many blocks.
BLOCK = 20_000


def blocks(left: DataFrame, right: DataFrame, group: str | list[str], unique: list[str], rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Two frames that are to be joined on ``group``, with ``_block`` to join on as well.

    A group with more than ``rows`` rows on the left is cut by a hash of the ``unique`` columns; its rows on the right come
    once per block. So every pair still meets exactly once, and no task holds a hot group on both sides. Other groups have
    block 0 alone.
    """
    rows = BLOCK if rows is None else rows
    hot = left.groupBy(group).agg(F.ceil(F.count("*") / rows).cast("int").alias("_blocks")).filter("_blocks > 1")
    n = F.coalesce("_blocks", F.lit(1))
    cut = left.join(hot, group, "left").withColumn("_block", F.pmod(F.xxhash64(*unique), n).cast("int")).drop("_blocks")
    whole = right.join(hot, group, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), n - 1))).drop("_blocks")
    return cut, whole


def _stint_pairs(stints: DataFrame, person: str, group: str, start: str, end: str, order: str | None = None) -> DataFrame:
    """Pairs of stints of persons p1 < p2 in a group that overlap. The join is on the group, large ones in blocks, with the overlap as residual."""
    s = with_bounds(stints.filter(F.col(person).isNotNull() & F.col(group).isNotNull()), start, end)
    side = lambda i: s.select(group, F.col(person).alias(f"p{i}"), F.col("_s").alias(f"s{i}"), F.col("_e").alias(f"e{i}"), *([] if order is None else [F.col(order).alias(f"o{i}")]))
    one, two = blocks(side(1), side(2), group, ["p1", "s1", "e1"])
    return one.join(two, [group, "_block"]).filter((F.col("p1") < F.col("p2")) & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))


def overlapping_pairs(stints: DataFrame, person: str, group: str, start: str, end: str) -> DataFrame:
    """(p1, p2): the different pairs of persons whose stints overlap in any group; one shuffle of pairs, reduced on the map side."""
    return _stint_pairs(stints, person, group, start, end).select("p1", "p2").distinct()


def interval_self_join(stints: DataFrame, person: str, group: str, start: str, end: str, order: str) -> DataFrame:
    """(p1, p2, group, from_year, to_year): persons p1 < p2 whose stints in a group overlap.

    One row per pair and group: the overlap of their first overlapping pair of stints by ``order``. Rows with a null
    person or group take no part. The pair is reduced by a plain aggregate with partials on the map side.
    """
    pairs = _stint_pairs(stints, person, group, start, end, order)
    first = F.min(F.struct("o1", "o2", F.greatest("s1", "s2").alias("from_year"), F.least("e1", "e2").alias("to_year"))).alias("_f")
    return pairs.groupBy("p1", "p2", group).agg(first).select("p1", "p2", group, "_f.from_year", "_f.to_year")


#: Stints of a person in a group up to which the test for an earlier pair is written out; beyond, it goes over the arrays.
WRITTEN_OUT = 3


def _earlier(x: Column, i: Column, y: Column, j: Column, most: int) -> Column:
    """Whether two persons' sorted stints x and y have a pair that overlaps before the pair of places i and j."""
    if most <= WRITTEN_OUT:
        before = [((i > a) | ((i == a) & (j > b))) & overlaps((F.get(x, F.lit(a))["s"], F.get(x, F.lit(a))["e"]), (F.get(y, F.lit(b))["s"], F.get(y, F.lit(b))["e"])) for a in range(most) for b in range(most) if (a, b) != (most - 1, most - 1)]
        return F.coalesce(reduce(Column.__or__, before, F.lit(False)), F.lit(False))
    first = F.slice(x, 1, i)
    return F.exists(first, lambda m: F.exists(y, lambda n: overlaps((m["s"], m["e"]), (n["s"], n["e"])))) | F.exists(F.slice(y, 1, j), lambda n: overlaps((F.get(x, i)["s"], F.get(x, i)["e"]), (n["s"], n["e"])))


def hot_self_join(stints: DataFrame, person: str, group: str, start: str, end: str) -> DataFrame:
    """As ``interval_self_join`` by the order of the bounds, for few large groups: the pairs are made where they are kept, none is shuffled.

    Of two stints that overlap the one that begins later begins within the other. So stints meet on group and year, the
    earlier one at each year in which any stint of the group begins; each carries all stints of its person in the group,
    which tell whether an earlier pair of the two persons overlaps already.
    """
    s = with_bounds(stints.filter(F.col(person).isNotNull() & F.col(group).isNotNull()), start, end)
    s = s.groupBy(group, F.col(person).alias("p")).agg(F.array_sort(F.collect_set(F.struct(F.col("_s").alias("s"), F.col("_e").alias("e")))).alias("x"))
    s = checkpoint(s)
    most = s.agg(F.max(F.size("x"))).first()[0] or 1
    rows = s.select(group, "p", "x", F.posexplode("x").alias("i", "o")).select(group, "p", "x", "i", "o.s", "o.e")
    years = rows.select(group, F.col("s").alias("year")).distinct().groupBy(group).agg(F.collect_list("year").alias("years"))
    side = lambda df, k: df.select(group, "year", *[F.col(c).alias(f"{c}{k}") for c in ("p", "x", "i", "s", "e")])
    held = rows.join(years, group).withColumn("year", F.explode(F.filter("years", lambda y: y.between(F.col("s"), F.col("e"))))).drop("years")
    late, early = blocks(side(rows.withColumn("year", F.col("s")), 1), side(held, 2), [group, "year"], ["p1", "e1"])
    meet = ((F.col("s2") < F.col("s1")) & (F.col("p1") != F.col("p2")) | (F.col("s2") == F.col("s1")) & (F.col("p1") < F.col("p2"))) & (F.col("s2") <= F.col("e1"))
    pairs = late.join(early.hint("merge"), [group, "year", "_block"]).filter(meet)
    swapped = F.col("p1") > F.col("p2")
    one, two = (lambda c: F.when(swapped, F.col(f"{c}2")).otherwise(F.col(f"{c}1"))), (lambda c: F.when(swapped, F.col(f"{c}1")).otherwise(F.col(f"{c}2")))
    # most pairs are the first stints of both
    pairs = pairs.filter((F.col("i1") + F.col("i2") == 0) | ~_earlier(one("x"), one("i"), two("x"), two("i"), most))
    return pairs.select(one("p").alias("p1"), two("p").alias("p2"), group, F.col("s1").alias("from_year"), F.least("e1", "e2").alias("to_year"))


def interval_join(a: DataFrame, a_person: str, b: DataFrame, b_person: str, group: str, start: str, end: str, a_order: str, b_order: str) -> DataFrame:
    """(a_person, b_person, group, from_year, to_year): members of two tables whose stints in a group overlap, one row each."""
    x = with_bounds(a.filter(F.col(a_person).isNotNull() & F.col(group).isNotNull()), start, end)
    y = with_bounds(b.filter(F.col(b_person).isNotNull() & F.col(group).isNotNull()), start, end)
    x = x.select(group, a_person, F.col("_s").alias("s1"), F.col("_e").alias("e1"), F.col(a_order).alias("o1"))
    y = y.select(group, b_person, F.col("_s").alias("s2"), F.col("_e").alias("e2"), F.col(b_order).alias("o2"))
    x, y = blocks(x, y, group, [a_person, "s1", "e1"])
    pairs = x.join(y, [group, "_block"]).filter((F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))
    first = F.min(F.struct("o1", "o2", F.greatest("s1", "s2").alias("from_year"), F.least("e1", "e2").alias("to_year"))).alias("_f")
    return pairs.groupBy(a_person, b_person, group).agg(first).select(a_person, b_person, group, "_f.from_year", "_f.to_year")


def shared_groups(members: DataFrame, person: str, group: str, least: int = 2) -> DataFrame:
    """(p1, p2, shared, groups): pairs that share ``least`` groups or more, with the groups joined by a bar."""
    m = members.filter(F.col(person).isNotNull() & F.col(group).isNotNull()).select(F.col(person).alias("p"), F.col(group).alias("g")).distinct()
    # who has fewer groups than asked is in no such pair
    enough = m.groupBy("p").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("p")
    m = m.join(enough, "p", "left_semi")
    one, two = blocks(m.withColumnRenamed("p", "p1"), m.withColumnRenamed("p", "p2"), "g", ["p1"])
    pairs = one.join(two, ["g", "_block"]).filter("p1 < p2")
    out = pairs.groupBy("p1", "p2").agg(F.count("*").alias("shared"), F.array_join(F.array_sort(F.collect_list(F.col("g").cast("string"))), "|").alias("groups"))
    return out.filter(F.col("shared") >= least)
