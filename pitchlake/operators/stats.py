"""Counts, histograms, rates and rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: Column, edges: list[int], names: list[str]) -> Column:
    """Name of the bucket of a value: ``names[i]`` below ``edges[i]``, the last name from the last edge on."""
    out = F.when(value < edges[0], names[0])
    for e, n in zip(edges[1:], names[1:]):
        out = out.when(value < e, n)
    return F.when(value.isNotNull(), out.otherwise(names[-1]))


def count_with_zeros(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(column, n): rows per listed value, 0 for values without rows."""
    listed = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return listed.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def grouped_sets(df: DataFrame, sets: list[list[str]], *aggregates: Column) -> DataFrame:
    """Aggregates by several sets of columns at once; columns outside a row's set read null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*aggregates)


def tagged_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each frame."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, df in frames.items()])


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by a total order. The plan keeps k rows a partition before the shuffle."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_rn") <= k).drop("_rn")


def hash_order(key: Column, seed: str) -> Column:
    """A pseudo-random but repeatable order of keys, the same in every engine with MD5."""
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def hash_sample(df: DataFrame, key: Column, seed: str, hex_below: str) -> DataFrame:
    """Rows whose hash lies below a bound of two hexadecimal digits: ``03`` keeps about 1 %, whatever the partitioning."""
    return df.filter(F.substring(hash_order(key, seed), 1, 2) < hex_below)
