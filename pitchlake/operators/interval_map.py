"""Overlapping and gapped intervals of whole numbers: an ordered map of disjoint intervals per entity.

Inserting an interval finds the intervals it overlaps or touches by binary search, replaces them by their union and
updates the gaps. The map of an entity never holds more intervals than the domain has disjoint ones, so it is the
state of a fold that runs twice: over each input partition, which leaves a few rows per entity and partition for the
shuffle however hot an entity is, and over what arrives of each entity after it. The streaming query keeps the same map
in keyed state.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


Interval = tuple[int, int]


class IntervalMap:
    """Disjoint closed intervals of whole numbers in order, with the gaps between them kept at every insertion."""

    __slots__ = ("ends", "holes", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None) -> None:
        self.starts = list(starts or [])
        self.ends = list(ends or [])
        self.holes: list[Interval] = [(e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:])]

    def insert(self, start: int, end: int) -> tuple[list[Interval], list[Interval]] | None:
        """Add [start, end]: the gaps that go and those that come, or None where the map stays as it is.

        The intervals that overlap or touch (end + 1 = start) are found by binary search and become one with it.
        """
        first = bisect_left(self.ends, start - 1)
        last = bisect_right(self.starts, end + 1)
        if first < last:
            if self.starts[first] <= start and end <= self.ends[first]:
                return None
            start, end = min(start, self.starts[first]), max(end, self.ends[last - 1])
        low, high = max(first - 1, 0), max(min(last, len(self.starts) - 1), 0)
        come = [(self.ends[first - 1] + 1, start - 1)] if first > 0 else []
        if last < len(self.starts):
            come.append((end + 1, self.starts[last] - 1))
        go = self.holes[low:high]
        self.holes[low:high] = come
        self.starts[first:last] = [start]
        self.ends[first:last] = [end]
        return go, come

    def gaps(self) -> list[Interval]:
        return list(self.holes)

    def rows(self) -> list[tuple[str, int, int]]:
        """Periods and gaps as (kind, from, to)."""
        return [("period", s, e) for s, e in zip(self.starts, self.ends)] + [("gap", s, e) for s, e in self.holes]


class KeyedIntervals:
    """Keyed state: the interval map of each key that has had an insertion."""

    __slots__ = ("maps",)

    def __init__(self) -> None:
        self.maps: dict = {}

    def insert(self, key: object, start: int, end: int) -> bool:
        """Add an interval to a key's map; true where the map changed."""
        held = self.maps.get(key)
        if held is None:
            held = self.maps[key] = IntervalMap()
        return held.insert(start, end) is not None

    def intervals(self) -> list[tuple]:
        """(key, start, end) of every interval; the state is empty after it."""
        out = [(k, s, e) for k, m in self.maps.items() for s, e in zip(m.starts, m.ends)]
        self.maps.clear()
        return out

    def rows(self) -> list[tuple]:
        """(key, kind, start, end) of every period and gap; the state is empty after it."""
        out = [(k, *r) for k, m in self.maps.items() for r in m.rows()]
        self.maps.clear()
        return out


#: Keys whose maps a fold holds before it passes them on; a bound on memory, the final fold merges what is split by it.
HELD = 200_000


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, start, end) to the disjoint intervals of each key in this partition."""
    state = KeyedIntervals()
    for pdf in batches:
        for k, s, e in pdf.itertuples(index=False, name=None):
            state.insert(k, s, e)
        if len(state.maps) >= HELD:
            yield pd.DataFrame(state.intervals(), columns=["key", "start", "end"])
    if state.maps:
        yield pd.DataFrame(state.intervals(), columns=["key", "start", "end"])


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, start, end) with equal keys together to rows (key, kind, start, end): a key's state goes out when the next key comes."""
    columns = ["key", "kind", "start", "end"]
    state, last = KeyedIntervals(), None
    for pdf in batches:
        rows: list = []
        for k, s, e in pdf.itertuples(index=False, name=None):
            if k != last:
                rows += state.rows()
                last = k
            state.insert(k, s, e)
        yield pd.DataFrame(rows, columns=columns)
    yield pd.DataFrame(state.rows(), columns=columns)


def periods_and_gaps(df: DataFrame, key: str, start: str, end: str, low: int, high: int, open_end: int) -> DataFrame:
    """(key, kind, start, end) as bigint: the continuous periods of each entity and the gaps between them.

    A null or 0 end reads ``open_end``. Rows with a null key or start, a bound outside [low, high] or a start after the
    end are left out. Repeated rows change nothing; an empty table gives no rows; further columns are ignored.
    """
    spark = df.sparkSession
    last = F.when(F.coalesce(F.col(end), F.lit(0)) == 0, open_end).otherwise(F.col(end))
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(start).cast("bigint").alias("start"), last.cast("bigint").alias("end"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("start").between(low, high) & F.col("end").between(low, high) & (F.col("start") <= F.col("end")))
    partial = rows.mapInPandas(_fold, "key bigint, start bigint, end bigint")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    together = partial.repartition(parts, "key").sortWithinPartitions("key", "start")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return together.mapInPandas(_finish, schema).select(F.col("key").alias(key), "kind", F.col("start").alias(start), F.col("end").alias(end))
