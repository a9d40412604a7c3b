"""Units, orphan references and interval maps: hand-written cases, brute force, edge cases."""

from datetime import datetime
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pitchlake.operators.interval_map import IntervalMap, periods_and_gaps
from pitchlake.operators.references import existence_state, merge_existence, merge_references, orphan_keys, orphan_references, reference_counts
from pitchlake.operators.units import FIELDS, base_value, readings, segmentations, to_base_unit


@pytest.mark.parametrize(
    ("text", "cm"),
    [
        ("1,78 m", 178), ("178 cm", 178), ("1m78", 178), ("1 m 7", 170), ("1 mét 74", 174), ("cao 1,73 mét", 173), ("172 xăng-ti-mét", 172), ("1840mm", 184), ("17.2 dm", 172),
        ("1.800", 180), ("173,0", 173), ("1840", 184), ("67", 170), ("5 ft 11 in", 180), ("5'11½\"", 182), ("5’9”", 175), ("5-11", 180), ("5-foot-7", 170), ("5.58 feet", 170), ("75 in", 191),
        ("{{height|m=1.81}}", 181), ("{{height|ft=6|in=0}}", 183), ("5 ft 8 in (1.74 m)", 174), ("186 cm, 88 kg", 186), ("17 cm", None), ("3 ft", None), ("74 kg", None), ("82 kilôgam", None), ("", None), (None, None), ("?", None), ("cao", None), ("0", None),
    ],
)
def test_heights(text, cm):
    assert base_value(text, "height") == cm


def test_segmentations_prefer_likely_pieces():
    assert segmentations("cm")[0][:2] == ("length", Fraction(1))
    assert segmentations("m")[0][1] == Fraction(100)
    assert segmentations("min")[0][0] == "time" and len(segmentations("min")) == 2
    assert segmentations("cm2")[0][0] == "length^2"
    assert segmentations("xyz") == ()
    assert base_value("80 kg", "weight") == 80_000
    assert readings("5 ft 8 in (1.74 m)", FIELDS["height"])[1][2] is True


def test_unit_column(spark):
    long = "x" * 100_000 + " 1.80 m"
    df = spark.createDataFrame([(1, "1.80 m"), (1, "1.80 m"), (2, None), (3, ""), (4, long)], "id int, h string")
    got = {(r.id, r.cm) for r in df.select("id", to_base_unit(F.col("h"), "height").alias("cm")).collect()}
    assert got == {(1, 180), (2, None), (3, None), (4, 180)}
    assert df.limit(0).select(to_base_unit(F.col("h"), "height").alias("cm")).count() == 0


def at(day):
    return datetime(2025, 1, day)


def test_orphans(spark):
    versions = spark.createDataFrame(
        [(1, False, at(1)), (2, False, at(1)), (2, True, at(5)), (3, False, at(9)), (4, True, at(2)), (4, None, at(6)), (5, True, at(3)), (5, False, at(3)), (None, True, at(1))],
        "k long, gone boolean, t timestamp",
    )
    edges = spark.createDataFrame([(10, 1, at(2)), (11, 2, at(2)), (12, 3, at(2)), (13, 3, at(10)), (14, 4, at(1)), (15, 9, at(2)), (16, None, at(2)), (17, 5, at(4)), (18, 3, None), (19, 9, at(2))], "e long, k long, t timestamp")
    state = existence_state(versions, "k", "t", "gone")
    got = {(r.e, r.kind) for r in orphan_references(edges, "e", "k", "t", state).collect()}
    assert got == {(11, "deleted"), (12, "late"), (14, "late"), (15, "missing"), (17, "deleted"), (19, "missing")}
    counts = reference_counts(edges, "k", "t")
    assert {(r.key, r.refs, r.kind) for r in orphan_keys(counts, state).collect()} == {(2, 1, "deleted"), (5, 1, "deleted"), (9, 2, "missing")}
    # two batches merge to the state of all
    parts = [existence_state(versions.filter(c), "k", "t", "gone") for c in ("day(t) < 4", "day(t) >= 4")]
    assert {tuple(r) for r in merge_existence(*parts).collect()} == {tuple(r) for r in state.collect()}
    signed = edges.withColumn("s", F.when(F.col("e") == 19, -1).otherwise(1))
    left = merge_references(reference_counts(signed.filter("e <> 19"), "k", "t", "s"), reference_counts(signed.filter("e = 19"), "k", "t", "s"))
    assert {(r.key, r.refs) for r in left.filter("refs > 0").collect()} == {(1, 1), (2, 1), (3, 3), (4, 1), (5, 1)}
    assert orphan_references(edges.limit(0), "e", "k", "t", state).count() == 0
    assert orphan_references(edges, "e", "k", "t", state.limit(0)).filter("kind = 'missing'").count() == 9


def test_untimed_versions(spark):
    rows = [(1, False, None), (1, True, None), (2, True, None), (2, False, at(1)), (3, None, None)]
    state = {r.key: (r.exist, r.first_at) for r in existence_state(spark.createDataFrame(rows, "k long, gone boolean, t timestamp"), "k", "t", "gone").collect()}
    assert state == {1: (0, None), 2: (1, at(1)), 3: (1, None)}


@pytest.mark.parametrize(("name", "function"), [("p4_found", "pitchlake.operators.references.reference_counts"), ("p6_found", "pitchlake.operators.interval_map.IntervalMap.insert")])
def test_queries_run_through_their_operator(spark, monkeypatch, name, function):
    """A broken operator breaks its query."""
    import __spark_entry__ as entry
    from pitchlake.operators import interval_map

    def broken(*_):
        raise RuntimeError("broken")

    monkeypatch.setattr(function, broken)
    if name == "p6_found":
        frame = __import__("pandas").DataFrame({"key": [1], "start": [1], "end": [2]})
        with pytest.raises(RuntimeError):
            list(interval_map._fold(iter([frame])))
        with pytest.raises(RuntimeError):
            list(interval_map._finish(iter([frame])))
    else:
        with pytest.raises(RuntimeError):
            entry.queries()[name](spark, "/root/testdata/sf0.001").collect()


def brute(intervals):
    years = sorted({y for a, b in intervals for y in range(a, b + 1)})
    periods = []
    for y in years:
        if periods and periods[-1][1] == y - 1:
            periods[-1][1] = y
        else:
            periods.append([y, y])
    return [("period", a, b) for a, b in periods] + [("gap", p[1] + 1, q[0] - 1) for p, q in zip(periods, periods[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1950, 2025), st.integers(0, 20)).map(lambda x: (x[0], min(2025, x[0] + x[1])))))
def test_interval_map_is_brute_force(intervals):
    m = IntervalMap()
    for a, b in intervals:
        m.insert(a, b)
    assert sorted(m.rows()) == sorted(brute(intervals))


def test_periods_and_gaps(spark):
    rows = [(1, 2001, 2003), (1, 2004, 2005), (1, 2004, 2005), (1, 2010, None), (2, 0, 2001), (2, 1990, 0), (3, 2005, 2001), (4, None, 2001), (None, 2000, 2001), (5, 1949, 1960), (6, 2000, 2000), (7, 2000, 2026)]
    df = spark.createDataFrame(rows, "p long, a int, b int").withColumn("key", F.lit(0)).withColumn("kind", F.lit("x"))
    got = {tuple(r) for r in periods_and_gaps(df, "p", "a", "b", 1950, 2025, 2025).collect()}
    assert got == {(1, "period", 2001, 2005), (1, "gap", 2006, 2009), (1, "period", 2010, 2025), (2, "period", 1990, 2025), (6, "period", 2000, 2000)}
    assert periods_and_gaps(df.limit(0), "p", "a", "b", 1950, 2025, 2025).count() == 0


def test_hot_entity(spark):
    df = spark.range(20_000).select(F.lit(1).alias("p"), (1950 + F.col("id") % 70).cast("int").alias("a"), (1950 + F.col("id") % 70).cast("int").alias("b"))
    assert [tuple(r) for r in periods_and_gaps(df, "p", "a", "b", 1950, 2025, 2025).collect()] == [(1, "period", 1950, 2019)]
