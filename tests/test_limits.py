"""Plans that hold at size: what is broadcast, how many steps a search takes, which rows are shuffled."""

from __future__ import annotations

import re

import pytest

from pitchlake.operators import textops


def broadcasts(df):
    """Columns of the sides that the planner broadcasts, and whether it sorts and merges anything."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return re.findall(r"BroadcastHashJoin .*", plan), "SortMergeJoin" in plan


@pytest.fixture
def texts(spark, tmp_path):
    """Few texts beside many names: by their files the texts are the smaller side, by their words they may be far larger."""
    spark.createDataFrame([(1, "An Bình gặp Hà Nội."), (2, "hà nội, An Bình"), (3, None)], "relation_id long, context string").coalesce(1).write.parquet(str(tmp_path / "texts"))
    rows = [("PLAYER", "An Bình", 1), ("CLUB", "an bình", 2), ("CLUB", "Hà Nội", 3)] + [("PLAYER", f"Người {i}", i) for i in range(10, 3000)]
    spark.createDataFrame(rows, "kind string, name string, wiki_id long").coalesce(1).write.parquet(str(tmp_path / "names"))
    return spark.read.parquet(str(tmp_path / "texts")), spark.read.parquet(str(tmp_path / "names"))


def test_texts_are_not_broadcast_for_mentions(texts):
    found = textops.dictionary_mentions(texts[0], "relation_id", "context", texts[1], "name", "wiki_id", ["kind"])
    joins, merged = broadcasts(found)
    assert merged and len(joins) == 1 and joins[0].split(", ")[3] == "BuildRight" and "_kind" in joins[0]
    assert {tuple(r) for r in found.collect()} == {(k, *e) for k in (1, 2) for e in (("PLAYER", 1), ("CLUB", 2), ("CLUB", 3))}


def test_texts_are_not_broadcast_for_spans(texts):
    found = textops.dictionary_spans(texts[0], "relation_id", "context", texts[1], "name", ["kind", "wiki_id"])
    joins, merged = broadcasts(found)
    assert merged and len(joins) == 1 and joins[0].split(", ")[3] == "BuildRight" and "_kind" in joins[0]
    assert {(r.relation_id, r.start_pos, r.wiki_id) for r in found.collect()} == {(1, 0, 1), (1, 0, 2), (1, 12, 3), (2, 0, 3), (2, 8, 1), (2, 8, 2)}


def test_leagues_that_differ_in_case(spark, tmp_path):
    from pitchlake.plans import enrichment

    spark.createDataFrame([("V Liga",), ("v liga",), ("Cup",), (None,)], "league string").write.parquet(str(tmp_path / "club_parsed.parquet"))
    spark.createDataFrame([(1, "về V LIGA."), (2, "khác"), (3, None)], "relation_id long, context string").write.parquet(str(tmp_path / "relation.parquet"))
    found = enrichment.context_competitions(spark, str(tmp_path))
    assert broadcasts(found)[1]
    assert {tuple(r) for r in found.collect()} == {(1, "V Liga"), (1, "v liga"), (2, None)}


@pytest.mark.parametrize("name", ["path_lengths", "small_world", "sampled_path_lengths"])
def test_searches_take_no_job_a_level(spark, tmp_path, monkeypatch, name):
    from pitchlake.operators import graph
    from pitchlake.plans import graph as queries

    spark.createDataFrame([(i, i, i + 1) for i in range(120)], "edge_id long, player1_id long, player2_id long").write.parquet(str(tmp_path / "teammate.parquet"))
    spark.createDataFrame([], "edge_id long, from_player_id long, to_club_id long").write.parquet(str(tmp_path / "played_for.parquet"))
    spark.createDataFrame([], "edge_id long, from_coach_id long, to_club_id long").write.parquet(str(tmp_path / "coached.parquet"))
    steps, checkpoint = [], graph.checkpoint
    monkeypatch.setattr(graph, "checkpoint", lambda df: steps.append(1) or checkpoint(df))
    row = tuple(getattr(queries, name)(spark, str(tmp_path)).first())
    assert len(steps) <= 3
    if name == "path_lengths":
        assert row == (round(122 / 3, 6), 120, 121 * 120)
    elif name == "small_world":
        assert row[0] == round(122 / 3, 6)
    else:
        assert row[1:3] == (15, 1)


def test_searches_in_parts_and_components():
    import numpy as np

    from pitchlake.operators import graph

    n = 400
    pairs = np.array([(0, i) for i in range(1, 150)] + [(i, i + 1) for i in range(140, 260)] + [(i, i + 1) for i in range(270, 399, 3)] + [(262, 263)], np.int32)
    near = [set() for _ in range(n)]
    for a, b in pairs.tolist():
        near[a].add(b)
        near[b].add(a)
    is_source, most = np.arange(n) % 3 > 0, 40
    want: dict[int, int] = {}
    for s in np.flatnonzero(is_source).tolist():
        level, reached, d = {s}, {s}, 0
        while level and d < most:
            level = {y for x in level for y in near[x]} - reached
            reached |= level
            d += 1
            if level:
                want[d] = want.get(d, 0) + len(level)
    got: dict[int, int] = {}
    for part in range(3):
        for d, k in graph.count_paths(pairs, is_source, part, 3, 1, most).items():
            got[d] = got.get(d, 0) + k
    assert got == want


@pytest.mark.parametrize(("listed", "table", "step"), [(1 << 14, 1 << 24, 1 << 16), (0, 1 << 24, 1 << 16), (0, 1 << 10, 1 << 6), (300, 1 << 10, 1 << 6)])
@pytest.mark.parametrize("most", [None, 2])
def test_searches_leave_out_ends(monkeypatch, most, listed, table, step):
    """A network, a chain, a hub, small components and nodes with one neighbour at all of them; only the others are searched."""
    import random

    import numpy as np

    from pitchlake.operators import graph

    for name, value in (("LISTED", listed), ("TABLE", table), ("STEP", step)):
        monkeypatch.setattr(graph, name, value, raising=False)
    rng = random.Random(5)
    pairs = {(rng.randrange(150), rng.randrange(150)) for _ in range(400)} | {(i, i + 1) for i in range(149, 190)} | {(0, i) for i in range(40, 140)}
    pairs |= {(200, 201), (201, 202), (202, 200), (204, 205), (206, 207), (207, 208)} | {(rng.randrange(190), i) for i in range(300, 600)}
    pairs = sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]})
    near: dict[int, set[int]] = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    is_source, want = np.arange(600) % 3 > 0, {}
    for s in (s for s in near if is_source[s]):
        level, reached, d = {s}, {s}, 0
        while level and d != most:
            level = {y for x in level for y in near[x]} - reached
            reached, d = reached | level, d + 1
            if level:
                want[d] = want.get(d, 0) + len(level)
    nodes, search = [], graph._search
    monkeypatch.setattr(graph, "_search", lambda first, *rest: nodes.append(len(first) - 1) or search(first, *rest))
    got: dict[int, int] = {}
    for part in range(3):
        for d, k in graph.count_paths(np.array(pairs, np.int32), is_source, part, 3, 2, most).items():
            got[d] = got.get(d, 0) + k
    assert got == want
    assert nodes and max(nodes) <= sum(len(x) > 1 for x in near.values()) + 2 + 600 - len(near)


@pytest.mark.parametrize("most", [3, 1])
def test_hot_self_join_shuffles_no_pairs(spark, monkeypatch, most):
    import random

    from pitchlake.operators import intervals

    monkeypatch.setattr(intervals, "WRITTEN_OUT", most)
    monkeypatch.setattr(intervals, "BLOCK", 7)
    rng = random.Random(3)
    year = lambda: rng.choice([None, 0, *range(1990, 2000)])  # noqa: E731  reversed and open bounds included
    rows = [(rng.randrange(25), rng.choice(["a", "b", None]), year(), year()) for _ in range(110)] + [(1, "a", 1990, 2 * 10**9), (None, "a", 1990, 1991)]
    rows = [r for i, r in enumerate(rows) if sum(q[:2] == r[:2] for q in rows[:i]) < 3]
    df = spark.createDataFrame(rows, "p long, g string, a int, b int")
    got = intervals.hot_self_join(df, "p", "g", "a", "b")
    s = sorted({(p, g, a or 1900, b or 2025) for p, g, a, b in rows if p is not None and g is not None})
    want = {}
    for p, g, a, b in s:
        for q, h, c, d in s:
            if g == h and p < q and a <= d and c <= b:
                want.setdefault((p, q, g), (max(a, c), min(b, d)))
    assert sorted(tuple(r) for r in got.collect()) == sorted((*k, *v) for k, v in want.items())
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "HashAggregate" not in plan.split("SortMergeJoin")[0] and "SortAggregate" not in plan.split("SortMergeJoin")[0]
