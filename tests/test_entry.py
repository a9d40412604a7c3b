"""The entry module: registered queries, oracles, independence of the text subpackage."""

import os
import re
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert len(queries) > 100 and set(oracle) <= set(queries)
    assert {"p1_found", "p4_found", "p6_found"} <= set(queries)


def test_core_stands_alone():
    code = "import sys; sys.modules['pitchlake.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p8_ids' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for folder, _, names in os.walk(os.path.join(ROOT, "pitchlake")):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert not re.search(r"^\s*(from|import) pitchlake\.llm", f.read(), re.M), n


@needs_data
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 20 and rows[0].teammates >= rows[-1].teammates


@needs_data
@pytest.mark.parametrize("name", ["teammate_edges", "under_coach_edges", "p4_found", "p6_found", "clustering", "first_by_key", "sentences", "pattern_relations", "path_lengths", "pair_checks", "yes_no_answers", "question_bank", "answered_questions", "strict_mentions", "matched_entities", "pending_changes", "false_memberships", "choice_questions", "graph_script", "grounds"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    df = entry.queries()[name](spark, SMALL)
    cursor = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    want = sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.collect()) == want


@needs_data
@pytest.mark.parametrize("name", ["p1_found", "p4_orphans_by_month", "p6_found", "question_bank", "pair_checks", "position_groups", "pagerank", "infobox_careers"])
def test_empty_tables(spark, tmp_path, name):
    for f in os.listdir(SMALL):
        spark.read.parquet(f"{SMALL}/{f}").limit(0).coalesce(1).write.parquet(str(tmp_path / f))
    assert entry.queries()[name](spark, str(tmp_path)).count() == 0
