"""Every query of the library against its SQL, on the smallest tables, and plan checks of the large operators."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lecturelake.plans import registry

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_sql(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    rows = tables.execute(SQL[name])
    order = [[d[0] for d in rows.description].index(c) for c in columns]
    assert len(order) == len(rows.description)
    assert got == Counter(repr(tuple(plain(r[i]) for i in order)) for r in rows.fetchall())


@pytest.mark.parametrize("name", ["line_union", "substring_dedupe", "compare_board_speech", "report_lines", "roi_cascade", "paragraph_perplexity"])
def test_large_operators_have_no_nested_loops(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.isdir(SF)
