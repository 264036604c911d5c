"""Every query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import importlib
from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
MODULES = [importlib.import_module(f"rasterlines.plans.{m}") for m in ("recognition", "regions", "rasters", "admission", "contracts", "pages", "photographs", "graphs", "requests")]
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query_matches_sql(spark, duck, module, name):
    found = module.QUERIES[name](spark, str(DATA))
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in found.collect())
    if name not in module.QUERIES_SQL:
        assert rows
        return
    want = duck.sql(module.QUERIES_SQL[name])
    assert sorted(want.columns) == columns
    assert rows == sorted(map(repr, want.select(", ".join(f'"{c}"' for c in columns)).fetchall()))


def test_pages_are_dealt_to_all_tasks(spark):
    from rasterlines.plans import pages

    found = pages.generated_pages(spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism


def test_page_json_parses_each_document_once(spark):
    from rasterlines.plans import contracts

    plan = contracts.page_json(spark, str(DATA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
