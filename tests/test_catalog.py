"""Every registered query against its SQL twin on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from compare import TABLES, rows_of  # noqa: E402
from plansift import catalog, views as V  # noqa: E402

SF = "/root/testdata/sf0.001"
catalog.load_all()

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(catalog.ORACLE[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_row_ids_are_unique(spark, sf):
    folder = f"/root/testdata/{sf}"
    for view, key in ((V.walls, "wall_id"), (V.raw_walls, "wall_id"), (V.openings, "opening_id")):
        rows = view(spark, folder)
        assert rows.select("plan_id", key).distinct().count() == rows.count()
        assert rows.select("plan_id", "ord").distinct().count() == rows.count()


def test_contract():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
