"""Every registered drawing query against its SQL, on the smallest tables."""

import duckdb
import pytest

from sheetwise.plans import catalog, catalog_arcs, catalog_areas, catalog_blocks, catalog_geometry, catalog_healing, catalog_hosting, catalog_layers, catalog_library, catalog_openings, catalog_profiles, catalog_runs, catalog_symbols, catalog_templates, catalog_texts  # noqa: F401
from sheetwise.sources.driver_tables import TABLES


@pytest.fixture(scope="session")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


def plain(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small)
    expected = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    at = [expected.columns.index(c) for c in columns]
    rows = sorted(([plain(r[c]) for c in columns] for r in got.collect()), key=repr)
    assert rows == sorted(([plain(r[k]) for k in at] for r in expected.fetchall()), key=repr)
    assert rows or name in ("fit_bands", "eps_pairs", "floor_level_spacing", "stacked_storeys")  # few rows in small tables


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_storeys_stack_on_a_larger_table(spark):
    assert catalog.QUERIES["stacked_storeys"](spark, "/root/testdata/sf0.01").count() > 0
