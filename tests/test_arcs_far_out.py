"""Chains of lines far from the origin, where the last digits of coordinates decide what is a door's arc, against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sheetwise.operators import arcs
from sheetwise.plans import catalog, catalog_arcs  # noqa: F401  the second registers its queries

#: Sites whose radius is 5 ft, the greatest of a door, and ends 300,000 ft off; eight runs of the SQL gave the same arcs on all.
SITES = (698128, 800608, 622948, 735388, 789328, 720628, 612868, 703468, 835888, 834328, 728368, 734368)


@pytest.mark.parametrize("name", ["arc_chains", "swing_doors"])  # F2, F4
def test_arcs_on_a_bound_equal_sql(spark, tmp_path, name):
    spark.createDataFrame([(k, k % 25) for k in SITES], "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    got, expected = catalog.QUERIES[name](spark, str(tmp_path)), con.sql(catalog.ORACLE_SQL[name])
    rows = sorted((tuple(r) for r in got.select(*expected.columns).collect()), key=repr)
    assert rows == sorted((tuple(r) for r in expected.fetchall()), key=repr)
    assert len(rows) >= 1


# F2
def test_the_order_of_pieces_changes_no_arc(spark):
    k, at = F.col("id") % 1000, F.col("id") % 1000 * 450.0
    start, step = k % 12 / 2, F.lit(-1.5707963267948966 / 9)
    point = lambda i, c: F.round((at if c == "y" else k % 60 * 30.0) + 5.0 * (F.cos(start + step * i) if c == "x" else F.sin(start + step * i)), 9)
    place = F.floor(F.col("id") / 1000)
    pieces = spark.range(9000).select((k % 25).alias("sheet_id"), k.alias("chain_id"), place.alias("place"), *[point(place + n, c).alias(f"{p}{c}") for p, n in (("a", 0), ("b", 1)) for c in "xy"])
    orders = [pieces.coalesce(1).sortWithinPartitions(v) for v in (F.col("place"), F.desc("place"), F.hash("place", "chain_id"))]
    fitted = [sorted(tuple(r) for r in arcs.fit_arcs(d).select("chain_id", "arc", "radius", "sweep").collect()) for d in orders]
    assert fitted[0] == fitted[1] == fitted[2] and len(fitted[0]) == 1000
    assert {arc for _, arc, *_ in fitted[0]} == {False, True}  # the radius is the bound itself
