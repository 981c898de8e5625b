"""Claims are dealt in number with the rows of the tables, and the answers don't change with it."""

from pyspark.sql import functions as F

from sheetwise.operators import sets
from sheetwise.sources import driver_tables as t


def test_claims_are_dealt_by_rows(spark, small, monkeypatch):
    monkeypatch.setattr(t, "ROWS_A_TASK", 200)
    n = t.parts(spark, small)
    claims = t.drawing(spark, small, t.CLAIMS)
    assert n > 20 and claims.rdd.getNumPartitions() == n
    assert sets.keyed_override(claims, ["sheet_id", "source_id"], F.desc("element_id"), n).rdd.getNumPartitions() == n
    doors, others = claims.filter("kind = 'door'"), claims.filter("kind <> 'door'")
    for dealt, plain in ((sets.unique_claims(claims, n), sets.unique_claims(claims)), (sets.override_union(others, doors, n), sets.override_union(others, doors))):
        assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, plain.collect()))
