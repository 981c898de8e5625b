import itertools
import random
import time

import pytest

from sheetwise.operators import harvest
from sheetwise.sources import snapshots


def test_matching_is_largest_then_heaviest(spark):
    rng = random.Random(3)
    for trial in range(3):
        pairs = {(0, rng.randrange(7), rng.randrange(7)): round(rng.random(), 3) for _ in range(16)}
        rows = [(*k, w) for k, w in pairs.items()]
        got = harvest.match(spark.createDataFrame(rows, "sheet_id long, ref_id long, pred_id long, weight double")).collect()
        assert len({r.ref_id for r in got}) == len({r.pred_id for r in got}) == len(got)
        best = (0, 0.0)
        for k in range(1, 8):
            for chosen in itertools.combinations(rows, k) if k <= 5 else []:
                if len({c[1] for c in chosen}) == len({c[2] for c in chosen}) == k:
                    best = max(best, (k, round(sum(c[3] for c in chosen), 6)))
        if len(got) <= 5:
            assert (len(got), round(sum(r.weight for r in got), 6)) == (best[0], pytest.approx(best[1]))
        else:
            assert len(got) > best[0]


def test_matching_of_a_large_component_ends():
    rng = random.Random(9)
    weights = {(rng.randrange(5000), rng.randrange(5000)): rng.choice((0.2, 0.25, 0.5)) for _ in range(9000)}
    began = time.monotonic()
    got = harvest._assigned(weights)
    assert time.monotonic() - began < 30
    of: dict = {}
    for a, b in weights:
        of.setdefault(a, []).append(b)
    mate: dict = {}
    for first in of:  # augmenting paths, breadth first
        came, todo, free = {}, [first], None
        for a in todo:
            for b in of[a]:
                if b not in came:
                    came[b] = a
                    if b not in mate:
                        free = b
                        break
                    todo.append(mate[b])
            if free is not None:
                break
        while free is not None:
            a = came[free]
            before = next((b for b, x in mate.items() if x == a), None)
            mate[free], free = a, before
    assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) == len(mate)


def test_greedy_claims(spark):
    rng = random.Random(5)
    rows = list({(k % 2, k, rng.randrange(30)) for k in range(40) for _ in range(2)})
    used, kept = set(), set()
    for e in range(40):
        ids = {(s, i) for s, x, i in rows if x == e}
        if not ids & used:
            used |= ids
            kept.add(e)
    got = harvest.greedy_disjoint(spark.createDataFrame(rows, "sheet_id long, element_id long, source_id long")).collect()
    assert {r.element_id for r in got} == kept


def test_greedy_claims_judges_every_element(spark, small):
    from sheetwise.plans import catalog, catalog_geometry  # noqa: F401
    from sheetwise.sources import driver_tables as t

    of: dict = {}
    for r in t.drawing(spark, small, t.CLAIMS).collect():
        of.setdefault((r.sheet_id, r.element_id), set()).add((r.sheet_id, r.source_id))
    used, kept = set(), set()
    for k in sorted(of, key=lambda k: k[1]):
        if not of[k] & used:
            used |= of[k]
            kept.add(k)
    got = [tuple(r) for r in catalog.QUERIES["greedy_claims"](spark, small).select("sheet_id", "element_id").collect()]
    assert len(got) == len(set(got)) and set(got) == kept


def test_greedy_claims_in_chains(spark):
    rows = [(1, e, i) for e in range(50) for i in (e, e + 1)] + [(1, 99, None), (2, 7, 3)]
    got = harvest.greedy_disjoint(spark.createDataFrame(rows, "sheet_id long, element_id long, source_id long")).collect()
    assert sorted(map(tuple, got)) == [(1, e) for e in range(0, 50, 2)] + [(1, 99), (2, 7)]


def test_freeze_and_replay(spark, tmp_path):
    d = spark.createDataFrame([(1, "a", None), (2, None, 1.5)], "k long, name string, x double")
    snapshots.freeze({"walls": d, "none": d.limit(0)}, f"{tmp_path}/s")
    back = snapshots.replay(spark, f"{tmp_path}/s")
    assert sorted(back["walls"].collect()) == sorted(d.collect()) and back["none"].count() == 0
    with pytest.raises(Exception, match="exist"):
        snapshots.freeze({"walls": d}, f"{tmp_path}/s")
    d.limit(1).write.mode("append").parquet(f"{tmp_path}/s/walls")
    with pytest.raises(ValueError, match="walls"):
        snapshots.replay(spark, f"{tmp_path}/s")


def test_stream_equals_table(spark, small, tmp_path):
    from sheetwise.streaming import inventory

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    stream = inventory.windowed_counts(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    run = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start()
    run.awaitTermination()
    key = lambda r: (r.window_start, r.event_type, r.n, r.total)
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, inventory.windowed_counts(events).collect()))
