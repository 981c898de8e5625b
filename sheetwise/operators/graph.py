"""Graph operators over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetwise.runtime import discard, materialize


def _with_least(edges: DataFrame) -> DataFrame:
    """Each edge (u, v) with the least of u and its neighbours. Hot nodes are summed before the shuffle and joined back."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("u", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    found = _with_least(edges)
    return found.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges`` (columns a, b of long, not null; loops count for nothing).

    The component is the least id that can be reached. Each round is written to the shared folder, so lost executors
    cost no more than one round; the number of rounds grows with the logarithm of a component's size. What is returned
    can be discarded like a materialized step.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark, before = seen, now
        now = materialize(_small_star(_large_star(now)), "edges")
        discard(before)
    out = now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out.written_to = now.written_to
    return out


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, depth) of a hierarchy (child, parent), each node being its own ancestor at depth 0.

    Paths double in each round, so the rounds grow with the logarithm of the depth; a cycle in the data raises.
    """
    edges = edges.filter("child is not null and parent is not null").distinct()
    nodes = edges.select(F.col("child").alias("node")).unionByName(edges.select(F.col("parent").alias("node"))).distinct()
    total = nodes.count()
    paths = materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "paths")
    reach = 1
    while True:
        if paths.filter("node = ancestor").limit(1).count():
            raise ValueError("the hierarchy has a cycle")
        upper = paths.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("depth").alias("more"))
        longer = paths.filter(F.col("depth") == reach).join(upper, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        longer = materialize(longer, "longer")
        if not longer.limit(1).count() or reach > total:
            break
        before, paths, reach = paths, materialize(paths.unionByName(longer).distinct(), "paths"), reach * 2
        discard(before, longer)
    return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).unionByName(paths)


def exclude_claims(primitives: DataFrame, claimed: DataFrame, edges: DataFrame) -> DataFrame:
    """``primitives`` (with source_id) but for those of claimed ids and all their descendants; ancestors stay."""
    below = closure(edges).join(claimed.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").select(F.col("node").alias("source_id"))
    taken = below.unionByName(claimed.select(F.col("id").alias("source_id"))).distinct()
    return primitives.join(taken, "source_id", "left_anti")


def junction_kinds(ends: DataFrame, keys: list[str]) -> DataFrame:
    """Degree and kind of each node of ``ends`` (keys, dx, dy: unit directions of wall ends that meet there):
    1 end, 2 collinear or L, 3 T, 4 and more X."""
    node = ends.groupBy(*keys).agg(F.count("*").alias("degree"), F.min(F.struct("dx", "dy")).alias("one"), F.max(F.struct("dx", "dy")).alias("two"))
    dot = F.abs(F.col("one.dx") * F.col("two.dx") + F.col("one.dy") * F.col("two.dy"))
    kind = F.when(F.col("degree") == 1, "end").when(F.col("degree") == 2, F.when(dot > 0.99, "collinear").otherwise("L")).when(F.col("degree") == 3, "T").otherwise("X")
    return node.select(*keys, "degree", kind.alias("kind"))


def prune_dangles(edges: DataFrame, shortest: float) -> DataFrame:
    """``edges`` (id, u, v, length) without those shorter than ``shortest`` that have a free end, to a fixpoint."""
    now = edges
    while True:
        ends = now.select(F.col("u").alias("n")).unionByName(now.select(F.col("v").alias("n"))).groupBy("n").agg(F.count("*").alias("k"))
        free = ends.filter("k = 1").select("n")
        loose = now.filter(F.col("length") < shortest).select("id", F.explode(F.array("u", "v")).alias("n")).join(free, "n", "left_semi").select("id").distinct()
        loose = materialize(loose, "loose")
        if not loose.limit(1).count():
            return now
        now = materialize(now.join(loose, "id", "left_anti"), "pruned")


def list_places(links: DataFrame, cycles: bool = False) -> DataFrame:
    """id, head and place (from 0) of every item of linked lists (id, prev; prev is null at a head), by pointer doubling.

    In each round an item takes over the pointer of the one it points to, so rounds grow with the logarithm of the longest
    list. Items that reached their head leave the loop; those still in it point to different ones, so no key is hot. Each
    round is written. An id twice, or two items behind one, raise ValueError; so does a cycle, unless ``cycles`` allows them:
    their items are left out then."""
    now = materialize(links.select("id", "prev", F.when(F.col("prev").isNull(), 0).otherwise(1).alias("hops")), "links")
    seen = now.agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count("prev").alias("behind"), F.count_distinct("prev").alias("prevs")).first()
    if seen["n"] > seen["ids"] or seen["behind"] > seen["prevs"]:
        raise ValueError("an item of a list has two neighbours on one side")
    done = [now.filter("prev is null").select("id", F.col("id").alias("head"), F.col("hops").alias("place"))]
    steps, left, n_left = [now], now.filter("prev is not null"), seen["behind"]
    while n_left:
        ends = done[0]
        for d in done[1:]:
            ends = ends.unionByName(d)
        # the pointed-to item either knows its head already or points on
        known = ends.select(F.col("id").alias("prev"), F.col("head").alias("to"), F.col("place").alias("more"), F.lit(True).alias("over"))
        on = left.select(F.col("id").alias("prev"), F.col("prev").alias("to"), F.col("hops").alias("more"), F.lit(False).alias("over"))
        step = materialize(left.join(known.unionByName(on), "prev").select("id", "to", (F.col("hops") + F.col("more")).alias("hops"), "over"), "doubled")
        steps.append(step)
        still = step.filter("not over").count()
        if still == n_left:  # in a list some item arrives in every round
            if cycles:
                break
            raise ValueError("a list has a cycle")
        done.append(step.filter("over").select("id", F.col("to").alias("head"), F.col("hops").alias("place")))
        left, n_left = step.filter("not over").select("id", F.col("to").alias("prev"), "hops"), still
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    whole = materialize(out, "places")
    discard(*steps)
    return whole
