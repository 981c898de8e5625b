"""Biconnected parts of large graphs in Spark rounds, and the evidence that walls have from what they touch.

No part of a graph is one task's work: a spanning forest by the least edge out of each tree, its Euler tour ranked by
pointer doubling, the least and greatest place that a subtree reaches from a table of doubling ranges, and connected
components of tree edges that lie on a common circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.functions.geometry import computed, distance_to_segment
from sheetwise.operators.graph import components, list_places
from sheetwise.operators.openings import line_cells
from sheetwise.runtime import discard, materialize

#: Slack of ends that touch, the extent of a building's loop, and scores of no, one and two joined ends.
SLACK_FT, LOOP_FT, JOINED = 1 / 12, 10.0, (-1.0, 0.3, 1.0)
#: Scores of a thickness that is known and of one that isn't.
KNOWN, UNKNOWN, PICO_FT = 1.0, -0.5, 1e-12


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tree edges a < b, labels id and root) of distinct edges a < b. Each round every tree takes its least edge to another
    one; the order of edges being total, no circle arises, and trees at least halve in number."""
    labels = materialize(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id")), "labels")
    trees, crossing = [], edges
    while True:
        of = lambda end: labels.select(F.col("id").alias(end), F.col("root").alias(f"root_{end}"))
        last, out = crossing, materialize(crossing.select("a", "b").join(of("a"), "a").join(of("b"), "b").filter("root_a <> root_b"), "crossing")
        if last is not edges:
            discard(last)
        if out.isEmpty():
            break
        each = out.select(F.explode(F.array("root_a", "root_b")).alias("tree"), F.struct("a", "b", "root_a", "root_b").alias("e"))
        chosen = materialize(each.groupBy("tree").agg(F.min("e").alias("e")).select("e.*").distinct(), "chosen")
        joined = components(chosen.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
        now = labels.join(joined.withColumnsRenamed({"id": "root", "component": "to"}), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
        before, labels = labels, materialize(now, "labels")
        discard(before, joined)
        trees.append(chosen)
        crossing = out  # an edge within a tree never leaves it
    if not trees:
        return edges.limit(0), labels
    tree = edges.sparkSession.read.schema(trees[0].schema).parquet(*[t.written_to for t in trees]).select("a", "b")
    return tree, labels


def _toured(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """id, parent, root, pre and last of every node but the roots: its place in an Euler tour of its tree and the last place
    below it. Places needn't follow each other without gaps."""
    arcs = tree.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(tree.select(F.col("b").alias("u"), F.col("a").alias("v")))
    around = Window.partitionBy("u").orderBy("v")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = arcs.withColumns({"before": F.lag("v").over(around), "last_v": F.last("v").over(whole)}).join(labels.withColumnRenamed("id", "u"), "u")
    start = (F.col("u") == F.col("root")) & F.col("before").isNull()
    arc = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    # an arc out of u follows the one that came in from the neighbour before it, in a circle but for the tour's start
    d = d.withColumn("came", F.coalesce("before", "last_v")).select(arc("u", "v").alias("id"), F.when(~start, arc("came", "u")).alias("prev"))
    places = list_places(d).select("id.u", "id.v", "place")
    back = places.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("place").alias("back"))
    down = places.join(back, ["u", "v"]).filter("place < back")
    return down.select(F.col("v").alias("id"), F.col("u").alias("parent"), (F.col("place") + 1).alias("pre"), F.col("back").alias("last")).join(labels, "id")


def _reached(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """id, low and high: the least and greatest of ``values`` (root, pos, lo, hi) from pre to last of each node. Ranges of twice
    the length are made of two, and every node's range is covered by two of one length."""
    longest = nodes.agg(F.max(F.col("last") - F.col("pre") + 1)).first()[0]
    if longest is None:
        return nodes.select("id", F.col("pre").alias("low"), F.col("pre").alias("high"))
    levels, reach = [materialize(values.withColumn("level", F.lit(0)), "ranges")], 1
    while reach * 2 <= longest:
        one = levels[-1].drop("level")
        two = one.select("root", (F.col("pos") - reach).alias("pos"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        both = one.join(two, ["root", "pos"], "left").select("root", "pos", F.least("lo", "lo2").alias("lo"), F.greatest("hi", "hi2").alias("hi"), F.lit(len(levels)).alias("level"))
        levels.append(materialize(both, "ranges"))
        reach *= 2
    table = nodes.sparkSession.read.schema(levels[0].schema).parquet(*[x.written_to for x in levels])
    level = F.floor(F.log2((F.col("last") - F.col("pre") + 1).cast("double")) + 1e-12).cast("int")
    asked = nodes.select("id", "root", "pre", "last", level.alias("level"))
    both = asked.select("id", "root", "level", F.explode(F.array(F.col("pre").cast("long"), F.col("last").cast("long") - F.pow(F.lit(2.0), "level").cast("long") + 1)).alias("pos"))
    found = both.join(table.withColumn("pos", F.col("pos").cast("long")), ["root", "level", "pos"]).groupBy("id").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
    out = materialize(found, "reached")
    discard(*levels)
    return out


def biconnected(edges: DataFrame) -> DataFrame:
    """(block, node) of every biconnected part of a graph with edges (a, b), of two nodes or more; a node that parts meet in
    is in each. Loops and repeated edges count for nothing; a node alone has no part."""
    clean = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "graph")
    tree, labels = spanning_forest(clean)
    nodes = materialize(_toured(tree, labels), "toured")
    roots = labels.filter("id = root").select("id", F.lit(0).cast("int").alias("pre"), "root")
    pre = nodes.select("id", "pre", "root").unionByName(roots)
    rest = clean.join(tree, ["a", "b"], "left_anti")
    at = lambda end, d: d.select(F.col("id").alias(end), F.col("pre").alias(f"pre_{end}"))
    rest = materialize(rest.join(at("a", pre), "a").join(at("b", pre), "b"), "other-edges")
    seen = rest.select(F.col("a").alias("id"), F.col("pre_b").alias("to")).unionByName(rest.select(F.col("b").alias("id"), F.col("pre_a").alias("to")))
    own = nodes.select("id", "root", "pre").join(seen.groupBy("id").agg(F.min("to").alias("l"), F.max("to").alias("h")), "id", "left")
    values = own.select("root", F.col("pre").alias("pos"), F.least("pre", "l").alias("lo"), F.greatest("pre", "h").alias("hi"))
    up = nodes.select("root", (F.col("last") + 1).alias("pos"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))  # places of the way back hold no node
    reached = _reached(nodes, values.unionByName(up))
    last = nodes.select("id", "pre", "last")
    span = lambda end: last.select(F.col("id").alias(end), F.col("pre").alias(f"first_{end}"), F.col("last").alias(f"last_{end}"))
    apart = rest.join(span("a"), "a").join(span("b"), "b").filter((F.col("last_a") < F.col("first_b")) | (F.col("last_b") < F.col("first_a"))).select("a", "b")
    below = nodes.select("id", "parent").join(reached, "id").join(last.select(F.col("id").alias("parent"), F.col("pre").alias("first"), F.col("last").alias("end")), "parent")
    over = below.filter((F.col("low") < F.col("first")) | (F.col("high") > F.col("end"))).select(F.col("parent").alias("a"), F.col("id").alias("b"))
    joined = components(apart.unionByName(over))
    blocks = nodes.select("id", "parent").join(joined, "id", "left").withColumn("block", F.coalesce("component", "id"))
    return materialize(blocks.select("block", F.explode(F.array("id", "parent")).alias("node")).distinct(), "blocks")


def touching_walls(walls: DataFrame, cell: float = 10.0) -> DataFrame:
    """sheet_id, wall_id, end (0 or 1) and other: the walls that come near the ends of each wall (sheet_id, wall_id, x0, y0, x1,
    y1, thickness_ft), by the greater thickness of both and ``SLACK_FT``. Ids are unique over all sheets."""
    reach = float(walls.agg(F.max("thickness_ft")).first()[0] or 0.0) + SLACK_FT
    wall = [F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]
    spread = walls.select("sheet_id", F.col("wall_id").alias("other"), *[c.alias(n) for c, n in zip(wall, ("cx0", "cy0", "cx1", "cy1"))], F.col("thickness_ft").alias("t"), F.explode(line_cells(*wall, F.lit(reach), cell)).alias("c"))
    spread = spread.select("sheet_id", "other", "cx0", "cy0", "cx1", "cy1", "t", "c.cx", "c.cy")
    end = lambda k: F.struct(F.lit(k).alias("end"), wall[2 * k].alias("x"), wall[2 * k + 1].alias("y"))
    ends = walls.select("sheet_id", "wall_id", "thickness_ft", F.explode(F.array(end(0), end(1))).alias("e")).select("sheet_id", "wall_id", "thickness_ft", "e.*")
    placed = ends.withColumns({"cx": F.floor(F.col("x") / cell).cast("long"), "cy": F.floor(F.col("y") / cell).cast("long")})
    d = placed.join(spread, ["sheet_id", "cx", "cy"]).filter("wall_id <> other")
    d = computed(d, away=distance_to_segment(F.col("x"), F.col("y"), *[F.col(f"c{c}") for c in ("x0", "y0", "x1", "y1")]))
    return d.filter(F.col("away") <= F.greatest("thickness_ft", "t") + SLACK_FT + PICO_FT).select("sheet_id", "wall_id", "end", "other")


def wall_signals(walls: DataFrame, modes: tuple[float, ...] = (), tolerance_ft: float = 0.0) -> DataFrame:
    """sheet_id, wall_id and three signals of walls (and source_ids). connectivity: by how many ends touch a wall of other
    sources. closure: 1 in a loop of touching walls (a biconnected part of three or more) as large as a building's, -1 only in
    smaller ones, 0 in none. thickness: whether it is one of ``modes``, 0 where none are known."""
    walls = materialize(walls.select("sheet_id", "wall_id", "x0", "y0", "x1", "y1", "thickness_ft", "source_ids"), "signal-walls")
    met = materialize(touching_walls(walls), "touching")
    sources = walls.select("wall_id", "source_ids")
    own = met.join(sources, "wall_id").join(sources.select(F.col("wall_id").alias("other"), F.col("source_ids").alias("others")), "other")
    joined = own.filter(~F.arrays_overlap("source_ids", "others")).select("wall_id", "end").distinct().groupBy("wall_id").agg(F.count("*").alias("n"))
    blocks = biconnected(met.select(F.col("wall_id").alias("a"), F.col("other").alias("b")))
    box = walls.select(F.col("wall_id").alias("node"), F.least("x0", "x1").alias("l"), F.greatest("x0", "x1").alias("r"), F.least("y0", "y1").alias("d"), F.greatest("y0", "y1").alias("u"))
    extent = F.greatest(F.max("r") - F.min("l"), F.max("u") - F.min("d"))
    loops = blocks.join(box, "node").groupBy("block").agg(F.count("*").alias("n"), extent.alias("extent")).filter("n > 2")
    closed = blocks.join(loops, "block").groupBy(F.col("node").alias("wall_id")).agg(F.max(F.when(F.col("extent") >= LOOP_FT, 1.0).otherwise(-1.0)).alias("closure"))
    known = F.lit(0.0) if not modes else F.when(F.exists(F.array(*[F.lit(float(m)) for m in modes]), lambda m: F.abs(F.col("thickness_ft") - m) <= tolerance_ft + PICO_FT), KNOWN).otherwise(UNKNOWN)
    ends = F.coalesce("n", F.lit(0))
    connectivity = F.when(ends == 0, JOINED[0]).when(ends == 1, JOINED[1]).otherwise(JOINED[2])
    d = walls.select("sheet_id", "wall_id", "thickness_ft").join(joined, "wall_id", "left").join(closed, "wall_id", "left")
    return d.select("sheet_id", "wall_id", connectivity.alias("connectivity"), F.coalesce("closure", F.lit(0.0)).alias("closure"), known.alias("thickness"))
