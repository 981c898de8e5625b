"""Faces, loops and node clusters of wall graphs. Edges are (sheet_id, edge_id, ax, ay, bx, by) between exact nodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.graph import components, prune_dangles
from sheetwise.runtime import ship_package


def with_nodes(edges: DataFrame) -> DataFrame:
    """Adds u and v: ids of the end nodes by their exact place on the sheet."""
    node = lambda x, y: F.xxhash64("sheet_id", F.round(x, 9) + 0.0, F.round(y, 9) + 0.0)
    return edges.withColumns({"u": node(F.col("ax"), F.col("ay")), "v": node(F.col("bx"), F.col("by")), "length": F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))}).filter("u <> v")


def polygonise(edges: DataFrame) -> DataFrame:
    """Bounded faces of a noded edge table: sheet_id, face_id, n_edges, area. Edges with a free end bound no face and are
    pruned first. Each half-edge is followed by the next one clockwise at its end; the cycles of that step are faces, and
    the outer side of each connected part has a negative area."""
    known = with_nodes(edges)
    core = prune_dangles(known.select(F.col("edge_id").alias("id"), "sheet_id", "u", "v", "length", "ax", "ay", "bx", "by"), float("inf"))
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    one = core.select((F.col("id") * 2).alias("h"), "sheet_id", F.col("u").alias("node"), *ends)
    two = core.select((F.col("id") * 2 + 1).alias("h"), "sheet_id", F.col("v").alias("node"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    half = one.unionByName(two)
    angle = F.atan2(F.col("by") - F.col("ay"), F.col("bx") - F.col("ax"))
    around = Window.partitionBy("sheet_id", "node").orderBy(angle, "h")
    turned = half.withColumn("before", F.coalesce(F.lag("h").over(around), F.last("h").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    follows = turned.select(F.expr("h ^ 1").alias("a"), F.col("before").alias("b"))
    label = components(follows)
    alone = half.join(label.withColumnsRenamed({"id": "h", "component": "face_id"}), "h")
    area = F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2
    return alone.groupBy("sheet_id", "face_id").agg(F.count("*").alias("n_edges"), F.round(area, 6).alias("area")).filter("area > 1e-9")


def loops(edges: DataFrame) -> DataFrame:
    """Biconnected components of three edges or more, of each connected part: sheet_id, edge_id, loop (its least edge) and
    the loop's extent. A part is one group, as depth-first search is sequential."""
    ship_package(edges.sparkSession)
    known = with_nodes(edges)
    parts = components(known.select(F.col("u").alias("a"), F.col("v").alias("b")))
    grouped = known.join(parts.withColumnsRenamed({"id": "u", "component": "part"}), "u")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        at = {}
        for e in group.itertuples():
            near.setdefault(e.u, []).append((e.v, e.edge_id))
            near.setdefault(e.v, []).append((e.u, e.edge_id))
            at[e.edge_id] = (e.ax, e.ay, e.bx, e.by)
        order, low, rows, stack = {}, {}, [], []
        for root in near:
            if root in order:
                continue
            order[root] = low[root] = len(order)
            walk = [(root, None, iter(near[root]))]
            while walk:
                node, by, rest = walk[-1]
                for other, edge in rest:
                    if edge == by:
                        continue
                    if other not in order:
                        stack.append(edge)
                        order[other] = low[other] = len(order)
                        walk.append((other, edge, iter(near[other])))
                        break
                    if order[other] < order[node]:
                        stack.append(edge)
                        low[node] = min(low[node], order[other])
                else:
                    walk.pop()
                    if walk:
                        above = walk[-1][0]
                        low[above] = min(low[above], low[node])
                        if low[node] >= order[above]:
                            block = []
                            while True:
                                block.append(stack.pop())
                                if block[-1] == by:
                                    break
                            if len(block) >= 3:
                                xs = [x for e in block for x in at[e][::2]]
                                ys = [y for e in block for y in at[e][1::2]]
                                size = max(max(xs) - min(xs), max(ys) - min(ys))
                                rows += [(group.sheet_id.iloc[0], e, min(block), round(size, 6)) for e in block]
        return pd.DataFrame(rows, columns=["sheet_id", "edge_id", "loop", "extent"])

    return grouped.groupBy("part").applyInPandas(search, "sheet_id long, edge_id long, loop long, extent double")


def closure_signal(edges: DataFrame, least_extent: float = 10.0) -> DataFrame:
    """Each edge's closure: 1 in a loop of at least the extent, -1 in a smaller one, 0 in none."""
    found = loops(edges).groupBy("sheet_id", "edge_id").agg(F.max("extent").alias("extent"))
    signal = F.when(F.col("extent").isNull(), 0).when(F.col("extent") >= least_extent, 1).otherwise(-1)
    return edges.select("sheet_id", "edge_id").join(found, ["sheet_id", "edge_id"], "left").select("sheet_id", "edge_id", signal.alias("closure"))


def cluster_ends(ends: DataFrame, snap: float) -> DataFrame:
    """Wall ends (sheet_id, end_id, wall_id, x, y) in complete-link clusters: in order of x, y and id an end joins the first
    cluster all of whose members are within ``snap`` and of other walls. Returns each end's cluster (its least end) and
    the mean of the cluster's distinct points. Ends that no chain of steps of ``snap`` joins never meet in one group."""
    from sheetwise.operators.spatial import eps_pairs

    ship_package(ends.sparkSession)
    near = eps_pairs(ends.select("sheet_id", F.col("end_id").alias("point_id"), "x", "y"), snap)
    part = components(near.select("a", "b")).withColumnsRenamed({"id": "end_id", "component": "part"})
    each = ends.join(part, "end_id", "left")
    alone = each.filter("part is null").select("sheet_id", "end_id", F.col("end_id").alias("cluster"), F.round("x", 9).alias("cx"), F.round("y", 9).alias("cy"))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        clusters: list[list] = []
        for e in group.sort_values(["x", "y", "end_id"]).itertuples():
            for c in clusters:
                if all((e.x - o.x) ** 2 + (e.y - o.y) ** 2 <= (snap + 1e-9) ** 2 and e.wall_id != o.wall_id for o in c):
                    c.append(e)
                    break
            else:
                clusters.append([e])
        rows = []
        for c in clusters:
            points = {(o.x, o.y) for o in c}
            cx, cy = (round(sum(p[k] for p in points) / len(points), 9) for k in (0, 1))
            rows += [(o.sheet_id, o.end_id, min(q.end_id for q in c), cx, cy) for o in c]
        return pd.DataFrame(rows, columns=["sheet_id", "end_id", "cluster", "cx", "cy"])

    return alone.unionByName(each.filter("part is not null").groupBy("part").applyInPandas(fold, "sheet_id long, end_id long, cluster long, cx double, cy double"))


def joint_levels(edges: DataFrame, most: int = 100) -> DataFrame:
    """Longest-path level of each node of an acyclic (upper, lower) table; raises beyond ``most`` levels."""
    from sheetwise.runtime import discard, materialize

    nodes = edges.select(F.col("upper").alias("node")).unionByName(edges.select(F.col("lower").alias("node"))).distinct()
    level = nodes.withColumn("level", F.lit(0))
    written = []
    for step in range(1, most + 2):
        reached = edges.join(level.filter(F.col("level") == step - 1).select(F.col("node").alias("upper")), "upper", "left_semi").select(F.col("lower").alias("node")).distinct()
        reached = materialize(reached, "levels")
        if not reached.limit(1).count():
            discard(reached)
            return level
        level = materialize(level.join(reached.withColumn("_hit", F.lit(True)), "node", "left").select("node", F.when(F.col("_hit"), F.lit(step)).otherwise(F.col("level")).alias("level")), "levels")
        discard(reached, *written)  # the new levels are written, nothing reads the old ones
        written = [level]
    raise ValueError(f"more than {most} levels, or a cycle")
