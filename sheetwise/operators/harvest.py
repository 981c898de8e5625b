"""Symbols: families of instances, library use, greedy and unique claims, matching."""

from __future__ import annotations

from functools import reduce
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheetwise.operators.graph import components
from sheetwise.runtime import dealt, materialize, ship_package


def families(parts: DataFrame, least: int = 8, named: tuple[str, ...] = ()) -> DataFrame:
    """Instances (instance_id, kind, part, size) grouped by their sorted parts: key, number, size range widened to 0.75 and
    1.25 of its ends; kept from ``least`` instances on or for a named kind."""
    each = parts.groupBy("instance_id", "kind").agg(F.array_join(F.array_sort(F.collect_list("part")), ",").alias("family"), F.max("size").alias("size"))
    sums = each.groupBy("family").agg(F.count("*").alias("n"), F.round(F.min("size") * 0.75, 6).alias("smallest"), F.round(F.max("size") * 1.25, 6).alias("largest"), F.max(F.col("kind").isin(*named) if named else F.lit(False)).alias("_named"))
    return sums.filter((F.col("n") >= least) | F.col("_named")).drop("_named")


def library_use(templates: DataFrame, instances: DataFrame) -> DataFrame:
    """Per template its instances, mirrored ones, sizes and angles counted by quarter turns; unused ones have zeros."""
    angle = lambda a: F.sum(F.when(F.col("angle") == a, 1).otherwise(0)).cast("long").alias(f"angle_{a}")
    used = instances.groupBy("template_id").agg(F.count("*").alias("n"), F.sum(F.col("mirrored").cast("long")).alias("n_mirrored"), F.min("size").alias("min_size"), F.median("size").alias("median_size"), F.max("size").alias("max_size"), *map(angle, (0, 90, 180, 270)))
    return templates.select("template_id").join(used, "template_id", "left").na.fill(0, ["n", "n_mirrored", *[f"angle_{a}" for a in (0, 90, 180, 270)]])


def greedy_disjoint(claims: DataFrame) -> DataFrame:
    """Elements of (sheet_id, element_id, source_id) taken in order of their ids where no id of theirs is taken yet.

    In each round an element is taken if it is the least undecided claimant of all its ids, and those that share an id with
    it are dropped; this is what the order gives. Rounds are written to the shared folder, and no task sees more than one
    id's or one element's sums. The number of rounds is that of the longest chain of ever larger ids that wait for each
    other: few where ids are not in the order of such chains, half a chain's length at worst.
    """
    keys = ["sheet_id", "element_id"]
    whole = F.col("sheet_id").isNotNull() & F.col("element_id").isNotNull() & F.col("source_id").isNotNull()
    # without an id nothing can be shared
    kept = [claims.groupBy(*keys).agg(F.max(whole).alias("any")).filter("not any").select(*keys)]
    left = materialize(claims.filter(whole).select(*keys, "source_id").distinct(), "undecided")
    while left.limit(1).count():
        least = left.groupBy("sheet_id", "source_id").agg(F.min("element_id").alias("first"))
        taken = left.join(least, ["sheet_id", "source_id"]).groupBy(*keys).agg(F.min("first").alias("first")).filter("first = element_id").select(*keys)
        kept.append(materialize(taken, "taken"))
        used = left.join(kept[-1], keys, "left_semi").select("sheet_id", "source_id")
        settled = left.join(used.distinct(), ["sheet_id", "source_id"], "left_semi").select(*keys).distinct()
        left = materialize(left.join(settled, keys, "left_anti"), "undecided")
        if len(kept) > 20:  # keeps the plan short
            kept = [materialize(reduce(DataFrame.unionByName, kept), "taken")]
    return reduce(DataFrame.unionByName, kept)


def _assigned(weights: dict[tuple[int, int], float]) -> list[tuple[int, int]]:
    """The pairs of a matching with most pairs and, among these, most weight: each reference in turn takes the cheapest
    alternating path (Dijkstra over costs less potentials, which ends at the first free prediction) to a prediction, or
    to having none. Costs are whole numbers, so that ties are ties; having none costs more than all that pairs could."""
    unit = 1 << 52
    gains = {k: round(w * unit) for k, w in weights.items()}
    most = max(gains.values())
    of: dict[int, list[tuple[int, int]]] = {}
    for (a, b), gain in sorted(gains.items()):
        of.setdefault(a, []).append((b, most - gain))
    none = 1 + len(of) * (most - min(gains.values()))
    rows, cols, mate, back = dict.fromkeys(of, 0), {b: 0 for _, b in gains}, {}, {}
    for first in of:
        heap, far, came, seen = [], {}, {}, {}
        a, at, end, stop = first, 0, None, None
        reached = [(first, 0)]
        while True:
            if stop is None or at + none - rows[a] < stop:  # a may go without
                stop, end = at + none - rows[a], (a, None)
            for b, cost in of[a]:
                d = at + cost - rows[a] - cols[b]
                if d < stop and d < far.get(b, stop):
                    far[b], came[b] = d, a
                    heappush(heap, (d, b))
            while heap and (heap[0][1] in seen or heap[0][0] > far[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= stop:
                break
            at, b = heappop(heap)
            if b not in mate:
                stop, end = at, (came[b], b)
                break
            seen[b], a = at, mate[b]
            reached.append((a, at))
        for a, d in reached:
            rows[a] += stop - d
        for b, d in seen.items():
            cols[b] -= stop - d
        a, b = end
        while True:  # along the path each reference takes its new prediction and gives its old one to the one before
            before = back.get(a)
            if b is None:
                back.pop(a, None)
            else:
                mate[b], back[a] = a, b
            if a == first:
                break
            a, b = came[before], before
    return sorted((a, b) for b, a in mate.items())


def match(pairs: DataFrame) -> DataFrame:
    """A matching of (sheet_id, ref_id, pred_id, weight) with most pairs and, among these, most weight. Components are
    solved apart: one around a single reference or prediction takes its best pair, others are solved whole, one in a task."""
    ship_package(pairs.sparkSession)
    pairs = materialize(pairs.select("sheet_id", "ref_id", "pred_id", F.col("weight").cast("double").alias("weight")), "pairs")
    # references and predictions get ids of different parity, so that the two sides never meet
    edges = pairs.select((F.col("ref_id") * 2).alias("a"), (F.col("pred_id") * 2 + 1).alias("b"))
    label = components(edges).withColumnsRenamed({"component": "part"})
    each = materialize(pairs.withColumn("id", F.col("ref_id") * 2).join(label, "id").drop("id"), "parts")
    best = F.max_by(F.struct("sheet_id", "ref_id", "pred_id", "weight"), F.struct("weight", -F.col("ref_id"), -F.col("pred_id")))
    star = (F.min("ref_id") == F.max("ref_id")) | (F.min("pred_id") == F.max("pred_id"))
    stars = each.groupBy("part").agg(star.alias("star"), best.alias("p")).filter("star")

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        weights = dict(zip(zip(group.ref_id.tolist(), group.pred_id.tolist()), group.weight.tolist(), strict=True))
        sheet = dict(zip(group.ref_id.tolist(), group.sheet_id.tolist(), strict=True))
        return pd.DataFrame([(sheet[a], a, b, weights[a, b]) for a, b in _assigned(weights)], columns=["sheet_id", "ref_id", "pred_id", "weight"])

    # dealt: adaptive planning sees few bytes, not the work in them
    solved = dealt(each, "part").join(stars.select("part"), "part", "left_anti").groupBy("part").applyInPandas(solve, "sheet_id long, ref_id long, pred_id long, weight double")
    return solved.unionByName(stars.select("p.*"))


def number_by_kind(elements: DataFrame, letters: dict[str, str], order: list[str]) -> DataFrame:
    """Labels W1, W2, D1 ... per sheet and kind, with an empty verdict to fill in."""
    mapping = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in letters.items()], F.lit("X"))
    number = F.row_number().over(Window.partitionBy("sheet_id", "kind").orderBy(*order))
    return elements.withColumns({"label": F.concat(mapping, number.cast("string")), "verdict": F.lit(None).cast("string")})
