"""Registered queries about walls on profiles, at turned sites. The SQL reckons in each wall's own frame, where straight
profiles are boxes: it joins the cells between all edges up and down, then along."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetwise.operators import profiles
from sheetwise.plans.catalog import query
from sheetwise.sources.driver_tables import drawing

#: Walls from (ox, oy) along (c, s), l long and t thick, each at a site of one of nine kinds.
#: Sites are off whole numbers by a little, so that no coordinate lies halfway between two that rounding may choose.
_SITES = """SELECT c_custkey AS k, CAST(c_nationkey AS BIGINT) AS sheet_id, c_custkey % 9 AS kind, CAST(c_custkey % 40 * 50 AS DOUBLE) + 3.1e-9 AS ox, CAST(floor(c_custkey / 40) * 50 AS DOUBLE) + 3.1e-9 AS oy,
  CAST(CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 0.0 END AS DOUBLE) AS c, CAST(CASE c_custkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE 1.0 END AS DOUBLE) AS s,
  CAST(10 + c_custkey % 11 AS DOUBLE) AS l, CAST(c_custkey % 5 + 3 AS DOUBLE) / 8 AS t, CAST(c_custkey % 7 AS DOUBLE) / 8 AS d FROM customer"""
#: Boxes by kind, in the wall's frame; those of one profile add up to its outline. Kind 8 has none.
_BOXES = (
    (0, 0, "l / 2", "-2", "l + 3", "2"), (1, 0, "2", "-t / 4", "l - 2", "2"), (2, 0, "2", "t / 5", "l - 2 - d / 16", "2"), (3, 0, "-1", "-1", "l + 1", "1.5"), (4, 0, "1", "t / 2", "l - 1", "2"),
    (5, 0, "1", "-1.5", "5", "1.5"), (5, 0, "5", "-t / 8", "7 + d", "1.5"), (6, 0, "1", "-1.25", "3", "1.25"), (6, 1, "5.75 + d", "-1.25", "l + 0.125", "1.25"),
)
_BOXED = " UNION ALL ".join(f"SELECT *, k * 10 + {n} AS profile_id, {u0} AS a0, {v0} AS b0, {u1} AS a1, {v1} AS b1 FROM ({_SITES}) WHERE kind = {kind}" for kind, n, u0, v0, u1, v1 in _BOXES)
#: Outlines: boxes, the angled one of kind 5, a triangle that cuts kind 7; the box of kind 3 has a hole beside the wall.
_BOX_RINGS = [(kind, n, [[(u0, v0), (u1, v0), (u1, v1), (u0, v1)]]) for kind, n, u0, v0, u1, v1 in _BOXES if kind not in (3, 5)]
_RINGS = [*_BOX_RINGS, (3, 0, [[("-1", "-1"), ("l + 1", "-1"), ("l + 1", "1.5"), ("-1", "1.5")], [("2", "0.75"), ("4", "0.75"), ("4", "1"), ("2", "1")]]), (5, 0, [[("1", "-1.5"), ("5", "-1.5"), ("5", "-t / 8"), ("7 + d", "-t / 8"), ("7 + d", "1.5"), ("1", "1.5"), ("1", "-1.5")]]), (7, 0, [[("3", "-2"), ("7", "0"), ("3", "2")]])]
#: Openings of a site: number, ends along the wall, and how far off its axis.
_OPENINGS = ((0, "0.5", "1.75", "0"), (1, "l / 2 - 1.5", "l / 2 + 1", "0"), (2, "5.5 + d", "2.5", "0"), (3, "3.5", "6", "t / 4"))


def _at(u: str, v: str, x: str, y: str) -> str:
    return f"CAST(ox + ({u}) * c - ({v}) * s AS DOUBLE) AS {x}, CAST(oy + ({u}) * s + ({v}) * c AS DOUBLE) AS {y}"


_OUTLINES = " UNION ALL ".join("SELECT sheet_id, k * 10 + %d AS profile_id, array(%s) AS rings FROM (%s) WHERE kind = %d" % (n, ", ".join("array(" + ", ".join(f"struct({_at(u, v, 'x', 'y')})" for u, v in ring) + ")" for ring in rings), _SITES, kind) for kind, n, rings in _RINGS)
_LOCAL = " UNION ALL ".join(f"SELECT *, k * 10 + {n} AS opening_id, {a} AS p, {b} AS q, {v} AS v FROM ({_SITES})" for n, a, b, v in _OPENINGS)
_WALLS = f"SELECT sheet_id, k AS wall_id, {_at('0', '0', 'x0', 'y0')}, {_at('l', '0', 'x1', 'y1')}, t AS thickness_ft FROM ({_SITES})"
_ENDS = f"SELECT sheet_id, opening_id, {_at('p', 'v', 'x0', 'y0')}, {_at('q', 'v', 'x1', 'y1')} FROM ({_LOCAL})"

_PIECES = f"""WITH site AS MATERIALIZED ({_SITES}), box AS MATERIALIZED (SELECT k, profile_id, greatest(a0, 0) AS a0, greatest(b0, -t / 2) AS b0, least(a1, l) AS a1, least(b1, t / 2) AS b1 FROM ({_BOXED}) x WHERE kind NOT IN (3, 4)),
opening AS MATERIALIZED ({_LOCAL}), us AS (SELECT k, a0 AS u FROM box UNION SELECT k, a1 FROM box UNION SELECT k, 0 FROM box UNION SELECT s.k, l FROM site s JOIN box USING (k)),
vs AS (SELECT k, b0 AS v FROM box UNION SELECT k, b1 FROM box UNION SELECT s.k, t / 2 FROM site s JOIN box USING (k) UNION SELECT s.k, -t / 2 FROM site s JOIN box USING (k)),
u AS (SELECT k, u AS u0, lead(u) OVER (PARTITION BY k ORDER BY u) AS u1 FROM us), v AS (SELECT k, v AS v0, lead(v) OVER (PARTITION BY k ORDER BY v) AS v1 FROM vs),
cell AS (SELECT u.k, u0, u1, v0, v1, max(profile_id) AS profile_id FROM u JOIN v ON v.k = u.k LEFT JOIN box b ON b.k = u.k AND (u0 + u1) / 2 BETWEEN a0 AND a1 AND (v0 + v1) / 2 BETWEEN b0 AND b1 WHERE u1 IS NOT NULL AND v1 IS NOT NULL GROUP BY ALL),
up AS (SELECT *, row_number() OVER (PARTITION BY k, u0 ORDER BY v0) - row_number() OVER (PARTITION BY k, u0, profile_id ORDER BY v0) AS g FROM cell),
tall AS (SELECT k, u0, u1, profile_id, min(v0) AS v0, max(v1) AS v1 FROM up GROUP BY k, u0, u1, profile_id, g),
ahead AS (SELECT *, CASE WHEN lag(u1) OVER w = u0 THEN 0 ELSE 1 END AS fresh FROM tall WINDOW w AS (PARTITION BY k, profile_id, v0, v1 ORDER BY u0)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY k, profile_id, v0, v1 ORDER BY u0) AS g FROM ahead),
tile AS (SELECT k, profile_id, v0, v1, min(u0) AS u0, max(u1) AS u1 FROM run GROUP BY k, profile_id, v0, v1, g),
piece AS MATERIALIZED (SELECT s.*, profile_id, u0, u1, v0, v1, CASE WHEN profile_id IS NULL THEN CASE WHEN u1 - u0 >= 0.25 AND v1 - v0 >= least(CAST(1 AS DOUBLE) / 12, t) THEN 'free' ELSE 'dropped' END
  WHEN u1 - u0 >= 0.25 AND v1 - v0 >= 0.5 * t OR EXISTS (SELECT 1 FROM opening o WHERE o.k = x.k AND least(o.p, o.q) >= u0 - 1e-5 AND greatest(o.p, o.q) <= u1 + 1e-5) THEN 'hosted' ELSE 'dropped' END AS verdict FROM tile x JOIN site s ON s.k = x.k)"""


def _rounded(u: str, v: str, n: int) -> str:
    return f"round(ox + ({u}) * c - ({v}) * s, 6) + 0.0 AS x{n}, round(oy + ({u}) * s + ({v}) * c, 6) + 0.0 AS y{n}"


def _fitted(spark, sf):
    return profiles.fit_to_profiles(drawing(spark, sf, _WALLS), drawing(spark, sf, _OUTLINES), drawing(spark, sf, _ENDS))


def _near(d, *columns):
    return d.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


@query(f"""{_PIECES}
SELECT sheet_id, k AS wall_id, profile_id, {_rounded("u0", "(v0 + v1) / 2", 0)}, {_rounded("u1", "(v0 + v1) / 2", 1)}, round(v1 - v0, 6) AS thickness_ft, verdict FROM piece
UNION ALL SELECT sheet_id, k, CASE WHEN kind = 3 THEN k * 10 END, {_rounded("0", "0", 0)}, {_rounded("l", "0", 1)}, round(t, 6), CASE kind WHEN 3 THEN 'on' WHEN 7 THEN 'ragged' ELSE 'clear' END FROM site WHERE kind IN (3, 4, 7, 8)""")
def profile_pieces(spark, sf):
    return _near(_fitted(spark, sf)[0], "x0", "y0", "x1", "y1", "thickness_ft")


@query(f"""{_PIECES}, held AS (SELECT o.k, opening_id, greatest(least(p, q), u0) AS lo, least(greatest(p, q), u1) AS hi, u0, v0, (v0 + v1) / 2 AS middle, abs(o.v - (v0 + v1) / 2) <= 1e-5 AND least(p, q) >= u0 - 1e-5 AND greatest(p, q) <= u1 + 1e-5 AS fits
  FROM opening o JOIN piece x ON x.k = o.k AND x.verdict <> 'dropped'),
best AS (SELECT *, max(fits) OVER (PARTITION BY opening_id) AS whole, row_number() OVER (PARTITION BY opening_id ORDER BY round(hi - lo, 9) DESC, u0, v0) AS r FROM held),
told AS (SELECT o.*, CASE WHEN o.kind IN (3, 4, 7, 8) OR abs(o.v) > 1e-5 THEN NULL ELSE o.k END AS wall_id, whole, lo, hi, middle, hi - lo >= 0.5 * abs(o.q - o.p) AND hi - lo >= 0.25 AS enough FROM opening o LEFT JOIN best b ON b.opening_id = o.opening_id AND b.r = 1),
fate AS (SELECT *, CASE WHEN wall_id IS NULL OR coalesce(whole, false) THEN 'kept' WHEN coalesce(enough, false) THEN 'narrowed' ELSE 'lost' END AS verdict FROM told)
SELECT sheet_id, opening_id, wall_id, {_rounded("CASE WHEN verdict <> 'narrowed' THEN p WHEN p <= q THEN lo ELSE hi END", "CASE WHEN verdict = 'narrowed' THEN middle ELSE v END", 0)},
  {_rounded("CASE WHEN verdict <> 'narrowed' THEN q WHEN p <= q THEN hi ELSE lo END", "CASE WHEN verdict = 'narrowed' THEN middle ELSE v END", 1)}, verdict FROM fate""")
def profile_openings(spark, sf):
    return _near(_fitted(spark, sf)[1], "x0", "y0", "x1", "y1")
