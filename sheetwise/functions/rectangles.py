"""Rectangles of least area round many sets of points at a time, for Arrow batches. Results are those of ``minimum_rectangle``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Sets of so many points try all their pairs as directions; larger ones the sides of their hull.
FEW = 8
#: Numbers of products of directions and points that are in memory at a time.
AT_ONCE = 2_000_000
FIELDS = ("width", "depth", "angle", "x", "y")


def _round(v: np.ndarray, digits: int) -> np.ndarray:
    return np.copysign(np.floor(np.abs(v) * 10.0**digits + 0.5) / 10.0**digits, v) + 0.0


def hull(points: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of an array of (x, y), counter-clockwise from the least."""
    p = [tuple(v) for v in np.unique(points, axis=0)]
    halves = []
    for way in (p, p[::-1]):
        front: list[tuple[float, float]] = []
        for x, y in way:
            while len(front) > 1 and (front[-1][0] - front[-2][0]) * (y - front[-2][1]) - (front[-1][1] - front[-2][1]) * (x - front[-2][0]) <= 0:
                front.pop()
            front.append((x, y))
        halves += front[:-1]
    return np.array(halves or p[:1])


def _measured(x: np.ndarray, y: np.ndarray, ux: np.ndarray, uy: np.ndarray) -> tuple[np.ndarray, ...]:
    """Area and ``FIELDS`` of sets of points (g, n) in directions (g, d); directions that are NaN have the area inf."""
    along, across = (a[:, None, :] * u[:, :, None] + b[:, None, :] * v[:, :, None] for a, u, b, v in ((x, ux, y, uy), (y, ux, x, -uy)))
    l0, l1, a0, a1 = along.min(2), along.max(2), across.min(2), across.max(2)
    length, depth = l1 - l0, a1 - a0
    long = length >= depth
    angle = _round(np.mod(np.arctan2(np.where(long, uy, ux), np.where(long, ux, -uy)), np.pi), 9)
    angle = np.where(angle >= 3.141592653, 0.0, np.where(np.abs(length - depth) < 1e-9, _round(np.mod(angle, 1.570796326), 6), angle))
    middle = lambda a, b: _round(((l0 + l1) * a + (a0 + a1) * b) / 2, 6)
    area = np.where(np.isnan(ux), np.inf, _round(length * depth, 6))
    return area, _round(np.maximum(length, depth), 9), _round(np.minimum(length, depth), 9), angle, middle(ux, -uy), middle(uy, ux)


def _least(x: np.ndarray, y: np.ndarray, dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """``FIELDS`` (g, 5) of the best of directions dx, dy (g, d), not of length 1: least area, then angle, width and the rest."""
    size = np.hypot(dx, dy)
    with np.errstate(all="ignore"):
        ux, uy = (np.where(size < 1e-12, np.nan, v / size + 0.0) for v in (dx, dy))
        area, *fields = _measured(x, y, ux, uy)
    left = np.isfinite(area)
    some = left.any(1)
    for key in (area, fields[2], fields[0], fields[1], fields[3], fields[4]):
        key = np.where(left, key, np.inf)
        left &= key == key.min(1, keepdims=True)
    at = left.argmax(1)
    out = np.stack([f[np.arange(len(f)), at] for f in fields], 1)
    first = np.lexsort((y, x))[:, 0]  # the least point of a set without directions
    alone = np.stack([np.zeros(len(x))] * 3 + [_round(v[np.arange(len(v)), first], 6) for v in (x, y)], 1)
    return np.where(some[:, None], out, alone)


def rectangles(starts: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``FIELDS`` (g, 5) of sets of points, set i being those from starts[i] to starts[i + 1]; NaN for an empty one."""
    n = np.diff(starts)
    out = np.full((len(n), 5), np.nan)
    for m in range(1, FEW + 1):
        sets = np.flatnonzero(n == m)
        a, b = np.triu_indices(m, 1) if m > 1 else (np.zeros(1, int), np.zeros(1, int))
        step = max(1, AT_ONCE // (m * len(a)))
        for at in (sets[k : k + step] for k in range(0, len(sets), step)):
            px, py = (v[starts[at][:, None] + np.arange(m)] for v in (x, y))
            out[at] = _least(px, py, px[:, b] - px[:, a], py[:, b] - py[:, a])
    for i in np.flatnonzero(n > FEW):
        h = hull(np.stack([x[starts[i] : starts[i + 1]], y[starts[i] : starts[i + 1]]], 1))
        sides = np.roll(h, -1, 0) - h
        step = max(1, AT_ONCE // len(h))
        best = [(_least(h[None, :, 0], h[None, :, 1], *(sides[None, k : k + step, c] for c in (0, 1)))[0]) for k in range(0, len(h), step)]
        out[i] = min(best, key=lambda r: (_round(r[0] * r[1], 6), r[2], r[0], r[1], r[3], r[4]))
    return out


def measured_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose last two columns, lists of x and y, are replaced by ``FIELDS``; null where there are no points."""
    for batch in batches:
        *keys, xs, ys = batch.columns
        x, y = (v.flatten().to_numpy(zero_copy_only=False).astype(float) for v in (xs, ys))
        starts = np.concatenate([[0], np.cumsum(xs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
        found = rectangles(starts, x, y)
        fields = [pa.array(v, from_pandas=True) for v in found.T]
        yield pa.RecordBatch.from_arrays([*keys, *fields], [*batch.schema.names[:-2], *FIELDS])
