"""Algebra of lines in metres: arrays of (x, y) structs, as Arrow-batched functions where it takes a loop. [F21]"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.functions.udfs import arrow_lines, arrow_lists, arrow_pairs

Point = tuple[float, float]
POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_PLACE = T.StructType([T.StructField("metres", T.DoubleType()), T.StructField("along", T.DoubleType())])


def lengths(line: list[Point]) -> list[float]:
    """Distance from the start at each point."""
    out = [0.0] * min(1, len(line))
    for a, b in zip(line, line[1:], strict=False):
        out.append(out[-1] + math.dist(a, b))
    return out


def at_distance(line: list[Point], metres: float) -> Point | None:
    """The point so far along the line; its ends before and beyond."""
    if not line:
        return None
    before = 0.0
    for a, b in zip(line, line[1:], strict=False):
        step = math.dist(a, b)
        if step and metres <= before + step:
            t = max(0.0, (metres - before) / step)
            return (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        before += step
    return line[-1]


def projected(line: list[Point], point: Point) -> tuple[float, float] | None:
    """(distance from the point, how far along) of the nearest place on the line; the first of equals."""
    best, before = None, 0.0
    for a, b in zip(line, line[1:] or line, strict=False):
        dx, dy = b[0] - a[0], b[1] - a[1]
        size = dx * dx + dy * dy
        t = min(1.0, max(0.0, ((point[0] - a[0]) * dx + (point[1] - a[1]) * dy) / size)) if size else 0.0
        found = math.dist(point, (a[0] + t * dx, a[1] + t * dy))
        if best is None or found < best[0] - 1e-12:
            best = (found, before + t * math.sqrt(size))
        before += math.sqrt(size)
    return best


def cut_out(line: list[Point], start: float, end: float) -> list[Point]:
    """The part between two distances along the line."""
    if not line or end < start:
        return []
    inner = [p for p, d in zip(line, lengths(line), strict=True) if start < d < end]
    return [at_distance(line, start), *inner, at_distance(line, end)]


def densified(line: list[Point], spacing: float) -> list[Point]:
    """With points added so that none is farther than ``spacing`` from the next."""
    out = list(line[:1])
    for a, b in zip(line, line[1:], strict=False):
        n = max(1, math.ceil(math.dist(a, b) / spacing - 1e-9))
        out += [(a[0] + k / n * (b[0] - a[0]), a[1] + k / n * (b[1] - a[1])) for k in range(1, n + 1)]
    return out


def hausdorff(one: list[Point], other: list[Point]) -> float | None:
    """The farthest that a point of either line lies from the other line."""
    if not one or not other:
        return None
    return max(projected(b, p)[0] for a, b in ((one, other), (other, one)) for p in a)


def overlap(one: list[Point], other: list[Point], within: float, spacing: float = 5.0) -> float:
    """Share of points along the first line, every ``spacing`` metres or closer, that the second has within reach."""
    spots = densified(one, spacing)
    return sum(projected(other, p)[0] <= within for p in spots) / len(spots) if spots and other else 0.0


@F.arrow_udf(_PLACE)
def project_udf(line: pa.Array, point: pa.Array) -> pa.Array:
    found = [projected(row, p) if row and None not in p else None for row, p in zip(arrow_lines(line), _pairs(point), strict=True)]
    return arrow_pairs(found, ("metres", "along"))


@F.arrow_udf(POINT)
def at_distance_udf(line: pa.Array, metres: pa.Array) -> pa.Array:
    return _points([at_distance(row, m) if row and m is not None else None for row, m in zip(arrow_lines(line), metres.to_pylist(), strict=True)])


@F.arrow_udf(T.ArrayType(POINT))
def cut_out_udf(line: pa.Array, start: pa.Array, end: pa.Array) -> pa.Array:
    rows = zip(arrow_lines(line), start.to_pylist(), end.to_pylist(), strict=True)
    return arrow_lists([None if row is None else cut_out(row, a, b) for row, a, b in rows], _points)


@F.arrow_udf(T.ArrayType(POINT))
def densify_udf(line: pa.Array, spacing: pa.Array) -> pa.Array:
    return arrow_lists([None if row is None else densified(row, s) for row, s in zip(arrow_lines(line), spacing.to_pylist(), strict=True)], _points)


@F.arrow_udf(T.DoubleType())
def hausdorff_udf(one: pa.Array, other: pa.Array) -> pa.Array:
    return pa.array([hausdorff(a or [], b or []) for a, b in zip(arrow_lines(one), arrow_lines(other), strict=True)], pa.float64())


@F.arrow_udf(T.DoubleType())
def overlap_udf(one: pa.Array, other: pa.Array, within: pa.Array) -> pa.Array:
    return pa.array([overlap(a or [], b or [], w) for a, b, w in zip(arrow_lines(one), arrow_lines(other), within.to_pylist(), strict=True)], pa.float64())


def _points(found: list[Point | None]) -> pa.Array:
    return arrow_pairs(found, ("x", "y"))


def _pairs(points: pa.Array) -> list[tuple]:
    """(x, y) of each point, both null for none."""
    return list(zip(*(x.to_pylist() for x in points.flatten()), strict=True))
