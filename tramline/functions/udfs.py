"""The few functions that Spark lacks, as vectorised UDFs over Arrow batches."""

from __future__ import annotations

import html
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro(a: str, b: str) -> float:
    """Jaro similarity of two strings."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, mine = [False] * len(b), []
    for i, char in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == char:
                taken[j] = True
                mine.append(char)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    m = len(mine)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str | None, b: str | None, scale: float = 0.1) -> float | None:
    """Jaro similarity raised by a common beginning of up to four letters, if it is over 0.7. [F16]"""
    if a is None or b is None:
        return None
    base = jaro(a, b)
    common = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        common += 1
    return base + common * scale * (1 - base) if base > 0.7 else base


@F.pandas_udf(T.DoubleType())
def jaro_winkler_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def html_unescaped(text: pd.Series) -> pd.Series:
    """All character references. [F14]"""
    return text.map(lambda t: None if t is None else html.unescape(t))


def polyline(points: list[tuple[float, float]], places: int = 5) -> str:
    """(lon, lat) points in the encoded polyline format. [F23]"""
    out, before = [], (0, 0)
    for lon, lat in points:
        now = (round(lat * 10**places), round(lon * 10**places))
        for a, b in zip(now, before, strict=True):
            value = (a - b) << 1
            value = ~value if a < b else value
            while value >= 0x20:
                out.append(chr((0x20 | value & 0x1F) + 63))
                value >>= 5
            out.append(chr(value + 63))
        before = now
    return "".join(out)


def polyline_points(text: str, places: int = 5) -> list[tuple[float, float]]:
    """The inverse of ``polyline``."""
    out, lat, lon, i = [], 0, 0, 0
    while i < len(text):
        for part in range(2):
            shift = value = 0
            while True:
                code = ord(text[i]) - 63
                i += 1
                value |= (code & 0x1F) << shift
                shift += 5
                if code < 0x20:
                    break
            value = ~(value >> 1) if value & 1 else value >> 1
            lat, lon = (lat + value, lon) if part == 0 else (lat, lon + value)
        out.append((lon / 10**places, lat / 10**places))
    return out


def simplified(points: list[tuple[float, float]], tolerance: float) -> list[tuple[float, float]]:
    """Douglas-Peucker on planar coordinates, without recursion. [F22]"""
    if len(points) < 3:
        return list(points)
    keep, stack = {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        first, last = stack.pop()
        (x1, y1), (x2, y2) = points[first], points[last]
        dx, dy = x2 - x1, y2 - y1
        size, worst, at = dx * dx + dy * dy, tolerance * tolerance, None
        for i in range(first + 1, last):
            x, y = points[i]
            t = min(1.0, max(0.0, ((x - x1) * dx + (y - y1) * dy) / size)) if size else 0.0
            far = (x - x1 - t * dx) ** 2 + (y - y1 - t * dy) ** 2
            if far > worst:
                worst, at = far, i
        if at is not None:
            keep.add(at)
            stack += [(first, at), (at, last)]
    return [points[i] for i in sorted(keep)]


def clipped(a: tuple[float, float], b: tuple[float, float], box: tuple[float, float, float, float]) -> tuple | None:
    """The part of a segment inside a box (west, south, east, north), by its parameters at the four sides. [F26]"""
    t0, t1, dx, dy = 0.0, 1.0, b[0] - a[0], b[1] - a[1]
    for step, gap in ((-dx, a[0] - box[0]), (dx, box[2] - a[0]), (-dy, a[1] - box[1]), (dy, box[3] - a[1])):
        if step == 0:
            if gap < 0:
                return None
        elif step < 0:
            t0 = max(t0, gap / step)
        else:
            t1 = min(t1, gap / step)
    return None if t0 > t1 else ((a[0] + t0 * dx, a[1] + t0 * dy), (a[0] + t1 * dx, a[1] + t1 * dy))


_LINE = T.ArrayType(T.StructType([T.StructField("lon", T.DoubleType()), T.StructField("lat", T.DoubleType())]))


def arrow_lines(column: pa.Array) -> list[list[tuple[float, float]] | None]:
    """The points of each line, taken from the whole column's numbers at once."""
    points = column.flatten()
    lon, lat = (x.to_pylist() if x.null_count else x.to_numpy().tolist() for x in (points.field(0), points.field(1)))
    pairs, out, at = list(zip(lon, lat, strict=True)), [], 0
    for size in column.value_lengths().to_pylist():
        out.append(None if size is None else pairs[at : at + size])
        at += size or 0
    return out


def arrow_lists(rows: list[list | None], inside: Callable[[list], pa.Array]) -> pa.Array:
    """Lists as an Arrow column; ``inside`` makes one of all their items."""
    ends, flat = [0], []
    for row in rows:
        flat.extend(row or ())
        ends.append(len(flat))
    starts = [None if row is None else at for row, at in zip(rows, ends, strict=False)]
    return pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), inside(flat))


def arrow_pairs(rows: list[tuple[float, float] | None], names: tuple[str, str] = ("lon", "lat")) -> pa.Array:
    """Structs of two numbers, or nulls."""
    return pa.StructArray.from_arrays([pa.array([r and r[i] for r in rows], pa.float64()) for i in (0, 1)], names, mask=pa.array([r is None for r in rows], pa.bool_()))


def _line_column(rows: list[list[tuple[float, float]] | None]) -> pa.Array:
    return arrow_lists(rows, arrow_pairs)


@F.arrow_udf(T.StringType())
def polyline_udf(lines: pa.Array) -> pa.Array:
    return pa.array([None if row is None else polyline(row) for row in arrow_lines(lines)], pa.string())


@F.arrow_udf(_LINE)
def simplify_udf(lines: pa.Array, tolerance: pa.Array) -> pa.Array:
    return _line_column([None if row is None else simplified(row, t) for row, t in zip(arrow_lines(lines), tolerance.to_pylist(), strict=True)])


def clipped_line(points: list[tuple[float, float]], box: tuple[float, float, float, float]) -> list[list[tuple[float, float]]]:
    """The stretches of a line inside a box, in order. [F26]"""
    out: list[list[tuple[float, float]]] = []
    for a, b in zip(points, points[1:], strict=False):
        part = clipped(a, b, box)
        if part is None:
            continue
        if out and out[-1][-1] == part[0]:
            out[-1].append(part[1])
        else:
            out.append(list(part))
    return [s for s in out if len(set(s)) > 1]


@F.arrow_udf(T.ArrayType(_LINE))
def clip_udf(lines: pa.Array, boxes: pa.Array) -> pa.Array:
    sides = zip(*(boxes.field(side).to_pylist() for side in ("west", "south", "east", "north")), strict=True)
    found = [None if row is None else clipped_line(row, box) for row, box in zip(arrow_lines(lines), sides, strict=True)]
    return arrow_lists(found, _line_column)


@F.arrow_udf(_LINE)
def polyline_points_udf(texts: pa.Array) -> pa.Array:
    return _line_column([None if text is None else polyline_points(text) for text in texts.to_pylist()])


@F.arrow_udf(T.BinaryType())
def deflated(data: pa.Array) -> pa.Array:
    """[F29]"""
    return pa.array([None if x is None else zlib.compress(x) for x in data.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def inflated(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else zlib.decompress(x) for x in data.to_pylist()], pa.binary())


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Counter-clockwise from the least point, without repeating it. [A16]"""
    points = sorted(set(points))
    if len(points) < 3:
        return points

    def half(ordered):
        out = []
        for p in ordered:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(points) + half(reversed(points))
