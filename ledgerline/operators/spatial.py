"""Spatial joins and line work; shapes are arrays of struct(x, y) in metres, and every join goes by grid cells.

Shapes meet only in the one cell that holds the larger of their boxes' lower corners, so no pair is made twice and none
needs a distinct. Rows whose shape is null or too short take no part.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ledgerline.functions import geometry

_POINTS = "array<struct<x:double,y:double>>"


def _boxed(df: DataFrame, points: Column, by: float = 0.0) -> DataFrame:
    """df with the box of its points, widened by `by` on all sides."""
    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    return df.select("*", (F.array_min(xs) - by).alias("_x0"), (F.array_min(ys) - by).alias("_y0"), (F.array_max(xs) + by).alias("_x1"), (F.array_max(ys) + by).alias("_y1"))


def _meet(left: DataFrame, right: DataFrame, cell: float, ways: tuple[Column, Column] | None = None) -> DataFrame:
    """Pairs of boxed rows whose boxes touch, each once; the columns of each side in the structs l and r.

    ways: for each left row an array of the ways it may meet, and each right row's own; other pairs are never made. The
    join is dealt out by cells, as a small file's one partition would make all pairs if a side were broadcast to it.
    """

    def spread(df: DataFrame, side: str, way: Column) -> DataFrame:
        def cells(axis: str) -> Column:
            return F.explode(F.sequence(F.floor(F.col(f"_{axis}0") / cell), F.floor(F.col(f"_{axis}1") / cell)))

        return df.select(F.struct(*df.columns).alias(side), "*").withColumn("_way", way).withColumn("_cx", cells("x")).select(side, "_way", "_cx", cells("y").alias("_cy"))

    meets, own_way = (F.explode(ways[0]), ways[1]) if ways else (F.lit(0), F.lit(0))
    met = spread(left, "l", meets).join(spread(right, "r", own_way).hint("merge"), ["_cx", "_cy", "_way"])
    touch = (F.col("l._x0") <= F.col("r._x1")) & (F.col("r._x0") <= F.col("l._x1")) & (F.col("l._y0") <= F.col("r._y1")) & (F.col("r._y0") <= F.col("l._y1"))
    own = (F.col("_cx") == F.floor(F.greatest("l._x0", "r._x0") / cell)) & (F.col("_cy") == F.floor(F.greatest("l._y0", "r._y0") / cell))
    return met.filter(touch & own)


def _segments(df: DataFrame, key: str, points: str, closed: bool, by: float = 0.0) -> DataFrame:
    p = F.col(points).cast(_POINTS)
    after = F.concat(F.slice(p, 2, F.size(p)), F.slice(p, 1, 1)) if closed else F.slice(p, 2, F.size(p))
    ends = F.arrays_zip(F.slice(p, 1, F.size(p) - (0 if closed else 1)).alias("a"), after.alias("b"))
    parts = df.filter(F.size(points) > 1).select(F.col(key).alias("key"), F.explode(ends).alias("s")).select("key", "s.a", "s.b")
    return _boxed(parts, F.array("a", "b"), by)


def crossings(lines: DataFrame, key: str, points: str, cell: float) -> DataFrame:
    """key_a < key_b and x, y of every point where two lines cross or touch; parallel overlaps give no point.

    A key may hold several lines; points nearer than 0.000001 are one. Level segments are not paired with each other, nor
    upright ones: they are parallel.
    """
    parts = _segments(lines, key, points, closed=False)
    level, upright = F.col("a.y") == F.col("b.y"), F.col("a.x") == F.col("b.x")
    parts = parts.filter(~(level & upright))  # a point is parallel to all
    others = F.when(level, F.array(F.lit(1), F.lit(2))).when(upright, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0), F.lit(1), F.lit(2)))
    way = F.when(level, 0).when(upright, 1).otherwise(2)
    met = _meet(parts, parts, cell, (others, way)).filter(F.col("l.key") < F.col("r.key"))
    point = geometry.segment_crossing(F.col("l.a"), F.col("l.b"), F.col("r.a"), F.col("r.b"))
    # Exploded, as a filter would be worked out within the join, in one method too large for the JVM to compile.
    at = met.select(F.col("l.key").alias("key_a"), F.col("r.key").alias("key_b"), F.explode(F.array_compact(F.array(point))).alias("p"))
    return at.select("key_a", "key_b", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")).distinct()


def adjacent(polygons: DataFrame, key: str, ring: str, within: float, cell: float) -> DataFrame:
    """key_a < key_b and the distance of polygons whose boundaries come nearer to each other than `within`.

    Crossing boundaries have distance 0. A polygon wholly inside another is adjacent only if it comes near its boundary.
    """
    met = _meet(_segments(polygons, key, ring, closed=True, by=within / 2), _segments(polygons, key, ring, closed=True, by=within / 2), cell).filter(F.col("l.key") < F.col("r.key"))
    a, b, c, d = F.col("l.a"), F.col("l.b"), F.col("r.a"), F.col("r.b")
    ends = F.least(geometry.segment_distance(a, c, d), geometry.segment_distance(b, c, d), geometry.segment_distance(c, a, b), geometry.segment_distance(d, a, b))
    apart = F.when(geometry.segment_crossing(a, b, c, d).isNotNull(), F.lit(0.0)).otherwise(ends)
    return met.select(F.col("l.key").alias("key_a"), F.col("r.key").alias("key_b"), apart.alias("d")).groupBy("key_a", "key_b").agg(F.min("d").alias("distance")).filter(F.col("distance") < within)


def _array(points) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in points], dtype=float).reshape(-1, 2)


def _clip(subject: list, triangle: np.ndarray) -> list:
    """The part of a convex polygon inside a counter-clockwise triangle."""
    for i in range(3):
        (ax, ay), (bx, by) = triangle[i], triangle[(i + 1) % 3]
        sides = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in subject]
        kept = []
        for k, (x, y) in enumerate(subject):
            s, (px, py), t = sides[k], subject[k - 1], sides[k - 1]
            if (s >= 0) != (t >= 0):
                kept.append((px + (x - px) * t / (t - s), py + (y - py) * t / (t - s)))
            if s >= 0:
                kept.append((x, y))
        subject = kept
    return subject


def _area(ring: Sequence) -> float:
    return sum(ring[i - 1][0] * ring[i][1] - ring[i][0] * ring[i - 1][1] for i in range(len(ring))) / 2


def _fan(ring: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Signed counter-clockwise triangles from the first point; their signed sum is the polygon's indicator."""
    signed = []
    for i in range(1, len(ring) - 1):
        t = ring[[0, i, i + 1]]
        area = _area(t)
        if area:
            signed.append((np.sign(area), t if area > 0 else t[::-1]))
    return signed


def ring_overlap(a: np.ndarray, b: np.ndarray) -> float:
    """The area that two simple polygons share, convex or not: the signed sum over the triangles of their fans."""
    return abs(sum(s * t * _area(_clip(list(map(tuple, p)), q)) for s, p in _fan(a) for t, q in _fan(b)))


@F.pandas_udf(StructType([StructField("overlap", DoubleType()), StructField("area", DoubleType())]))
def _overlap(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    rings = [(_array(p), _array(q)) for p, q in zip(a, b)]
    return pd.DataFrame({"overlap": [ring_overlap(p, q) for p, q in rings], "area": [abs(_area(p)) for p, _ in rings]})


def areal_interpolate(source: DataFrame, source_ring: str, values: Sequence[str], target: DataFrame, target_key: str, target_ring: str, cell: float) -> DataFrame:
    """By target polygon, the source's values in proportion to the shared area, uniform within each source polygon.

    Targets that share no area with any source are left out, as are sources without area.
    """
    left = _boxed(source.filter(F.size(source_ring) > 2).select(F.col(source_ring).cast(_POINTS).alias("ring"), *values), F.col("ring"))
    right = _boxed(target.filter(F.size(target_ring) > 2).select(F.col(target_key).alias("key"), F.col(target_ring).cast(_POINTS).alias("ring")), F.col("ring"))
    shared = _meet(left, right, cell).select("l", F.col("r.key").alias(target_key), _overlap("l.ring", "r.ring").alias("o")).filter("o.overlap > 0 and o.area > 0")
    return shared.groupBy(target_key).agg(*[F.sum(F.col(f"l.{v}") * F.col("o.overlap") / F.col("o.area")).alias(v) for v in values])


def contained(points: DataFrame, x: str, y: str, polygons: DataFrame, key: str, ring: str, cell: float) -> DataFrame:
    """points with the key of each polygon that holds them, a row for each; points in none are left out."""
    at = points.select(F.struct(*points.columns).alias("_p"), F.floor(F.col(x) / cell).alias("_cx"), F.floor(F.col(y) / cell).alias("_cy"), F.col(x).alias("_x"), F.col(y).alias("_y"))
    shapes = _boxed(polygons.filter(F.size(ring) > 2).select(F.col(key).alias("_key"), F.col(ring).cast(_POINTS).alias("_ring")), F.col("_ring"))
    cells = [F.explode(F.sequence(F.floor(F.col(f"_{a}0") / cell), F.floor(F.col(f"_{a}1") / cell))).alias(f"_c{a}") for a in ("x", "y")]
    spread = shapes.select("*", cells[0]).select("*", cells[1])
    met = at.join(spread, ["_cx", "_cy"]).filter((F.col("_x") >= F.col("_x0")) & (F.col("_x") <= F.col("_x1")) & (F.col("_y") >= F.col("_y0")) & (F.col("_y") <= F.col("_y1")))
    return met.filter(geometry.point_in_ring(F.col("_x"), F.col("_y"), F.col("_ring"))).select(*[F.col("_p").getField(c).alias(c) for c in points.columns], F.col("_key").alias(key))


def nearest_within(probes: DataFrame, row_id: str, px: str, py: str, points: DataFrame, key: str, x: str, y: str, radius: float) -> DataFrame:
    """probes with the key and distance of the nearest point within the radius, the smaller key of two as near; else nulls.

    Points meet probes of their own and the eight neighbouring cells, whose side is the radius.
    """
    around = [F.explode(F.sequence(F.floor(F.col(c) / radius) - 1, F.floor(F.col(c) / radius) + 1)).alias(n) for c, n in (("_px", "_cx"), ("_py", "_cy"))]
    ours = probes.select(F.col(row_id).alias("_id"), F.col(px).alias("_px"), F.col(py).alias("_py")).select("*", around[0]).select("*", around[1])
    theirs = points.select(F.col(key).alias("_key"), F.col(x).alias("_x"), F.col(y).alias("_y"), F.floor(F.col(x) / radius).alias("_cx"), F.floor(F.col(y) / radius).alias("_cy"))
    apart = F.sqrt(F.pow(F.col("_px") - F.col("_x"), 2) + F.pow(F.col("_py") - F.col("_y"), 2))
    best = ours.join(theirs, ["_cx", "_cy"]).withColumn("_d", apart).filter(F.col("_d") <= radius).groupBy("_id").agg(F.min(F.struct("_d", "_key")).alias("_b"))
    return probes.join(best, probes[row_id] == F.col("_id"), "left").select(*probes.columns, F.col("_b._key").alias(key), F.col("_b._d").alias("distance"))


def _inside(ring: np.ndarray, x: float, y: float) -> bool:
    (ax, ay), (bx, by) = ring.T, np.roll(ring, -1, axis=0).T
    spans = (ay > y) != (by > y)
    return bool(np.sum(spans & (x < (bx - ax) * (y - ay) / np.where(by == ay, 1, by - ay) + ax)) % 2)


def clip_line(line: np.ndarray, ring: np.ndarray) -> list[np.ndarray]:
    """The parts of a line inside a ring, in order."""
    pieces, run = [], []
    r, q = ring, np.roll(ring, -1, axis=0) - ring
    for p, step in zip(line[:-1], np.diff(line, axis=0)):
        cross = step[0] * q[:, 1] - step[1] * q[:, 0]
        safe, w = np.where(cross == 0, 1, cross), r - p
        t, u = (w[:, 0] * q[:, 1] - w[:, 1] * q[:, 0]) / safe, (w[:, 0] * step[1] - w[:, 1] * step[0]) / safe
        cuts = np.unique(np.concatenate([[0.0, 1.0], t[(cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)]]))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if _inside(ring, *(p + (lo + hi) / 2 * step)):
                run = (run or [p + lo * step]) + [p + hi * step]
            elif run:
                pieces.append(np.array(run))
                run = []
    return pieces + ([np.array(run)] if run else [])


def merge_chains(lines: list[np.ndarray]) -> list[np.ndarray]:
    """Lines joined end to end wherever exactly two ends meet; rings are opened at their smallest point."""
    at = defaultdict(list)
    for i, line in enumerate(lines):
        at[tuple(line[0])].append(i)
        at[tuple(line[-1])].append(i)
    left, chains = set(range(len(lines))), []
    for node in [n for n in sorted(at) if len(at[n]) != 2] + sorted(at):
        for first in sorted(at[node]):
            if first not in left:
                continue
            here, i, chain = node, first, [np.array([node])]
            while i is not None:
                left.discard(i)
                part = lines[i] if tuple(lines[i][0]) == here else lines[i][::-1]
                chain.append(part[1:])
                here = tuple(part[-1])
                i = next((j for j in at[here] if j in left), None) if len(at[here]) == 2 and here != node else None
            chains.append(np.concatenate(chain))
    return chains


def longest_line(lines: DataFrame, key: str, points: str, ring: Sequence[tuple[float, float]] | None = None) -> DataFrame:
    """key and points of the longest chain of each key's lines, clipped to a ring if one is given; ties: smallest points.

    The lines of one key (one street) are held in one task.
    """
    edge = None if ring is None else np.array(ring, dtype=float)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        parts = [a for a in map(_array, group["points"]) if len(a) > 1]
        if edge is not None:
            parts = [piece for a in parts for piece in clip_line(a, edge)]
        chains = merge_chains(sorted(parts, key=lambda a: a.tolist()))
        if not chains:
            return group.iloc[:0]
        best = min(chains, key=lambda a: (-np.hypot(*np.diff(a, axis=0).T).sum(), a.tolist()))
        return pd.DataFrame({"key": [group["key"].iloc[0]], "points": [[{"x": x, "y": y} for x, y in best.tolist()]]})

    rows = lines.filter(F.size(points) > 1).select(F.col(key).alias("key"), F.col(points).cast(_POINTS).alias("points"))
    return rows.groupBy("key").applyInPandas(merge, f"key {rows.schema['key'].dataType.simpleString()}, points {_POINTS}").select(F.col("key").alias(key), "points")


def simplified(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: points farther than the tolerance from the chord of what is kept."""
    keep, todo = {0, len(line) - 1}, [(0, len(line) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo > 1:
            chord, off = line[hi] - line[lo], line[lo + 1 : hi] - line[lo]
            length = np.hypot(*chord)
            t = np.clip(off @ chord / length**2, 0, 1) if length else np.zeros(len(off))
            away = np.hypot(*(off - t[:, None] * chord).T)
            far = int(away.argmax())
            if away[far] > tolerance:
                keep.add(lo + 1 + far)
                todo += [(lo, lo + 1 + far), (lo + 1 + far, hi)]
    return line[sorted(keep)]


def simplify(df: DataFrame, points: str, tolerance: float) -> DataFrame:
    """df with its lines simplified; null and lines of fewer than three points stay."""

    @F.pandas_udf(_POINTS)
    def thin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in batches:
            yield pd.Series([p if p is None or len(p) < 3 else [{"x": x, "y": y} for x, y in simplified(_array(p), tolerance).tolist()] for p in lines], dtype=object)

    return df.withColumn(points, thin(F.col(points).cast(_POINTS)))


def place_on_blocks(people: DataFrame, street: str, cross: str, bearing: str, side: str, lines: DataFrame, line: str, meets: DataFrame, at: str) -> DataFrame:
    """people with x, y and tier: how far along the block that leads from a crossing in the bearing they stand.

    lines has one line for each street; meets has (street, cross, at), the distance along the street of each crossing.
    The smallest distance counts where two streets cross more than once. Tier is block_face with a bearing, corner
    without one; null, as are x and y, where the street or its crossing is unknown. A street's crossings fit in one row.
    """
    first = meets.groupBy(street, cross).agg(F.min(F.col(at).cast("double")).alias("_d"))
    known = meets.groupBy(street).agg(F.array_sort(F.collect_set(F.col(at).cast("double"))).alias("_all"))
    shape = lines.select(street, F.col(line).cast(_POINTS).alias("_line"))
    df = people.join(first, [street, cross], "left").join(known.join(shape, street), street, "left").withColumn("_len", geometry.line_length(F.col("_line")))
    sign = geometry.bearing_sign(F.col("_line"), F.col("_d"), F.col("_len"), F.col(bearing))
    df = df.withColumn("_sign", sign)
    ahead = F.array_min(F.filter("_all", lambda d: d > F.col("_d") + 1.0)) - F.col("_d")
    behind = F.col("_d") - F.array_max(F.filter("_all", lambda d: d < F.col("_d") - 1.0))
    gap = F.when(F.col("_sign") > 0, ahead).when(F.col("_sign") < 0, behind)
    df = df.withColumn("_to", F.when(F.col("_d").isNotNull() & F.col("_len").isNotNull(), F.least(F.greatest(F.col("_d") + F.col("_sign") * geometry.block_step(gap), F.lit(0.0)), F.col("_len"))))
    near = F.least(F.lit(10.0), F.col("_len") / 20)
    df = df.withColumn("_p", geometry.point_along(F.col("_line"), F.col("_to")))
    df = df.withColumn("_a", geometry.point_along(F.col("_line"), F.greatest(F.col("_to") - near, F.lit(0.0)))).withColumn("_b", geometry.point_along(F.col("_line"), F.least(F.col("_to") + near, F.col("_len"))))
    moved = geometry.side_offset(F.col("_p.x"), F.col("_p.y"), F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y"), F.substring(F.lower(F.col(side)), 1, 1))
    return df.withColumn("_q", F.when(F.col("_to").isNotNull(), moved)).select(*people.columns, "_q.x", "_q.y", F.when(F.col("_to").isNull(), F.lit(None)).when(F.col("_sign") == 0, "corner").otherwise("block_face").alias("tier"))
