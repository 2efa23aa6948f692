"""Plane geometry as column expressions; polylines are arrays of struct(x, y) in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a ring (array of struct(x, y)), by ray casting; the ring need not repeat its first point."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    crossed = F.zip_with(ring, after, lambda a, b: F.when((a["y"] > y) != (b["y"] > y), (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]).cast("int")).otherwise(0))
    return F.aggregate(crossed, F.lit(0), lambda s, c: s + c) % 2 == 1


def line_length(line: Column) -> Column:
    steps = F.zip_with(F.slice(line, 1, F.size(line) - 1), F.slice(line, 2, F.size(line)), lambda a, b: F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2)))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + F.coalesce(d, F.lit(0.0)))


def point_along(line: Column, distance: Column) -> Column:
    """struct(x, y) at a distance along a line, clamped to its ends."""
    start = F.struct(F.lit(0.0).alias("d"), F.element_at(line, 1)["x"].cast("double").alias("x"), F.element_at(line, 1)["y"].cast("double").alias("y"), F.element_at(line, 1)["x"].cast("double").alias("px"), F.element_at(line, 1)["y"].cast("double").alias("py"))

    def step(s: Column, p: Column) -> Column:
        length = F.sqrt(F.pow(p["x"] - s["px"], 2) + F.pow(p["y"] - s["py"], 2))
        part = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (distance - s["d"]) / length))).otherwise(F.lit(0.0))
        here = distance > s["d"]
        return F.struct(
            (s["d"] + length).alias("d"),
            F.when(here, s["px"] + part * (p["x"] - s["px"])).otherwise(s["x"]).alias("x"),
            F.when(here, s["py"] + part * (p["y"] - s["py"])).otherwise(s["y"]).alias("y"),
            p["x"].cast("double").alias("px"), p["y"].cast("double").alias("py"),
        )

    return F.aggregate(F.slice(line, 2, F.size(line)), start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def segment_crossing(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(x, y) where segments a-b and c-d cross; null if they do not or are parallel."""
    rx, ry, sx, sy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
    cross = rx * sy - ry * sx
    t = ((c["x"] - a["x"]) * sy - (c["y"] - a["y"]) * sx) / F.nullif(cross, F.lit(0.0))
    u = ((c["x"] - a["x"]) * ry - (c["y"] - a["y"]) * rx) / F.nullif(cross, F.lit(0.0))
    return F.when(t.between(0, 1) & u.between(0, 1), F.struct((a["x"] + t * rx).alias("x"), (a["y"] + t * ry).alias("y")))


def side_offset(x: Column, y: Column, dx: Column, dy: Column, side: Column, by: float = 7.0) -> Column:
    """struct(x, y) moved `by` metres across a line of direction (dx, dy), towards the compass side n, s, e or w."""
    length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    nx, ny = -dy / length, dx / length
    toward = F.when(side == "n", ny).when(side == "s", -ny).when(side == "e", nx).when(side == "w", -nx).otherwise(F.lit(0.0))
    sign = F.signum(toward)
    return F.struct((x + F.coalesce(sign * nx * by, F.lit(0.0))).alias("x"), (y + F.coalesce(sign * ny * by, F.lit(0.0))).alias("y"))


def block_step(gap: Column) -> Column:
    """How far into a block to stand: 0.4 of it, from 12 to 55 metres; 12 where the next crossing is unknown."""
    return F.coalesce(F.least(F.greatest(0.4 * gap, F.lit(12.0)), F.lit(55.0)), F.lit(12.0))


def to_screen(x: Column, y: Column, x0: Column, y0: Column, y1: Column, scale: Column, pad: float = 0.0) -> Column:
    """struct(sx, sy) in screen units, y pointing down, one decimal."""
    return F.struct(F.round(F.lit(pad) + (x - x0) * scale, 1).alias("sx"), F.round(F.lit(pad) + (y1 - y) * scale, 1).alias("sy"))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """How far point p is from segment a-b."""
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)))), F.lit(0.0))
    return F.sqrt(F.pow(p["x"] - a["x"] - t * dx, 2) + F.pow(p["y"] - a["y"] - t * dy, 2))


def distance_along(line: Column, x: Column, y: Column) -> Column:
    """How far along a line its point nearest to (x, y) lies; the first such point of several."""
    p = F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    first = F.element_at(line, 1)
    start = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("at"), F.sqrt(F.pow(first["x"] - x, 2) + F.pow(first["y"] - y, 2)).cast("double").alias("off"), first["x"].cast("double").alias("px"), first["y"].cast("double").alias("py"))

    def step(s: Column, q: Column) -> Column:
        dx, dy = q["x"] - s["px"], q["y"] - s["py"]
        length = F.sqrt(dx * dx + dy * dy)
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - s["px"]) * dx + (y - s["py"]) * dy) / F.nullif(length * length, F.lit(0.0)))), F.lit(0.0))
        off = segment_distance(p, F.struct(s["px"].alias("x"), s["py"].alias("y")), q)
        nearer = off < s["off"]
        return F.struct(
            (s["d"] + length).alias("d"),
            F.when(nearer, s["d"] + t * length).otherwise(s["at"]).alias("at"),
            F.when(nearer, off).otherwise(s["off"]).alias("off"),
            q["x"].cast("double").alias("px"), q["y"].cast("double").alias("py"),
        )

    return F.aggregate(F.slice(line, 2, F.size(line)), start, step, lambda s: s["at"])


def bearing_sign(line: Column, at: Column, length: Column, bearing: Column) -> Column:
    """1 if a line runs towards the bearing (n, s, e, w) at a distance along it, -1 if not, 0 without a bearing."""
    reach = F.least(F.lit(20.0), F.when(length > 0, length / 20).otherwise(F.lit(1.0)))
    a, b = point_along(line, F.greatest(F.lit(0.0), at - reach)), point_along(line, F.least(length, at + reach))
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    way = F.substring(F.lower(F.coalesce(bearing, F.lit(""))), 1, 1)
    toward = F.when(way == "n", dy).when(way == "s", -dy).when(way == "e", dx).when(way == "w", -dx)
    return F.when(toward > 0, 1).when(toward.isNotNull(), -1).otherwise(0)


def label_angle(dx: Column, dy: Column) -> Column:
    """The angle of a direction, turned so that text along it is upright; four decimals."""
    a = F.atan2(dy, dx)
    return F.round(F.when(a > F.pi() / 2, a - F.pi()).when(a < -F.pi() / 2, a + F.pi()).otherwise(a), 4)


def vertex_mean(points: Column) -> Column:
    """struct(x, y): the plain mean of points; null without any."""

    def mean(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda s, v: s + v) / F.size(values)

    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    return F.when(F.size(points) > 0, F.struct(mean(xs).alias("x"), mean(ys).alias("y")))
