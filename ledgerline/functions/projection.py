"""Lambert's conformal conic projection with two standard parallels, as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Conic:
    """Degrees, metres; the defaults are fixed values: the GRS80 ellipsoid and the state plane of Maryland."""

    parallel_1: float = 39.45
    parallel_2: float = 38.3
    latitude_0: float = 37 + 40 / 60
    longitude_0: float = -77.0
    east_0: float = 400_000.0
    north_0: float = 0.0
    axis: float = 6_378_137.0
    flattening: float = 1 / 298.257222101

    @property
    def _e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    def _t(self, degrees: float) -> float:
        e, phi = math.sqrt(self._e2), math.radians(degrees)
        es = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - es) / (1 + es)) ** (e / 2)

    def _cone(self) -> tuple[float, float, float]:
        """The cone's constant, the radius where t is 1, and the radius of the origin."""
        m1, m2 = (math.cos(math.radians(p)) / math.sqrt(1 - self._e2 * math.sin(math.radians(p)) ** 2) for p in (self.parallel_1, self.parallel_2))
        t1, t2 = self._t(self.parallel_1), self._t(self.parallel_2)
        n = math.log(m1 / m2) / math.log(t1 / t2)
        scale = self.axis * m1 / (n * t1**n)
        return n, scale, scale * self._t(self.latitude_0) ** n

    def to_metres(self, lon: Column, lat: Column) -> Column:
        """struct(x, y) of degrees; null if either is null."""
        n, scale, r0 = self._cone()
        e, phi = math.sqrt(self._e2), F.radians(lat)
        es = F.sin(phi) * e
        t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - es) / (1 + es), F.lit(e / 2))
        r, turn = F.pow(t, F.lit(n)) * scale, F.radians(lon - self.longitude_0) * n
        at = F.struct((r * F.sin(turn) + self.east_0).alias("x"), (F.lit(r0 + self.north_0) - r * F.cos(turn)).alias("y"))
        return F.when(lon.isNotNull() & lat.isNotNull(), at)

    def to_degrees(self, x: Column, y: Column) -> Column:
        """struct(lon, lat) of metres, by the series for the latitude; null if either is null."""
        n, scale, r0 = self._cone()
        east, south = x - self.east_0, F.lit(r0 + self.north_0) - y
        t = F.pow(F.sqrt(east * east + south * south) / scale, F.lit(1 / n))
        chi = F.lit(math.pi / 2) - 2 * F.atan(t)
        e2 = self._e2
        series = (
            e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
            7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
            7 * e2**3 / 120 + 81 * e2**4 / 1120,
            4279 * e2**4 / 161280,
        )
        phi = chi
        for k, c in enumerate(series, 1):
            phi = phi + F.sin(chi * (2 * k)) * c
        at = F.struct((F.degrees(F.atan2(east, south) / n) + self.longitude_0).alias("lon"), F.degrees(phi).alias("lat"))
        return F.when(x.isNotNull() & y.isNotNull(), at)
