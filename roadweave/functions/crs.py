"""Lambert conformal conic projection (two parallels) in SQL mathematics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Lambert:
    """Parameters from the public registry of EPSG:32198 by default: GRS 80, origin 44 N 68.5 W, parallels 60 N and 46 N."""

    lat0: float = 44.0
    lon0: float = -68.5
    lat1: float = 60.0
    lat2: float = 46.0
    a: float = 6378137.0
    f: float = 1 / 298.257222101

    @property
    def e(self) -> float:
        return math.sqrt(2 * self.f - self.f * self.f)

    def _t(self, phi: float) -> float:
        s = self.e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (self.e / 2)

    def constants(self) -> tuple[float, float, float]:
        """(n, a F, radius at the origin)."""
        p0, p1, p2 = map(math.radians, (self.lat0, self.lat1, self.lat2))
        m = [math.cos(p) / math.sqrt(1 - (self.e * math.sin(p)) ** 2) for p in (p1, p2)]
        n = (math.log(m[0]) - math.log(m[1])) / (math.log(self._t(p1)) - math.log(self._t(p2)))
        af = self.a * m[0] / (n * self._t(p1) ** n)
        return n, af, af * self._t(p0) ** n

    def forward(self, lon: Column, lat: Column) -> Column:
        """STRUCT<x, y> in metres of a place in degrees."""
        n, af, r0 = self.constants()
        phi = F.radians(lat)
        s = F.sin(phi) * self.e
        t = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(self.e / 2))
        r, angle = F.pow(t, F.lit(n)) * af, (F.radians(lon) - math.radians(self.lon0)) * n
        return F.struct((r * F.sin(angle)).alias("x"), (r0 - r * F.cos(angle)).alias("y"))

    def inverse(self, x: Column, y: Column, rounds: int = 6) -> Column:
        """STRUCT<lon, lat> in degrees of a place in metres."""
        n, af, r0 = self.constants()
        r = F.sqrt(x * x + (r0 - y) * (r0 - y)) * math.copysign(1, n)
        t = F.pow(r / af, F.lit(1 / n))
        phi = F.lit(math.pi / 2) - F.atan(t) * 2
        for _ in range(rounds):
            s = F.sin(phi) * self.e
            phi = F.lit(math.pi / 2) - F.atan(t * F.pow((1 - s) / (1 + s), F.lit(self.e / 2))) * 2
        return F.struct((F.degrees(F.atan2(x, r0 - y) / n) + self.lon0).alias("lon"), F.degrees(phi).alias("lat"))
