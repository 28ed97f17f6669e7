"""Geometry on WGS84 longitudes and latitudes as Columns. Points are struct<lon,lat>, rings are arrays of points."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: mean radius of the earth in metres.
EARTH = 6_371_000.0
METRES = {"m": 1.0, "km": 1_000.0, "mi": 1_609.344, "nmi": 1_852.0}


@dataclass(frozen=True)
class Point:
    lon: float
    lat: float

    def __post_init__(self):
        if not (-180 <= self.lon <= 180 and -90 <= self.lat <= 90):
            raise ValueError(f"no place on earth: {self.lon}, {self.lat}")

    def column(self) -> Column:
        return F.struct(F.lit(float(self.lon)).alias("lon"), F.lit(float(self.lat)).alias("lat"))


@dataclass(frozen=True)
class Polygon:
    ring: tuple

    def __init__(self, ring):
        points = [p if isinstance(p, Point) else Point(*p) for p in ring]
        if len(set(points)) < 3:
            raise ValueError("a polygon needs three distinct points")
        if points[0] != points[-1]:
            points.append(points[0])
        object.__setattr__(self, "ring", tuple(points))

    def column(self) -> Column:
        return F.array(*(p.column() for p in self.ring))

    def box(self) -> tuple[float, float, float, float]:
        return min(p.lon for p in self.ring), min(p.lat for p in self.ring), max(p.lon for p in self.ring), max(p.lat for p in self.ring)


def distance_metres(amount: float, unit: str = "m") -> float:
    return float(amount) * METRES[unit]


def haversine(a: Column, b: Column) -> Column:
    """Metres between two points on the great circle."""
    lat1, lat2 = F.radians(a["lat"]), F.radians(b["lat"])
    dlat, dlon = lat2 - lat1, F.radians(b["lon"]) - F.radians(a["lon"])
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def radius_box(p: Point, metres: float) -> list[tuple[float, float, float, float]]:
    """Boxes that hold every point within the radius; two where the antimeridian is crossed."""
    dlat = math.degrees(metres / EARTH)
    south, north = max(-90.0, p.lat - dlat), min(90.0, p.lat + dlat)
    scale = math.cos(math.radians(p.lat))
    if south <= -90 or north >= 90 or scale < 1e-9:
        return [(-180.0, south, 180.0, north)]
    x = math.sin(min(metres / EARTH, math.pi / 2)) / scale
    if x >= 1:
        return [(-180.0, south, 180.0, north)]
    dlon = math.degrees(math.asin(x))
    west, east = p.lon - dlon, p.lon + dlon
    if west < -180:
        return [(west + 360, south, 180.0, north), (-180.0, south, east, north)]
    if east > 180:
        return [(west, south, 180.0, north), (-180.0, south, east - 360, north)]
    return [(west, south, east, north)]


def in_box(c: Column, box) -> Column:
    west, south, east, north = box
    return F.coalesce((c["lon"] >= west) & (c["lon"] <= east) & (c["lat"] >= south) & (c["lat"] <= north), F.lit(False))


def ring_box(ring: Column) -> Column:
    lons, lats = F.transform(ring, lambda p: p["lon"]), F.transform(ring, lambda p: p["lat"])
    return F.struct(F.array_min(lons).alias("west"), F.array_min(lats).alias("south"), F.array_max(lons).alias("east"), F.array_max(lats).alias("north"))


def boxes_meet(a: Column, b: Column) -> Column:
    return F.coalesce((a["west"] <= b["east"]) & (a["east"] >= b["west"]) & (a["south"] <= b["north"]) & (a["north"] >= b["south"]), F.lit(False))


def _sides(ring: Column) -> Column:
    """The segments between a ring's points."""
    starts, ends = F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0)))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def on_ring(p: Column, ring: Column) -> Column:
    """Points of the boundary itself; rings of fewer than four points have none."""

    def holds(s):
        a, b = s["a"], s["b"]
        level = (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) == (b["lat"] - a["lat"]) * (p["lon"] - a["lon"])
        return level & p["lon"].between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & p["lat"].between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    return F.coalesce((F.size(ring) >= 4) & F.exists(_sides(ring), holds), F.lit(False))


def meets_ring(p: Column, ring: Column) -> Column:
    """Within the ring or on its boundary."""
    return in_ring(p, ring) | on_ring(p, ring)


def in_ring(p: Column, ring: Column) -> Column:
    """Even-odd rule; rings of fewer than four points contain nothing."""

    def crosses(s):
        a, b = s["a"], s["b"]
        across = (a["lat"] > p["lat"]) != (b["lat"] > p["lat"])
        rise = F.when(b["lat"] == a["lat"], F.lit(1e-300)).otherwise(b["lat"] - a["lat"])
        return across & (p["lon"] < (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) / rise + a["lon"])

    odd = F.size(F.filter(_sides(ring), crosses)) % 2 == 1
    return F.coalesce((F.size(ring) >= 4) & odd, F.lit(False))
