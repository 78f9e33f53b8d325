"""Coordinates, distances and moving points as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis in metres and inverse flattening.
AXIS, INVERSE_FLATTENING = 6378137.0, 298.257223563


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Geodetic degrees and metres to earth-centred x, y, z in metres."""
    flat = 1 / INVERSE_FLATTENING
    e2 = 2 * flat - flat * flat
    phi, lam = F.radians(lat), F.radians(lon)
    n = AXIS / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (n + alt) * F.cos(phi) * F.cos(lam), (n + alt) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + alt) * F.sin(phi)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Degrees to spherical Web-Mercator x, y in metres."""
    import math

    return AXIS * F.radians(lon), AXIS * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def distance(ax: Column, ay: Column, az: Column, bx: Column, by: Column, bz: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by) + (az - bz) * (az - bz))


def cell(p: Column, low: Column, side: float) -> Column:
    """Index of the grid cell that holds p."""
    return F.floor((p - low) / F.lit(side)).cast("long")


def cell_distance(a: list[Column], b: list[Column], side: float) -> Column:
    """Distance between the corners of two cells given by indices."""
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))) * side


def at_time(start: Column, end: Column, axis: str, t: Column) -> Column:
    """Position on an axis at time t of a point that moves evenly from start to end (structs t, x, y, z)."""
    return start[axis] + velocity(start, end, axis) * (t - start["t"])


def velocity(start: Column, end: Column, axis: str) -> Column:
    span = end["t"] - start["t"]
    return F.when(span != 0, (end[axis] - start[axis]) / F.nullif(span, F.lit(0.0))).otherwise(F.lit(0.0))


def closest_after(position: list[Column], speed: list[Column], span: Column) -> Column:
    """Time after the beginning, within 0 to span, at which a relative motion is nearest to zero; 0 without motion."""
    along = sum((p * v for p, v in zip(position, speed, strict=True)), F.lit(0.0))
    square = sum((v * v for v in speed), F.lit(0.0))
    return F.when(square == 0, F.lit(0.0)).otherwise(F.least(span, F.greatest(F.lit(0.0), -along / F.nullif(square, F.lit(0.0)))))


def snapped(t: Column, prev: Column, now: Column) -> Column:
    """The nearer end of the epoch; its later one on a tie."""
    return F.when(F.abs(prev - t) < F.abs(now - t), prev).otherwise(now)
