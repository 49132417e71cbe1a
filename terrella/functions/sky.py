"""Column expressions of sky geometry: observer frames, azimuth and elevation, horizon lookup, visible disk."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.grid import Grid

#: Angles in degrees. The Sun's diameter for shadow tests, and half angle, bucket offset and slices of the disk.
SUN_DIAMETER, SUN_HALF_ANGLE, BUCKET_HALF_WIDTH, SLICES = 0.545, 0.27, 0.125, 16


def frame(grid: Grid, row: Column, col: Column, elevation: Column) -> dict[str, Column]:
    """East, north and up of a cell's corner and the observer's place on a sphere, in metres."""
    x, y = grid.to_projected(col, row, anchor="corner")
    lat, lon = grid.projection.inverse(x, y)
    sa, ca, so, co = F.sin(lat), F.cos(lat), F.sin(lon), F.cos(lon)
    r = F.lit(grid.projection.radius) + elevation.cast("double")
    return {
        "ex": -so, "ey": co, "ez": F.lit(0.0), "nx": -sa * co, "ny": -sa * so, "nz": ca, "ux": ca * co, "uy": ca * so, "uz": sa,
        "px": r * ca * co, "py": r * ca * so, "pz": r * sa,
    }


def enu(f: dict[str, Column], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """East, north and up components of the way from the observer to a body."""
    dx, dy, dz = x - f["px"], y - f["py"], z - f["pz"]
    return tuple(dx * f[a + "x"] + dy * f[a + "y"] + dz * f[a + "z"] for a in "enu")


def azimuth_elevation(east: Column, north: Column, up: Column) -> tuple[Column, Column]:
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)), F.degrees(F.atan2(up, F.hypot(east, north)))


def horizon_at(horizon: Column, azimuth: Column, bins: int = 1440) -> Column:
    """Circular linear interpolation; sample 0 is north."""
    place = F.pmod(azimuth, F.lit(360.0)) * F.lit(bins / 360.0)
    low = F.floor(place)
    a, b = F.get(horizon, (low % bins).cast("int")).cast("double"), F.get(horizon, ((low + 1) % bins).cast("int")).cast("double")
    return a + (place - low) * (b - a)


def visible_fraction(horizon: Column, azimuth: Column, elevation: Column, bins: int = 1440) -> Column:
    """The part of the Sun's disk above the horizon, by slices of the disk at their own azimuths."""
    heights = [math.sqrt(64 - (7.5 - i) ** 2) / 8 * SUN_HALF_ANGLE for i in range(SLICES)]
    start = (azimuth - (SUN_HALF_ANGLE + BUCKET_HALF_WIDTH)) * F.lit(bins / 360.0)
    first = F.when(start >= 0, F.floor(start)).otherwise(F.ceil(start))
    step = 2 * SUN_HALF_ANGLE / SLICES * bins / 360.0
    total = F.lit(0.0)
    for i, h in enumerate(heights):
        q = start - first + F.lit(i * step)
        k = F.greatest(F.floor(q), F.lit(0))
        a = F.get(horizon, F.pmod(first + k, F.lit(bins)).cast("int")).cast("double")
        b = F.get(horizon, F.pmod(first + k + 1, F.lit(bins)).cast("int")).cast("double")
        total = total + F.least(F.greatest(elevation + F.lit(h) - (a + (q - k) * (b - a)), F.lit(0.0)), F.lit(2 * h))
    return total / F.lit(2 * sum(heights))


def disk_byte(fraction: Column) -> Column:
    return F.floor(fraction * F.lit(255.0) + F.lit(1e-9)).cast("int")
