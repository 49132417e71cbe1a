"""Grid metadata and the column expressions that follow from it.

A grid is driver-side metadata: size, affine transform, spherical stereographic parameters and nodata. It is never a
column. Everything that maps between cells, projected and geographic coordinates is a column expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import GridError

MOON_RADIUS_M = 1_737_400.0


@dataclass(frozen=True)
class Stereographic:
    """Spherical oblique stereographic parameters in radians and metres."""

    latitude_0: float = -math.pi / 2
    longitude_0: float = 0.0
    radius: float = MOON_RADIUS_M
    scale: float = 1.0
    false_easting: float = 0.0
    false_northing: float = 0.0

    def forward(self, latitude: Column, longitude: Column) -> tuple[Column, Column]:
        """Projected x and y of a latitude and longitude in radians."""
        s0, c0 = F.lit(math.sin(self.latitude_0)), F.lit(math.cos(self.latitude_0))
        away = longitude - self.longitude_0
        k = F.lit(2 * self.radius * self.scale) / (1 + s0 * F.sin(latitude) + c0 * F.cos(latitude) * F.cos(away))
        return (
            k * F.cos(latitude) * F.sin(away) + self.false_easting,
            k * (c0 * F.sin(latitude) - s0 * F.cos(latitude) * F.cos(away)) + self.false_northing,
        )

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Latitude and longitude in radians; at the origin itself, the origin."""
        x, y = x - self.false_easting, y - self.false_northing
        rho = F.hypot(x, y)
        c = 2 * F.atan(rho / F.lit(2 * self.radius * self.scale))
        s0, c0 = F.lit(math.sin(self.latitude_0)), F.lit(math.cos(self.latitude_0))
        share = F.try_divide(y * F.sin(c) * c0, rho)
        latitude = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.cos(c) * s0 + share)))
        longitude = self.longitude_0 + F.atan2(x * F.sin(c), rho * c0 * F.cos(c) - y * s0 * F.sin(c))
        at_origin = rho < 1e-9
        return F.when(at_origin, F.lit(self.latitude_0)).otherwise(latitude), F.when(at_origin, F.lit(self.longitude_0)).otherwise(longitude)


@dataclass(frozen=True)
class Grid:
    """width, height, affine (origin x, dx/dcol, dx/drow, origin y, dy/dcol, dy/drow), projection, nodata."""

    width: int
    height: int
    affine: tuple[float, float, float, float, float, float] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    projection: Stereographic | None = None
    nodata: float | int | None = None

    def __post_init__(self):
        if self.width < 1 or self.height < 1:
            raise GridError("A grid needs at least one cell.", code="invalid_grid_size", details={"width": self.width, "height": self.height})
        _, a, b, _, d, e = self.affine
        if a * e - b * d == 0 or not all(map(math.isfinite, self.affine)):
            raise GridError("The affine transform must be invertible.", code="singular_affine", details={"affine": self.affine})

    # Cells

    def cells(self, spark: SparkSession) -> DataFrame:
        """One row (row, col) for each cell."""
        w = self.width
        return spark.range(self.width * self.height).select(F.expr(f"cast(id div {w} as int)").alias("row"), F.expr(f"cast(id % {w} as int)").alias("col"))

    def contains(self, column: Column, row: Column) -> Column:
        return (column >= 0) & (column < self.width) & (row >= 0) & (row < self.height)

    # Coordinates

    @staticmethod
    def _offset(anchor: str) -> float:
        if anchor not in ("center", "corner"):
            raise GridError("anchor must be 'center' or 'corner'.", code="invalid_anchor", details={"anchor": anchor})
        return 0.5 if anchor == "center" else 0.0

    def to_projected(self, column: Column, row: Column, *, anchor: str = "center") -> tuple[Column, Column]:
        o = self._offset(anchor)
        g = self.affine
        c, r = column + F.lit(o), row + F.lit(o)
        return F.lit(g[0]) + c * F.lit(g[1]) + r * F.lit(g[2]), F.lit(g[3]) + c * F.lit(g[4]) + r * F.lit(g[5])

    def to_pixel(self, x: Column, y: Column, *, anchor: str = "center") -> tuple[Column, Column]:
        o = self._offset(anchor)
        g0, a, b, g3, d, e = self.affine
        det = a * e - b * d
        x, y = x - F.lit(g0), y - F.lit(g3)
        return (x * F.lit(e) - y * F.lit(b)) / F.lit(det) - F.lit(o), (y * F.lit(a) - x * F.lit(d)) / F.lit(det) - F.lit(o)

    def _projection(self) -> Stereographic:
        if self.projection is None:
            raise GridError("The grid has no projection.", code="missing_projection")
        return self.projection

    def to_lonlat(self, x: Column, y: Column) -> tuple[Column, Column]:
        latitude, longitude = self._projection().inverse(x, y)
        return F.degrees(longitude), F.degrees(latitude)

    def from_lonlat(self, longitude: Column, latitude: Column) -> tuple[Column, Column]:
        return self._projection().forward(F.radians(latitude), F.radians(longitude))

    def pixel_to_lonlat(self, column: Column, row: Column, *, anchor: str = "center") -> tuple[Column, Column]:
        return self.to_lonlat(*self.to_projected(column, row, anchor=anchor))

    def lonlat_to_pixel(self, longitude: Column, latitude: Column, *, anchor: str = "center") -> tuple[Column, Column]:
        return self.to_pixel(*self.from_lonlat(longitude, latitude), anchor=anchor)

    # Metadata

    @property
    def pixel_size(self) -> tuple[float, float]:
        _, a, b, _, d, e = self.affine
        return math.hypot(a, d), math.hypot(b, e)

    def bounds(self) -> tuple[float, float, float, float]:
        """min x, min y, max x, max y of the four outer corners."""
        g0, a, b, g3, d, e = self.affine
        corners = [(g0 + c * a + r * b, g3 + c * d + r * e) for c in (0, self.width) for r in (0, self.height)]
        xs, ys = zip(*corners, strict=True)
        return min(xs), min(ys), max(xs), max(ys)

    def with_nodata(self, nodata) -> Grid:
        return replace(self, nodata=nodata)

    def differences(self, other: Grid, *, affine_tolerance: float = 0.0) -> list[str]:
        found = [n for n in ("width", "height", "projection") if getattr(self, n) != getattr(other, n)]
        if any(abs(a - b) > affine_tolerance for a, b in zip(self.affine, other.affine, strict=True)):
            found.append("affine")
        return found

    def same_as(self, other: Grid, *, affine_tolerance: float = 0.0) -> bool:
        """Size, projection and affine agree; nodata does not matter."""
        return not self.differences(other, affine_tolerance=affine_tolerance)

    def require_same(self, other: Grid, *, affine_tolerance: float = 0.0) -> None:
        if found := self.differences(other, affine_tolerance=affine_tolerance):
            raise GridError("Grids differ.", code="grid_mismatch", details={"differences": found})

    def to_dict(self) -> dict:
        p = self.projection
        return {"width": self.width, "height": self.height, "affine": list(self.affine), "projection": None if p is None else vars(p), "nodata": self.nodata}

    @staticmethod
    def from_dict(d: dict) -> Grid:
        return Grid(d["width"], d["height"], tuple(d["affine"]), None if d.get("projection") is None else Stereographic(**d["projection"]), d.get("nodata"))


def enumerate_windows(width: int, height: int, window_width: int = 128, window_height: int = 128) -> list[tuple[int, int, int, int]]:
    """x, y, width and height of row-major windows, smaller at the edges."""
    return [(x, y, min(window_width, width - x), min(window_height, height - y)) for y in range(0, height, window_height) for x in range(0, width, window_width)]


def windows_frame(spark: SparkSession, width: int, height: int, size: int = 128) -> DataFrame:
    """tile_row and tile_col of every tile."""
    rows, cols = -(-height // size), -(-width // size)
    return spark.range(rows * cols).select(F.expr(f"cast(id div {cols} as int)").alias("tile_row"), F.expr(f"cast(id % {cols} as int)").alias("tile_col"))
