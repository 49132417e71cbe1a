"""Catalogues of map products (JSON with regions and products), and folders of inputs and outputs."""

from __future__ import annotations

import hashlib
import json
import posixpath
import urllib.request
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import OperationError, StorageError
from terrella.functions.text import safe_scenario_name
from terrella.grid import Grid
from terrella.operators import products
from terrella.sources import rasters, tiles

PRODUCT = "name STRING, url STRING, description STRING, bounds ARRAY<DOUBLE>, region STRING"
REGION = "name STRING, overview_geotiff STRING"


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Regions (name, overview_geotiff) and products (id from 1 in file order, name, url, description, bounds, region)."""
    raw = spark.read.schema(f"regions ARRAY<STRUCT<{REGION.replace(' STRING', ': STRING')}>>, products ARRAY<STRUCT<name: STRING, url: STRING, description: STRING, bounds: ARRAY<DOUBLE>, region: STRING>>").option("mode", "FAILFAST").json(path, multiLine=True)
    if raw.filter("regions IS NULL OR products IS NULL").limit(1).count() or not raw.limit(1).count():
        raise StorageError("The catalogue lacks a required key.", code="product_catalog_missing_key", details={"path": path})
    regions = raw.select(F.explode("regions").alias("r")).select("r.*")
    found = raw.select(F.posexplode("products").alias("i", "p")).select((F.col("i") + 1).alias("id"), "p.*").withColumn("description", F.coalesce("description", F.lit("")))
    if found.filter("bounds IS NULL OR size(bounds) <> 4").limit(1).count():
        raise StorageError("Bounds are four numbers.", code="product_bounds_invalid")
    if found.join(regions, found.region == regions.name, "left_anti").limit(1).count():
        raise StorageError("A product names an unknown region.", code="product_region_unknown")
    return regions, found


def download(url: str, target: str, *, overwrite: bool = False, progress=None) -> str:
    """Fetch one file on the driver to `target`.part, then rename."""
    import os

    if os.path.exists(target) and not overwrite:
        raise StorageError("The file exists.", code="output_exists", details={"path": target})
    with urllib.request.urlopen(url) as source, open(f"{target}.part", "wb") as out:
        n = 0
        while part := source.read(1 << 20):
            out.write(part)
            n += len(part)
            if progress is not None:
                progress({"phase": "download", "completed": n})
    os.replace(f"{target}.part", target)
    return target


def download_directory(*, scenario_root: str | None, scenario: str | None, environ_root: str | None, current: str = ".") -> str:
    if scenario is None:
        if scenario_root is not None:
            raise OperationError("A scenario name is needed with a root.", code="scenario_name_required")
        return current
    root = scenario_root or environ_root
    if not root:
        raise OperationError("A scenario root is needed.", code="scenario_root_required")
    return posixpath.join(root, scenario)


def scenario_name(product_name: str) -> str:
    return safe_scenario_name(product_name)


@dataclass(frozen=True)
class LonLat:
    longitude: float
    latitude: float

    def __post_init__(self):
        if not (-360 <= self.longitude <= 360 and -90 <= self.latitude <= 90):
            raise OperationError("Longitude or latitude is out of range.", code="invalid_lonlat")


class Scenario:
    """A folder of inputs and outputs: dem, horizons and what was made of them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, relative: str, *, allow_root: bool = True) -> str:
        clean = posixpath.normpath(relative or ".")
        if clean.startswith(("..", "/")) or (clean == "." and not allow_root):
            raise OperationError("A path lies below the scenario's root.", code="scenario_path_escape", details={"path": relative})
        return self.root if clean == "." else f"{self.root}/{clean}"

    def output_path(self, relative: str) -> str:
        return self.path(relative, allow_root=False)

    def dem_path(self) -> str:
        return self.path("dem")

    def horizons_path(self) -> str:
        return self.path("horizons")

    def dem(self):
        return rasters.read(self.spark, self.dem_path())

    @property
    def grid(self) -> Grid:
        return Grid.from_dict(rasters.read_meta(self.spark, self.dem_path())["grid"])

    def _pixel(self, x: int, y: int) -> tuple[int, int]:
        g = self.grid
        if not (0 <= x < g.width and 0 <= y < g.height):
            raise OperationError("The pixel lies outside the grid.", code="pixel_out_of_range", details={"x": x, "y": y})
        return x, y

    def horizon_patch_row_col(self, x: int, y: int) -> tuple[int, int]:
        x, y = self._pixel(x, y)
        return y // tiles.PATCH, x // tiles.PATCH

    def horizon_patch_pixel(self, x: int, y: int) -> tuple[int, int]:
        x, y = self._pixel(x, y)
        return x % tiles.PATCH, y % tiles.PATCH

    def horizon_for_pixel(self, x: int, y: int, observer_height_decimeters: int = 0) -> list[float]:
        return tiles.horizon_for_pixel(self.spark, self.horizons_path(), x, y, observer_height_decimeters)

    def lonlat_to_dem_pixel(self, point: LonLat) -> tuple[int, int]:
        c, r = self.grid.lonlat_to_pixel(F.lit(point.longitude), F.lit(point.latitude), anchor="corner")
        found = self.spark.range(1).select(F.floor(c).alias("c"), F.floor(r).alias("r")).first()
        return self._pixel(found["c"], found["r"])

    def body_over_horizon(self, point: LonLat, vectors: DataFrame, *, observer_height_decimeters: int = 0) -> DataFrame:
        x, y = self.lonlat_to_dem_pixel(point)
        return products.point_over_horizon(vectors, self.horizon_for_pixel(x, y, observer_height_decimeters), point.longitude, point.latitude, self.grid.projection.radius)

    def _cells(self, observer_height_m: float) -> DataFrame:
        horizons = tiles.read_store(self.spark, self.horizons_path(), observer_decimeters=int(observer_height_m * 10))
        return products.horizon_cells(horizons, self.dem().cells())

    def generate_horizons(self, *, maximum_m: float, observer_height_m: float = 0.0, surrounding=()) -> None:
        from terrella.operators import horizon

        passes = [horizon.generate_horizons(self.dem().cells(), self.grid, maximum_m=maximum_m, observer_height=observer_height_m)]
        passes += [horizon.generate_horizons(r.cells(), r.grid, maximum_m=maximum_m, observer_height=observer_height_m) for r in surrounding]
        tiles.write_store(passes[0] if len(passes) == 1 else horizon.merge_passes(passes), self.horizons_path(), observer_decimeters=int(observer_height_m * 10))

    def _identity(self, product: str, observer_height_m: float, made_of: dict) -> str:
        """A digest of a product's name, terrain, options and the contents of its tables."""

        def told(x):
            if not isinstance(x, DataFrame):
                return str(x)
            columns = sorted(x.columns)
            r = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("h")).first()
            return [columns, r["n"], str(r["h"])]

        terrain = rasters.read_meta(self.spark, self.dem_path())
        text = json.dumps([product, observer_height_m, terrain, {k: told(v) for k, v in made_of.items()}], sort_keys=True, default=str)
        return hashlib.sha256(text.encode()).hexdigest()

    def _product(self, product: str, made: DataFrame, output: str, resume: bool, observer_height_m: float, **made_of) -> str:
        target = self.output_path(output)
        rasters.write_product(made, target, resume=resume, identity=self._identity(product, observer_height_m, made_of))
        return target

    def lightmap(self, output: str, *, sun_vectors: DataFrame, observer_height_m: float = 0.0, resume: bool = True) -> str:
        return self._product("lightmap", products.lightmap(self._cells(observer_height_m), sun_vectors, self.grid), output, resume, observer_height_m, vectors=sun_vectors)

    def psr(self, output: str, *, sun_vectors: DataFrame, observer_height_m: float = 0.0, resume: bool = True) -> str:
        return self._product("psr", products.psr(self._cells(observer_height_m), sun_vectors, self.grid), output, resume, observer_height_m, vectors=sun_vectors)

    def sun_elevation(self, output: str, *, sun_vectors: DataFrame, observer_height_m: float = 0.0, resume: bool = True) -> str:
        return self._product("elevation", products.body_elevation(self._cells(observer_height_m), sun_vectors, self.grid), output, resume, observer_height_m, vectors=sun_vectors)

    earth_elevation = sun_elevation

    def safe_havens(self, output: str, *, sun_vectors: DataFrame, earth_vectors: DataFrame, step: timedelta, observer_height_m: float = 0.0, resume: bool = True, **thresholds) -> str:
        return self._product("safe_havens", products.safe_havens(self._cells(observer_height_m), sun_vectors, earth_vectors, self.grid, step=step, **thresholds), output, resume, observer_height_m, sun=sun_vectors, earth=earth_vectors, step=step, **thresholds)

    def mission_duration(self, output: str, *, axis: DataFrame, intervals: DataFrame, stop, observer_height_m: float = 0.0, resume: bool = True, **conditions) -> str:
        return self._product("mission_duration", products.mission_duration_from(self._cells(observer_height_m), self.grid, axis, intervals, stop=stop, **conditions), output, resume, observer_height_m, axis=axis, intervals=intervals, stop=stop, **conditions)


def open_scenario(spark: SparkSession, root: str) -> Scenario:
    return Scenario(spark, root)
