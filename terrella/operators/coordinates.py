"""Rasters of cell indices and coordinates."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from terrella.grid import Grid
from terrella.raster import Raster


def _made(spark: SparkSession, grid: Grid, column, dtype: str, units: str | None) -> Raster:
    cells = grid.cells(spark).select("row", "col", column.alias("value"))
    return Raster.of(cells, grid, valid=F.lit(True), dtype=dtype, units=units)


def row_indices(spark: SparkSession, grid: Grid) -> Raster:
    return _made(spark, grid, F.col("row").cast("long"), "int64", "pixels")


def column_indices(spark: SparkSession, grid: Grid) -> Raster:
    return _made(spark, grid, F.col("col").cast("long"), "int64", "pixels")


def projected_x(spark: SparkSession, grid: Grid, *, anchor: str = "center") -> Raster:
    return _made(spark, grid, grid.to_projected(F.col("col"), F.col("row"), anchor=anchor)[0], "float64", "metres")


def projected_y(spark: SparkSession, grid: Grid, *, anchor: str = "center") -> Raster:
    return _made(spark, grid, grid.to_projected(F.col("col"), F.col("row"), anchor=anchor)[1], "float64", "metres")


def longitude(spark: SparkSession, grid: Grid, *, anchor: str = "center") -> Raster:
    return _made(spark, grid, grid.pixel_to_lonlat(F.col("col"), F.col("row"), anchor=anchor)[0], "float64", "degrees")


def latitude(spark: SparkSession, grid: Grid, *, anchor: str = "center") -> Raster:
    return _made(spark, grid, grid.pixel_to_lonlat(F.col("col"), F.col("row"), anchor=anchor)[1], "float64", "degrees")
