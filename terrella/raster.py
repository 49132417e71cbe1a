"""A raster: cells of a DataFrame, and the grid, cell type, units and name that belong to them.

Rasters that come from one table share it: an operator adds columns to that table instead of joining, so a chain of
operators over bands of one table is a single projection. Rasters of different tables are joined on (row, col) once, after the
grids were compared on the driver.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import GridError, OperationError
from terrella.functions import dtypes as D
from terrella.grid import Grid

_names = itertools.count()


@dataclass(frozen=True, eq=False)
class Raster:
    """root holds row, col and stored columns; steps are the columns that operators added, in order."""

    root: DataFrame
    grid: Grid
    dtype: str
    value: str
    valid: str
    units: str | None = None
    name: str | None = None
    steps: tuple[tuple[str, Column], ...] = ()
    provenance: str | None = None

    # Making

    @staticmethod
    def of(df: DataFrame, grid: Grid, *, value: str = "value", valid: str | Column | None = None, dtype: str | None = None, nodata: Any = "auto", units: str | None = None, name: str | None = None, provenance: str | None = None) -> Raster:
        """Cells of a table with row and col. valid: a Boolean column, or None: by nodata (the grid's if "auto")."""
        d = D.logical(dtype) if dtype else D.of_storage(df.schema[value].dataType.simpleString())
        v, m = _fresh("v"), _fresh("m")
        if valid is None:
            missing = grid.nodata if isinstance(nodata, str) and nodata == "auto" else nodata
            condition = not_nodata(F.col(value), d, missing) & F.col(value).isNotNull()
            provenance = provenance or ("nodata" if missing is not None else "all_valid")
        else:
            condition = F.coalesce(F.col(valid) if isinstance(valid, str) else valid, F.lit(False))
            provenance = provenance or "explicit"
        root = df.select("row", "col", D.stored(F.col(value), d).alias(v), condition.alias(m))
        return Raster(root, grid, d, v, m, units, name, (), provenance)

    @staticmethod
    def from_array(spark: SparkSession, values, grid: Grid, *, valid=None, nodata: Any = "auto", units: str | None = None, name: str | None = None, dtype: str | None = None) -> Raster:
        """A small array as a raster; also takes a masked array."""
        if isinstance(values, np.ma.MaskedArray):
            valid = ~np.ma.getmaskarray(values)
            values = values.data
        values = np.asarray(values)
        if values.ndim != 2 or values.shape != (grid.height, grid.width):
            raise GridError("The array does not fit the grid.", code="shape_mismatch", details={"shape": values.shape})
        d = D.logical(dtype or values.dtype)
        rows, cols = np.indices(values.shape, dtype=np.int32)
        kind = {"uint64": pa.decimal128(20, 0)}.get(d)
        flat = values.ravel()
        column = pa.array([int(x) for x in flat], kind) if kind else pa.array(flat)
        table = {"row": pa.array(rows.ravel()), "col": pa.array(cols.ravel()), "value": column.cast(pa.int16()) if d == "uint8" else column.cast(pa.int32()) if d == "uint16" else column.cast(pa.int64()) if d == "uint32" else column}
        if valid is not None:
            table["valid"] = pa.array(np.asarray(valid, bool).ravel())
        return Raster.of(spark.createDataFrame(pa.table(table)), grid, valid="valid" if valid is not None else None, dtype=d, nodata=nodata, units=units, name=name)

    def expression(self):
        """The raster as a leaf of a named plan."""
        from terrella.plans.expression import constant

        return constant(self)

    # Views

    @property
    def df(self) -> DataFrame:
        """The table with all steps."""
        return _with(self.root, self.steps)

    def cells(self) -> DataFrame:
        """row, col, value, valid."""
        return self.df.select("row", "col", F.col(self.value).alias("value"), F.col(self.valid).alias("valid"))

    def masked(self) -> DataFrame:
        """row, col, value with NULL where invalid."""
        return self.df.select("row", "col", self.v.alias("value"))

    def filled(self, value) -> DataFrame:
        """row, col, value with another value where invalid."""
        return self.df.select("row", "col", F.coalesce(self.v, D.literal(value, self.dtype)).alias("value"))

    to_existing = filled

    @property
    def v(self) -> Column:
        """The value, NULL where invalid."""
        return F.when(F.col(self.valid), F.col(self.value))

    def collect(self) -> tuple[np.ndarray, np.ndarray]:
        """Values and validity as arrays: for rasters that fit the driver."""
        t = self.cells().toArrow()
        shape = (self.grid.height, self.grid.width)
        at = t["row"].to_numpy() * self.grid.width + t["col"].to_numpy()
        values, valid = np.zeros(shape[0] * shape[1], self.dtype), np.zeros(shape[0] * shape[1], bool)
        column = t["value"].to_pylist()
        values[at] = [0 if x is None else x for x in column]
        valid[at] = t["valid"].to_numpy(zero_copy_only=False)
        return values.reshape(shape), valid.reshape(shape)

    # Deriving

    def derive(self, value: Column, valid: Column, dtype: str, *, units: str | None = None, name: str | None = None) -> Raster:
        """A raster on the same table with one more value and validity."""
        v, m = _fresh("v"), _fresh("m")
        # The validity may look at the new value under the name it is given.
        steps = (*self.steps, (v, D.stored(value, dtype)), (m, valid(v) if callable(valid) and not isinstance(valid, Column) else valid))
        return Raster(self.root, self.grid, dtype, v, m, units, name, steps)

    def with_table(self, df: DataFrame, dtype: str | None = None, *, grid: Grid | None = None, units: Any = "same") -> Raster:
        """A raster on a new table of row, col, value, valid."""
        v, m = _fresh("v"), _fresh("m")
        d = dtype or self.dtype
        root = df.select("row", "col", D.stored(F.col("value"), d).alias(v), F.coalesce(F.col("valid"), F.lit(False)).alias(m))
        return Raster(root, grid or self.grid, d, v, m, self.units if units == "same" else units, None)

    def _replaced(self, **changes) -> Raster:
        return Raster(**{f: getattr(self, f) for f in self.__dataclass_fields__} | changes)

    def with_units(self, units: str | None) -> Raster:
        return self._replaced(units=units)

    def with_name(self, name: str | None) -> Raster:
        return self._replaced(name=name)

    def with_georef(self, grid: Grid) -> Raster:
        if (grid.width, grid.height) != (self.grid.width, self.grid.height):
            raise GridError("The grid has another shape.", code="shape_mismatch")
        return self._replaced(grid=grid)

    def with_validity(self, valid: Raster) -> Raster:
        """The validity that a Boolean raster's true cells state."""
        a, b = aligned(self, valid)
        m = _fresh("m")
        return a._replaced(valid=m, steps=(*a.steps, (m, F.coalesce(b.v, F.lit(False)))), provenance="explicit")

    # Comparing

    def same_grid(self, other: Raster) -> bool:
        return self.grid.same_as(other.grid)

    def same_metadata(self, other: Raster) -> bool:
        return self.same_grid(other) and (self.dtype, self.units, self.name) == (other.dtype, other.units, other.name)

    def array_equal(self, other: Raster, *, equal_invalid_payload: bool = False) -> bool:
        if not self.same_grid(other) or self.dtype != other.dtype:
            return False
        a, b = aligned(self, other)
        x, y = F.col(a.value), F.col(b.value)
        nan = (F.isnan(x) | F.isnan(y)) if D.is_float(self.dtype) else F.lit(False)
        same = x.eqNullSafe(y) & ~nan
        ok = F.col(a.valid).eqNullSafe(F.col(b.valid)) & (same if equal_invalid_payload else ~F.col(a.valid) | same)
        return bool(a.df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok")).first()["ok"])

    def allclose(self, other: Raster, *, rtol: float = 1e-05, atol: float = 1e-08, equal_nan: bool = False) -> bool:
        from terrella.operators.local import close

        if not self.same_grid(other):
            return False
        a, b = aligned(self, other)
        ok = F.col(a.valid).eqNullSafe(F.col(b.valid)) & (~F.col(a.valid) | close(F.col(a.value).cast("double"), F.col(b.value).cast("double"), rtol, atol, equal_nan))
        return bool(a.df.agg(F.coalesce(F.bool_and(ok), F.lit(True)).alias("ok")).first()["ok"])

    def __bool__(self):
        raise OperationError("A raster has no single truth value.", code="ambiguous_truth")

    __hash__ = object.__hash__


def _fresh(prefix: str) -> str:
    return f"_{prefix}{next(_names)}"


def _with(df: DataFrame, steps) -> DataFrame:
    for name, column in steps:
        df = df.withColumn(name, column)
    return df


def not_nodata(c: Column, dtype: str, nodata) -> Column:
    if nodata is None:
        return F.lit(True)
    if isinstance(nodata, float) and nodata != nodata:
        return ~F.isnan(c) if D.is_float(dtype) else F.lit(True)
    return F.coalesce(c != D.literal(nodata, dtype), F.lit(True)) if D.exactly_represents(nodata, dtype) else F.lit(True)


def aligned(*rasters: Raster) -> list[Raster]:
    """The rasters on one table: unchanged tables are shared, others joined on (row, col)."""
    first = rasters[0]
    for r in rasters[1:]:
        first.grid.require_same(r.grid)
    roots: list[DataFrame] = []
    for r in rasters:
        if not any(r.root is x for x in roots):
            roots.append(r.root)
    if len(roots) > 1:
        root = roots[0]
        for other in roots[1:]:
            # Column names are unique, so a name that is there already is the same column.
            more = [c for c in other.columns if c not in root.columns]
            if more:
                root = root.join(other.select("row", "col", *more), ["row", "col"])
    else:
        root = roots[0]
    steps: dict[str, Column] = {}
    for r in rasters:
        steps |= dict(r.steps)
    return [r._replaced(root=root, steps=tuple(steps.items())) for r in rasters]
