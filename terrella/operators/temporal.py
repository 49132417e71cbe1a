"""Rasters over time: a table (ts, row, col, value, valid) with its grid, reducers, lifted cell operators and time lookup."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrella.errors import OperationError
from terrella.functions import dtypes as D
from terrella.grid import Grid
from terrella.operators import local
from terrella.operators.reductions import exact
from terrella.raster import Raster

MAX_SAMPLES = 1_000_000


# Time axes


def utc_datetime(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0, microsecond: int = 0, *, fold: int = 0) -> datetime:
    return datetime(year, month, day, hour, minute, second, microsecond, tzinfo=UTC, fold=fold)


def parsed(t: datetime | str, source_timezone=None) -> datetime:
    if isinstance(t, str):
        t = datetime.fromisoformat(t)
    if t.tzinfo is None:
        if source_timezone is None:
            raise OperationError("A time without zone needs source_timezone.", code="naive_time")
        t = t.replace(tzinfo=source_timezone)
    return t.astimezone(UTC)


def _sql(t: datetime) -> Column:
    return F.timestamp_micros(F.lit(round((t - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))))


def axis(spark: SparkSession, start, stop, step: timedelta, *, source_timezone=None) -> DataFrame:
    """layer and ts from start to stop, both included where the step meets it."""
    a, b = parsed(start, source_timezone), parsed(stop, source_timezone)
    us = round(step / timedelta(microseconds=1))
    if us <= 0 or b < a:
        raise OperationError("A time axis needs a positive step and start <= stop.", code="invalid_time_range")
    n = (b - a) // timedelta(microseconds=us) + 1
    if n > MAX_SAMPLES:
        raise OperationError("The time axis has too many samples.", code="too_many_samples", details={"samples": n, "limit": MAX_SAMPLES})
    first = round((a - datetime(1970, 1, 1, tzinfo=UTC)) / timedelta(microseconds=1))
    return spark.range(n).select(F.col("id").alias("layer"), F.timestamp_micros(F.lit(first) + F.col("id") * F.lit(us)).alias("ts"))


def times(spark: SparkSession, start, stop, *, step_hours: float, source_timezone=None) -> DataFrame:
    return axis(spark, start, stop, timedelta(microseconds=round(step_hours * 3_600_000_000)), source_timezone=source_timezone)


def iter_times(start, stop, step: timedelta):
    t, stop = parsed(start), parsed(stop)
    while t <= stop:
        yield t
        t += step


# The type


@dataclass(frozen=True, eq=False)
class TemporalRaster:
    df: DataFrame
    grid: Grid
    dtype: str
    units: str | None = None
    name: str | None = None

    @staticmethod
    def of(df: DataFrame, grid: Grid, *, dtype: str | None = None, nodata="auto", units: str | None = None, name: str | None = None) -> TemporalRaster:
        """A table of ts, row, col, value and perhaps valid; without valid, by nodata."""
        from terrella.raster import not_nodata

        d = D.logical(dtype) if dtype else D.of_storage(df.schema["value"].dataType.simpleString())
        missing = grid.nodata if isinstance(nodata, str) and nodata == "auto" else nodata
        ok = F.coalesce(F.col("valid"), F.lit(False)) if "valid" in df.columns else F.col("value").isNotNull() & not_nodata(F.col("value"), d, missing)
        return TemporalRaster(df.select(F.col("ts").cast("timestamp").alias("ts"), "row", "col", D.stored(F.col("value"), d).alias("value"), ok.alias("valid")), grid, d, units, name)

    @property
    def v(self) -> Column:
        return F.when(F.col("valid"), F.col("value"))

    def axis(self) -> DataFrame:
        """layer and ts in order. The axis is small against the cells."""
        from pyspark.sql import Window

        return self.df.select("ts").distinct().withColumn("layer", F.row_number().over(Window.orderBy("ts")).cast("long") - 1)

    def layer(self, index: int) -> Raster:
        return self.at(self.time_for_layer(index))

    def at(self, ts: datetime) -> Raster:
        """One time: a filter that prunes partitions where the table is stored by time."""
        return Raster.of(self.df.filter(F.col("ts") == _sql(ts)), self.grid, valid="valid", dtype=self.dtype, units=self.units, name=self.name)

    def time_for_layer(self, index: int) -> datetime:
        found = self.axis().filter(F.col("layer") == index).select(F.unix_micros("ts")).first()
        if found is None:
            raise OperationError("There is no such layer.", code="layer_out_of_range", details={"layer": index})
        return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=found[0])

    def layer_for_time(self, time, *, method: str = "exact") -> int:
        asked = self.df.sparkSession.range(1).select(_sql(parsed(time)).alias("ts"))
        found = lookup(asked, self.axis(), method=method).first()["layer"]
        if found is None:
            raise OperationError("No layer satisfies the lookup.", code="time_not_found", details={"time": str(time), "method": method})
        return found

    def read_time(self, time, *, method: str = "exact") -> Raster:
        return self.layer(self.layer_for_time(time, method=method))

    def with_units(self, units: str | None) -> TemporalRaster:
        return replace(self, units=units)

    def with_name(self, name: str | None) -> TemporalRaster:
        return replace(self, name=name)


def lookup(asked: DataFrame, axis_: DataFrame, *, method: str = "exact") -> DataFrame:
    """layer for each row of `asked` (ts): exact, before (last <= ts), after (first >= ts), nearest (ties earlier, not outside the axis)."""
    if method not in ("exact", "before", "after", "nearest"):
        raise OperationError("Unknown lookup method.", code="invalid_lookup_method", details={"method": method})
    a = F.broadcast(axis_.select(F.col("ts").alias("_t"), "layer")) if method == "exact" else axis_.select(F.col("ts").alias("_t"), "layer")
    if method == "exact":
        return asked.join(a, F.col("ts") == F.col("_t"), "left").drop("_t")
    # The axis is bounded, so it travels with the function, and each Arrow batch is one binary search.
    held = axis_.select(F.unix_micros("ts").alias("us"), "layer").orderBy("us").limit(MAX_SAMPLES + 1).toArrow()
    if held.num_rows > MAX_SAMPLES:
        raise OperationError("The time axis has too many samples.", code="too_many_samples", details={"limit": MAX_SAMPLES})
    moments, layers = held["us"].to_numpy(), held["layer"].to_pylist()
    found = _finder(method, moments)
    position = found(F.unix_micros(F.col("ts").cast("timestamp")))
    if layers == list(range(len(layers))):
        return asked.withColumn("layer", position)
    names = asked.sparkSession.createDataFrame(list(enumerate(layers)), "_i long, layer long")
    return asked.withColumn("_i", position).join(F.broadcast(names), "_i", "left").drop("_i")


def _finder(method: str, moments: np.ndarray):
    """A vectorised function from microseconds to a place on the axis, NULL where none fits."""

    @F.pandas_udf("long")
    def find(us: pd.Series) -> pd.Series:
        t = us.to_numpy(dtype=np.int64)
        n = len(moments)
        after = np.searchsorted(moments, t, side="left")
        before = np.searchsorted(moments, t, side="right") - 1
        if method == "after":
            place, ok = after, after < n
        elif method == "before":
            place, ok = before, before >= 0
        else:
            ok = (after < n) & (before >= 0)
            a, b = np.clip(after, 0, max(n - 1, 0)), np.clip(before, 0, max(n - 1, 0))
            place = np.where(t - moments[b] <= moments[a] - t, b, a) if n else after
        return pd.Series(np.where(ok, place, 0), dtype="Int64").where(pd.Series(ok), pd.NA)

    return find


# Reducers


def _reduced(t: TemporalRaster, name: str, value: Column, valid: Column, units="same") -> Raster:
    d = D.accumulator(t.dtype, name)
    table = t.df.withColumn("v", t.v).groupBy("row", "col").agg(value.alias("value"), valid.alias("valid"))
    out = Raster.of(table.select("row", "col", F.when(F.col("valid"), F.col("value")).alias("value"), "valid"), t.grid, valid="valid", dtype=d, units=t.units if units == "same" else units)
    return out


def _number(t: TemporalRaster) -> Column:
    return F.col("v").cast("int") if t.dtype == "bool" else F.col("v")


def temporal_mean(t: TemporalRaster) -> Raster:
    v = F.col("v")
    return _reduced(t, "mean", F.try_divide(F.sum(exact(v, t.dtype)).cast("double"), F.count(v).cast("double")), F.count(v) > 0)


def temporal_min(t: TemporalRaster) -> Raster:
    return _reduced(t, "min", F.min("v"), F.count("v") > 0)


def temporal_max(t: TemporalRaster) -> Raster:
    return _reduced(t, "max", F.max("v"), F.count("v") > 0)


def temporal_sum(t: TemporalRaster) -> Raster:
    return _reduced(t, "sum", F.sum(exact(F.col("v"), t.dtype)), F.count("v") > 0)


def temporal_count(t: TemporalRaster) -> Raster:
    return _reduced(t, "count", F.count("v"), F.count(F.lit(1)) >= 0, units=None)


def temporal_std(t: TemporalRaster, *, ddof: float = 0) -> Raster:
    """Valid where more samples than ddof are."""
    if ddof < 0:
        raise OperationError("ddof must not be negative.", code="invalid_ddof")
    n = F.count("v").cast("double")
    return _reduced(t, "std", F.sqrt(F.try_divide(F.var_pop(_number(t).cast("double")) * n, n - F.lit(float(ddof)))), n > ddof)


REDUCERS: dict[str, Callable] = {"mean": temporal_mean, "min": temporal_min, "max": temporal_max, "sum": temporal_sum, "count": temporal_count, "std": temporal_std}


def masked_reduction(t: TemporalRaster, operation: str, *, nodata, dtype: str | None = None, ddof: float = 0) -> DataFrame:
    """The array form: row, col, value with nodata where no sample is valid; an accumulator dtype may be given."""
    out = REDUCERS[operation](t, **({"ddof": ddof} if operation == "std" else {}))
    d = D.logical(dtype) if dtype else out.dtype
    return out.df.select("row", "col", F.coalesce(D.stored(out.v, d), D.literal(nodata, d)).alias("value"))


# Lifted cell operators


def lifted(operation: Callable[..., Raster], *operands, **options) -> TemporalRaster:
    """Any cell operator, layer by layer. Temporal operands have one axis; spatial ones are repeated over time."""
    series = [o for o in operands if isinstance(o, TemporalRaster)]
    if not series:
        raise OperationError("A temporal operand is needed.", code="no_temporal_operand")
    first = series[0]
    wide = first.df.select("ts", "row", "col", F.col("value").alias("v0"), F.col("valid").alias("m0"))
    keep = {id(first): ("v0", "m0")}
    for o in operands:
        if id(o) in keep or not isinstance(o, TemporalRaster | Raster):
            continue
        first.grid.require_same(o.grid)
        n = f"{len(keep)}"
        if isinstance(o, TemporalRaster):
            if first.axis().select("ts").exceptAll(o.axis().select("ts")).limit(1).count() or o.axis().select("ts").exceptAll(first.axis().select("ts")).limit(1).count():
                raise OperationError("Temporal operands need identical time axes.", code="time_axis_mismatch")
            wide = wide.join(o.df.select("ts", "row", "col", F.col("value").alias(f"v{n}"), F.col("valid").alias(f"m{n}")), ["ts", "row", "col"])
        else:
            wide = wide.join(o.cells().select("row", "col", F.col("value").alias(f"v{n}"), F.col("valid").alias(f"m{n}")), ["row", "col"])
        keep[id(o)] = (f"v{n}", f"m{n}")
    parts = [Raster(wide, first.grid, o.dtype, *keep[id(o)], o.units, o.name) if id(o) in keep else o for o in operands]
    out = operation(*parts, **options)
    return TemporalRaster(out.df.select("ts", "row", "col", F.col(out.value).alias("value"), F.col(out.valid).alias("valid")), first.grid, out.dtype, out.units, first.name)


def broadcast_over(spatial: Raster, axis_: DataFrame) -> TemporalRaster:
    """A spatial raster repeated at every time of an axis."""
    return TemporalRaster(spatial.cells().crossJoin(F.broadcast(axis_.select("ts"))).select("ts", "row", "col", "value", "valid"), spatial.grid, spatial.dtype, spatial.units, spatial.name)


def from_temporal_cube(spark: SparkSession, times_, values, grid: Grid, *, nodata="auto", units: str | None = None, name: str | None = None) -> TemporalRaster:
    """Strictly increasing times and a (time, row, col) array."""
    moments = [parsed(t) for t in times_]
    if any(b <= a for a, b in zip(moments, moments[1:], strict=False)) or len(moments) != len(values):
        raise OperationError("Times rise strictly and there is one layer for each.", code="invalid_time_axis")
    out = None
    for t, layer in zip(moments, values, strict=True):
        r = Raster.from_array(spark, layer, grid, nodata=nodata)
        part = r.cells().withColumn("ts", _sql(t))
        out = part if out is None else out.unionByName(part)
        d = r.dtype
    return TemporalRaster(out.select("ts", "row", "col", "value", "valid"), grid, d, units, name)


def to_temporal_cube(t: TemporalRaster) -> tuple[list[datetime], np.ndarray, np.ndarray]:
    """Times, values and validity as (time, row, col) arrays: the inverse of `from_temporal_cube`, for series that fit the driver."""
    moments = [r["us"] for r in t.axis().select(F.unix_micros("ts").alias("us")).orderBy("us").collect()]
    layers = [Raster(t.df.filter(F.unix_micros("ts") == us).select("row", "col", "value", "valid"), t.grid, t.dtype, "value", "valid", t.units, t.name).collect() for us in moments]
    shape = (0, t.grid.height, t.grid.width)
    values = np.stack([v for v, _ in layers]) if layers else np.empty(shape, t.dtype)
    valid = np.stack([m for _, m in layers]) if layers else np.empty(shape, bool)
    return [datetime(1970, 1, 1, tzinfo=UTC) + timedelta(microseconds=us) for us in moments], values, valid


def densified(df: DataFrame, axis_: DataFrame, grid: Grid) -> DataFrame:
    """Every cell at every time; value is NULL where the table has none."""
    cells = grid.cells(df.sparkSession).crossJoin(F.broadcast(axis_.select("ts")))
    return cells.join(df, ["ts", "row", "col"], "left")


def _install() -> None:
    names = {"add": local.add, "sub": local.subtract, "mul": local.multiply, "truediv": local.divide, "floordiv": local.floor_divide, "mod": local.remainder, "pow": local.power, "lt": local.less, "le": local.less_equal, "gt": local.greater, "ge": local.greater_equal, "eq": local.equal, "ne": local.not_equal, "and": local.logical_and, "or": local.logical_or, "xor": local.logical_xor}
    for n, f in names.items():
        setattr(TemporalRaster, f"__{n}__", lambda self, other, f=f: lifted(f, self, other))
        if n not in ("lt", "le", "gt", "ge", "eq", "ne"):
            setattr(TemporalRaster, f"__r{n}__", lambda self, other, f=f: lifted(f, other, self))
    for n, f in {"neg": local.negative, "abs": local.absolute, "invert": local.logical_not}.items():
        setattr(TemporalRaster, f"__{n}__", lambda self, f=f: lifted(f, self))
    TemporalRaster.__hash__ = object.__hash__


_install()


