"""Statistics by zone, and their serialisation."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrella.errors import DTypeError, OperationError
from terrella.functions import dtypes as D
from terrella.operators.quantiles import grouped_quantiles
from terrella.operators.reductions import exact
from terrella.raster import Raster, aligned

STATISTICS = ("count", "valid_count", "invalid_count", "sum", "mean", "min", "max", "range", "std", "variance", "median", "p25", "p75", "p90")


#: Percentiles by name, and the values of a zone up to which one aggregate buffer holds them.
_SHARES = {"median": 0.5, "p25": 0.25, "p75": 0.75, "p90": 0.9}
HELD_VALUES = 5_000_000


def _largest(table: DataFrame) -> int:
    return table.groupBy("zone").agg(F.count("value").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def _with_quantiles(table: DataFrame, names: list[str], held: list[str], d: str) -> DataFrame:
    plain = table.groupBy("zone").agg(F.count("*").alias("_cells"), *(_aggregate(n, d) for n in names if n not in held))
    x = table.select("zone", F.col("value").cast("int").alias("value") if d == "bool" else "value")
    q = grouped_quantiles(x, "zone", "value", sorted({_SHARES[n] for n in held}))
    wide = q.groupBy("zone").agg(*(F.max(F.when(F.col("share") == _SHARES[n], F.col("quantile"))).alias(n) for n in held))
    return plain.join(wide, "zone", "left").select("zone", *names)


def _aggregate(name: str, d: str) -> Column:
    """`value` is NULL where invalid; count takes every cell of the zone."""
    v = F.col("value").cast("int") if d == "bool" else F.col("value")
    x = v.cast("double")
    total = F.sum(exact(v, d))
    whole = total if D.is_float(d) else total.cast("decimal(38,0)").cast(D.STORAGE[D.accumulator(d, "sum")])
    return {
        "count": F.count("*"), "valid_count": F.count(v), "invalid_count": F.count("*") - F.count(v), "sum": whole,
        "mean": F.try_divide(total.cast("double"), F.count(v).cast("double")), "min": F.min(v), "max": F.max(v), "range": F.max(x) - F.min(x),
        "std": F.stddev_pop(x), "variance": F.var_pop(x), "median": F.median(v), "p25": F.percentile(v, F.lit(0.25)), "p75": F.percentile(v, F.lit(0.75)), "p90": F.percentile(v, F.lit(0.9)),
    }[name].alias(name)


def _zoned(values: Raster, zones: Raster, zone_nodata) -> tuple[DataFrame, str]:
    if not (D.is_int(zones.dtype) or zones.dtype == "bool"):
        raise DTypeError("Zones are integer or Boolean.", code="invalid_zone_dtype", details={"dtype": zones.dtype})
    a, z = aligned(values, zones)
    table = a.df.select("row", "col", z.v.alias("zone"), a.v.alias("value"), F.col(a.valid).alias("valid"))
    inside = F.col("zone").isNotNull()
    if zone_nodata is not None and D.exactly_represents(zone_nodata, zones.dtype):
        inside = inside & (F.col("zone") != D.literal(zone_nodata, zones.dtype))
    return table, inside


def zonal_stats(values: Raster, zones: Raster, *, statistics: Sequence[str] | None = None, include_zone_ids: Sequence | None = None, zone_nodata=None, held_values: int = HELD_VALUES) -> DataFrame:
    """zone and one column a statistic; value statistics of zones without valid values are NULL.

    Medians and percentiles of zones with more than held_values values are found by narrowing ranges instead of in one buffer.
    """
    names = list(STATISTICS[:9] if statistics is None else statistics)
    if not names or len(set(names)) != len(names) or set(names) - set(STATISTICS):
        raise OperationError("Unknown or repeated statistics.", code="invalid_statistics", details={"statistics": names})
    table, inside = _zoned(values, zones, zone_nodata)
    held = [n for n in names if n in _SHARES]
    if held and _largest(table.filter(inside)) > held_values:
        out = _with_quantiles(table.filter(inside), names, held, values.dtype)
    else:
        out = table.filter(inside).groupBy("zone").agg(*(_aggregate(n, values.dtype) for n in names))
    if include_zone_ids is not None:
        spark = values.root.sparkSession
        ids = spark.createDataFrame([(i,) for i in sorted(set(include_zone_ids))], f"zone {D.STORAGE[zones.dtype]}")
        every = ids.unionAll(out.select("zone")).distinct()
        counts = [n for n in names if n.endswith("count")]
        out = every.join(out, "zone", "left").fillna(0, counts)
    return out


def zonal_raster(values: Raster, zones: Raster, statistic: str = "mean") -> Raster:
    """One statistic given back to every cell of its zone: aggregated first, so no zone is sorted."""
    if statistic not in STATISTICS:
        raise OperationError("Unknown statistic.", code="invalid_statistics", details={"statistics": statistic})
    table, inside = _zoned(values, zones, None)
    stats = table.filter(inside).groupBy("zone").agg(_aggregate(statistic, values.dtype))
    joined = table.drop("value", "valid").join(stats, "zone", "left")
    d = D.of_storage(stats.schema[statistic].dataType.simpleString())
    return values.with_table(joined.select("row", "col", F.col(statistic).alias("value"), F.col(statistic).isNotNull().alias("valid")), d)


def to_records(table: DataFrame) -> list[dict]:
    return [r.asDict() for r in table.orderBy("zone").collect()]


def to_dict(table: DataFrame) -> dict[str, list]:
    rows = to_records(table)
    return {c: [r[c] for r in rows] for c in table.columns}


def to_json(table: DataFrame) -> str:
    return json.dumps(to_dict(table), default=float)


def json_lines(table: DataFrame) -> DataFrame:
    return table.select(F.to_json(F.struct("*")).alias("json"))


def write_csv(table: DataFrame, path: str) -> None:
    table.coalesce(1).sortWithinPartitions("zone").write.mode("errorifexists").csv(path, header=True)


