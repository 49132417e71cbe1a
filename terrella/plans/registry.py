"""The closed list of operators, by id: function, category, parameters and what it computes."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from terrella.errors import OperationError
from terrella.operators import coordinates, distance, focal, local, reductions, regions, resample, temporal, terrain, zonal

CATEGORIES = ("coordinate", "local", "classification", "normalization", "focal", "terrain", "alignment", "global", "zonal", "region", "distance", "temporal")


@dataclass(frozen=True)
class Operation:
    id: str
    category: str
    function: Callable
    summary: str
    parameters: tuple[tuple[str, str], ...]
    execution_modes: tuple[str, ...] = ("lazy", "distributed")

    def to_dict(self) -> dict:
        return {"id": self.id, "category": self.category, "summary": self.summary, "parameters": dict(self.parameters), "execution_modes": list(self.execution_modes)}


_FAMILIES = (
    ("local", local, "local", "add subtract multiply divide floor_divide remainder power negative positive absolute minimum maximum square sum_layers mean_layers min_layers max_layers less less_equal greater greater_equal equal not_equal isclose logical_not logical_and logical_or logical_xor where coalesce is_valid is_invalid set_invalid fill_invalid clip cast sqrt exp log log10 sin cos tan arcsin arccos arctan arctan2 degrees radians hypot floor ceil trunc"),
    ("local", local, "classification", "reclassify_values reclassify_ranges digitize one_hot"),
    ("local", local, "normalization", "normalize_minmax standardize"),
    ("coordinate", coordinates, "coordinate", "row_indices column_indices projected_x projected_y longitude latitude"),
    ("focal", focal, "focal", "dilate erode opening closing majority convolve"),
    ("terrain", terrain, "terrain", "slope aspect hillshade gradient"),
    ("alignment", resample, "alignment", "align resample_to"),
    ("global", reductions, "global", "statistics histogram percentile unique_counts"),
    ("region", regions, "region", "label_regions region_sizes filter_regions_by_size find_borders"),
)


def _operation(id_: str, category: str, f: Callable, modes: tuple[str, ...] = ("lazy", "distributed")) -> Operation:
    signature = inspect.signature(f)
    return Operation(id_, category, f, (inspect.getdoc(f) or f.__name__.replace("_", " ").capitalize() + ".").split("\n")[0], tuple((n, "required" if p.default is p.empty else repr(p.default)) for n, p in signature.parameters.items()), modes)


def _all() -> dict[str, Operation]:
    out = {}
    for prefix, module, category, names in _FAMILIES:
        for n in names.split():
            out[f"{prefix}.{n}"] = _operation(f"{prefix}.{n}", category, getattr(module, n))
    out["local.round"] = _operation("local.round", "local", local.round_half_even)
    for n in ("sum", "mean", "min", "max", "range", "std", "count", "median"):
        out[f"focal.{n}"] = _operation(f"focal.{n}", "focal", getattr(focal, f"focal_{n}"))
    for n in ("mean", "min", "max", "std", "sum", "count"):
        out[f"temporal.{n}"] = _operation(f"temporal.{n}", "temporal", getattr(temporal, f"temporal_{n}"), ("lazy", "distributed", "streaming"))
    out["zonal.stats"] = _operation("zonal.stats", "zonal", zonal.zonal_stats)
    out["zonal.raster"] = _operation("zonal.raster", "zonal", zonal.zonal_raster)
    out["distance.to"] = _operation("distance.to", "distance", distance.distance_to)
    out["distance.signed"] = _operation("distance.signed", "distance", distance.signed_distance)
    return dict(sorted(out.items()))


OPERATIONS = _all()


def list_operations(*, category: str | None = None, execution_mode: str | None = None) -> list[Operation]:
    if category is not None and category not in CATEGORIES:
        raise OperationError("Unknown category.", code="unknown_category", details={"category": category})
    return [o for o in OPERATIONS.values() if (category is None or o.category == category) and (execution_mode is None or execution_mode in o.execution_modes)]


def describe_operation(operation_id: str) -> Operation:
    if operation_id not in OPERATIONS:
        raise OperationError("Unknown operation.", code="unknown_operation", details={"operation_id": operation_id})
    return OPERATIONS[operation_id]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(o.id, o.category, o.summary, [p for p, _ in o.parameters], list(o.execution_modes)) for o in OPERATIONS.values()], "id string, category string, summary string, parameters array<string>, execution_modes array<string>")
