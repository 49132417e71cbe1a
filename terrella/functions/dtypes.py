"""Logical cell types: how they are stored in Spark and which type an operator gives.

Spark has no unsigned types, so uint8, uint16 and uint32 live in the next wider signed type and uint64 in DECIMAL(20,0);
the logical type is kept beside the column and bounds are checked against it.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.errors import DTypeError, OperationError

#: Storage of each logical type. Fixed values.
STORAGE = {
    "bool": "boolean", "int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float32": "float", "float64": "double",
}
_OF_STORAGE = {"boolean": "bool", "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64", "float": "float32", "double": "float64", "decimal(20,0)": "uint64"}
INTEGERS = tuple(n for n in STORAGE if "int" in n)
#: Candidates for a promoted result, narrowest first.
PROMOTION = ("uint8", "int8", "uint16", "int16", "uint32", "int32", "uint64", "int64")


def logical(name) -> str:
    n = np.dtype(name).name if not isinstance(name, str) or name not in STORAGE else name
    if n not in STORAGE:
        raise DTypeError(f"dtype {n} is not supported.", code="unsupported_dtype", details={"dtype": n})
    return n


def of_storage(kind: str) -> str:
    if kind not in _OF_STORAGE:
        raise DTypeError(f"Spark type {kind} has no cell type.", code="unsupported_dtype", details={"type": kind})
    return _OF_STORAGE[kind]


def is_float(d: str) -> bool:
    return d.startswith("float")


def is_int(d: str) -> bool:
    return "int" in d


def bounds(d: str) -> tuple[int, int]:
    if d == "bool":
        return 0, 1
    i = np.iinfo(d)
    return int(i.min), int(i.max)


def whole(n: int) -> Column:
    """An integer literal of any size."""
    return F.lit(n) if -(2**63) <= n < 2**63 else F.lit(str(n)).cast("decimal(38,0)")


def stored(c: Column, d: str) -> Column:
    return c.cast(STORAGE[d])


def literal(value, d: str) -> Column:
    if is_float(d):
        return F.lit(float(value)).cast(STORAGE[d])
    return F.lit(bool(value)) if d == "bool" else whole(int(value)).cast(STORAGE[d])


def exactly_represents(value, d: str) -> bool:
    if isinstance(value, (bool, np.bool_)):
        return True
    if is_int(d):
        return float(value).is_integer() and bounds(d)[0] <= int(value) <= bounds(d)[1] if not isinstance(value, (int, np.integer)) else bounds(d)[0] <= int(value) <= bounds(d)[1]
    if d == "bool":
        return value in (0, 1)
    return not math.isfinite(value) or float(np.dtype(d).type(value)) == float(value)


def promoted(*operands) -> str:
    """NumPy's result type of logical types and Python scalars."""
    try:
        return logical(np.result_type(*(np.dtype(o) if isinstance(o, str) else o for o in operands)))
    except (TypeError, OverflowError) as e:
        raise DTypeError("No common dtype.", code="dtype_inference_failed", details={"operands": [str(o) for o in operands]}) from e


def selection(*operands) -> str:
    """The type of operators that pick values: Python integers count with their least exact type."""
    inputs = []
    for o in operands:
        if isinstance(o, str):
            inputs.append(np.dtype(o))
        elif isinstance(o, (bool, np.bool_)):
            inputs.append(np.dtype(bool))
        elif isinstance(o, (int, np.integer)):
            inputs.append(np.min_scalar_type(int(o)))
        elif math.isfinite(o) and abs(o) > float(np.finfo(np.float32).max):
            inputs.append(np.dtype(np.float64))
        else:
            inputs.append(float(o))
    found = np.result_type(*inputs)
    if found.kind == "f" and all(isinstance(i, np.dtype) and i.kind in "biu" for i in inputs):
        raise DTypeError("No integer dtype can represent every possible output value.", code="no_exact_promotion")
    return logical(found)


def result(operation: str, *operands, overflow: str = "raise", scalar_left: bool = False) -> str:
    """The type of an arithmetic operator over logical types and scalars."""
    if overflow not in ("raise", "wrap", "promote"):
        raise OperationError("overflow must be 'raise', 'wrap' or 'promote'.", code="invalid_overflow", details={"overflow": overflow})
    found = promoted(*operands)
    if operation in ("divide", "float"):
        return found if is_float(found) else "float64"
    if overflow == "promote" and is_int(found):
        return _promote(operation, operands, scalar_left)
    return found


def _promote(operation: str, operands, scalar_left: bool) -> str:
    ranges = [bounds(o) if isinstance(o, str) else (int(o), int(o)) for o in operands]
    if scalar_left:
        ranges.reverse()
    a0, a1 = ranges[0]
    b0, b1 = ranges[-1]
    if operation == "negative":
        low, high = -a1, -a0
    elif operation == "absolute":
        low, high = 0, max(abs(a0), abs(a1))
    elif operation in ("square", "multiply"):
        products = (a0 * b0, a0 * b1, a1 * b0, a1 * b1) if operation == "multiply" else (a0 * a0, a0 * a1, a1 * a1)
        low, high = min(products), max(products)
    elif operation == "add":
        low, high = a0 + b0, a1 + b1
    elif operation == "subtract":
        low, high = a0 - b1, a1 - b0
    elif operation == "floor_divide":
        most = max(abs(a0), abs(a1))
        low, high = (0, a1) if a0 >= 0 and b0 >= 0 else (-most, most)
    elif operation == "remainder":
        most = max(abs(b0), abs(b1))
        low, high = (0, max(0, most - 1)) if a0 >= 0 and b0 >= 0 else (-most, most)
    else:
        raise DTypeError(f"{operation} cannot be promoted.", code="dtype_inference_failed")
    if operation != "absolute":
        low, high = min(low, *(r[0] for r in ranges)), max(high, *(r[1] for r in ranges))
    for d in PROMOTION:
        if bounds(d)[0] <= low and high <= bounds(d)[1]:
            return d
    raise DTypeError("No integer dtype can represent every possible result.", code="no_exact_promotion", details={"minimum": str(low), "maximum": str(high)})


def normalization(d: str, *scalars) -> str:
    """float32 unless the source or a given statistic needs more."""
    if d == "float64" or (is_int(d) and np.dtype(d).itemsize > 2):
        return "float64"
    return "float64" if any(s is not None and math.isfinite(s) and abs(s) > float(np.finfo(np.float32).max) for s in scalars) else "float32"


def accumulator(d: str, reduction: str) -> str:
    if reduction in ("min", "max"):
        return d
    if reduction == "count":
        return "int64"
    if reduction == "sum":
        return "uint64" if d.startswith("uint") else "int64" if is_int(d) or d == "bool" else d
    if reduction in ("mean", "std"):
        return "float32" if d == "float32" else "float64"
    if reduction in ("range", "median"):
        return "float64" if d == "float64" or (is_int(d) and np.dtype(d).itemsize >= 4) else "float32"
    raise DTypeError(f"unknown reduction {reduction}.", code="unknown_accumulator_operation")


def fitted(c: Column, d: str, overflow: str) -> Column:
    """An exact integer expression of any width brought to the logical type by policy; NULL stays NULL."""
    low, high = bounds(d)
    if overflow == "wrap":
        size = high - low + 1
        wide = c.cast("decimal(38,0)")
        r = (wide - whole(low)) % whole(size)
        return (F.when(r < 0, r + whole(size)).otherwise(r) + whole(low)).cast(STORAGE[d])
    outside = (c < whole(low)) | (c > whole(high))
    return F.when(outside, F.raise_error(F.lit(f"overflow: a result does not fit {d}"))).otherwise(c).cast(STORAGE[d])
