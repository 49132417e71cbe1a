"""Cell-wise operators: arithmetic, predicates, Boolean algebra, selection, casts, classification, mathematics.

Each builds two columns on the operands' common table, a value and a validity. Validity is strict: a result is valid
where all operands are; numeric errors (a non-finite value, a zero divisor) invalidate, are kept or raise by policy.
Integer arithmetic is computed exactly and brought to its type by the overflow policy; only valid cells are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrella.errors import DTypeError, OperationError
from terrella.functions import dtypes as D
from terrella.functions import units as U
from terrella.raster import Raster, aligned



class _Invalid:
    """Branch of `where` without valid cells."""

    def __repr__(self):
        return "invalid"


invalid = _Invalid()


def _scalar(x, argument: str = "scalar"):
    if isinstance(x, np.generic):
        x = x.item()
    if isinstance(x, bool) or isinstance(x, (int, float)):
        return x
    raise OperationError(f"{argument} must be a raster or a real number.", code="invalid_scalar", details={"type": type(x).__name__})


def _operands(*xs) -> tuple[Raster, list]:
    """The first raster after alignment and all operands in order."""
    rasters = [x for x in xs if isinstance(x, Raster)]
    if not rasters:
        raise OperationError("At least one operand must be a raster.", code="no_raster_operand")
    moved = iter(aligned(*rasters))
    out = [next(moved) if isinstance(x, Raster) else _scalar(x) for x in xs]
    return next(x for x in out if isinstance(x, Raster)), out


def _v(x, d: str) -> Column:
    """An operand as the working type, NULL where invalid."""
    return D.stored(x.v, d) if isinstance(x, Raster) else D.literal(x, d)


def _valid(*xs) -> Column:
    out = None
    for x in xs:
        if isinstance(x, Raster):
            out = F.col(x.valid) if out is None else out & F.col(x.valid)
    return out


def _policy(numeric_errors: str) -> None:
    if numeric_errors not in ("invalid", "keep", "raise"):
        raise OperationError("numeric_errors must be 'invalid', 'keep' or 'raise'.", code="invalid_numeric_errors", details={"numeric_errors": numeric_errors})


def _domain(first: Raster, operation: str, value: Column, valid: Column, dtype: str, numeric_errors: str, errors: Column | None = None, **meta) -> Raster:
    """Apply the numeric policy; `value` is NULL only where invalid or where `errors` holds."""
    _policy(numeric_errors)

    def judged(name: str) -> Column:
        c = F.col(name)
        bad = (F.isnan(c) | (F.abs(c) == F.lit(math.inf))) if D.is_float(dtype) else F.lit(False)
        if errors is not None:
            bad = bad | F.coalesce(errors, F.lit(False))
        if numeric_errors == "keep":
            return valid
        if numeric_errors == "raise":
            return F.when(valid & F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"numeric error in {operation} at a valid cell"))).otherwise(valid).cast("boolean")
        return valid & ~F.coalesce(bad, F.lit(True))

    return first.derive(value, judged, dtype, **meta)


def _units_of(x) -> str | None:
    return x.units if isinstance(x, Raster) else None


def _same_units(a, b) -> str | None:
    """Units must match between two rasters; a scalar takes the raster's."""
    if isinstance(a, Raster) and isinstance(b, Raster):
        U.match(a.units, b.units)
    return _units_of(a) or _units_of(b)


def _dtypes(*xs) -> list:
    return [x.dtype if isinstance(x, Raster) else x for x in xs]


def _wide(x) -> Column:
    """An exact integer of any width, NULL where invalid."""
    return x.v.cast("int").cast("decimal(38,0)") if isinstance(x, Raster) and x.dtype == "bool" else x.v.cast("decimal(38,0)") if isinstance(x, Raster) else D.whole(int(x)).cast("decimal(38,0)")


def _exact(x, d: str, wide: bool) -> Column:
    """Long arithmetic where results of type d and of one operation on it stay in 64 bits, decimals otherwise."""
    if wide:
        return _wide(x)
    return (x.v.cast("int").cast("long") if x.dtype == "bool" else x.v.cast("long")) if isinstance(x, Raster) else F.lit(int(x)).cast("long")


def _arithmetic(name: str, a, b, units: str | None, overflow: str, numeric_errors: str, integer: Callable, real: Callable) -> Raster:
    d = D.result(name, *_dtypes(a, b), overflow=overflow, scalar_left=not isinstance(a, Raster))
    first, (a, b) = _operands(a, b)
    if D.is_int(d):
        _require_scalars(d, a, b)
        wide = np.dtype(d).itemsize > 4 or name == "power" or any(np.dtype(x.dtype).itemsize > 4 for x in (a, b) if isinstance(x, Raster))
        value, errors = integer(_exact(a, d, wide), _exact(b, d, wide), a, b)
        value = D.fitted(value, d, "raise" if overflow == "promote" else overflow)
    elif d == "bool":
        x, y = _v(a, d), _v(b, d)
        value, errors = {"add": x | y, "multiply": x & y}.get(name), None
        if value is None:
            raise DTypeError(f"{name} is not defined on Boolean rasters.", code="boolean_arithmetic")
    else:
        value, errors = real(_v(a, d), _v(b, d), a, b)
    return _domain(first, name, value, _valid(a, b), d, numeric_errors, errors, units=units)


def _require_scalars(d: str, *xs) -> None:
    low, high = D.bounds(d)
    for x in xs:
        if not isinstance(x, Raster) and not low <= int(x) <= high:
            raise DTypeError(f"The scalar does not fit {d}.", code="overflow", details={"scalar": x})


def add(a, b, *, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    return _arithmetic("add", a, b, _same_units(a, b), overflow, numeric_errors, lambda x, y, *_: (x + y, None), lambda x, y, *_: (x + y, None))


def subtract(a, b, *, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    return _arithmetic("subtract", a, b, _same_units(a, b), overflow, numeric_errors, lambda x, y, *_: (x - y, None), lambda x, y, *_: (x - y, None))


def multiply(a, b, *, output_units: str | None = None, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    units = U.multiply(_units_of(a), _units_of(b), output_units)
    return _arithmetic("multiply", a, b, units, overflow, numeric_errors, lambda x, y, *_: (x * y, None), lambda x, y, *_: (x * y, None))


def ieee_divide(x: Column, y: Column) -> Column:
    """Division with IEEE results for a zero divisor."""
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when((y == 0) & ((x == 0) | F.isnan(x)), nan).when((y == 0) & (x > 0), inf).when(y == 0, -inf).otherwise(F.try_divide(x, y))


def divide(a, b, *, output_units: str | None = None, numeric_errors: str = "invalid") -> Raster:
    units = U.multiply(_units_of(a), _units_of(b), output_units)
    d = D.result("divide", *_dtypes(a, b))
    first, (a, b) = _operands(a, b)
    x, y = _v(a, d).cast("double"), _v(b, d).cast("double")
    return _domain(first, "divide", ieee_divide(x, y), _valid(a, b), d, numeric_errors, y == 0, units=units)


def _floor_parts(x: Column, y: Column) -> tuple[Column, Column, Column]:
    safe = F.when(y == 0, F.lit(1)).otherwise(y)
    r = x % safe
    return safe, r, (r != 0) & ((r < 0) != (safe < 0))


def floor_divide(a, b, *, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    def integer(x, y, *_):
        safe, r, adjust = _floor_parts(x, y)
        return F.when(y == 0, F.lit(0)).otherwise(F.call_function("div", x.cast("decimal(38,0)") - r.cast("decimal(38,0)"), safe.cast("decimal(38,0)")) - F.when(adjust, F.lit(1)).otherwise(F.lit(0))), y == 0

    def real(x, y, *_):
        return _floor(ieee_divide(x.cast("double"), y.cast("double"))), y == 0

    return _arithmetic("floor_divide", a, b, None if isinstance(a, Raster) and isinstance(b, Raster) and a.units == b.units else _same_units(a, b), overflow, numeric_errors, integer, real)


def remainder(a, b, *, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    def integer(x, y, *_):
        safe, r, adjust = _floor_parts(x, y)
        return F.when(y == 0, F.lit(0)).when(adjust, r + safe).otherwise(r), y == 0

    def real(x, y, *_):
        # The truncated remainder is exact; it takes the divisor's sign by one addition.
        x, y = x.cast("double"), y.cast("double")
        r = x % F.when(y == 0, F.lit(float("nan"))).otherwise(y)
        return F.when(y == 0, F.lit(float("nan"))).when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r), y == 0

    return _arithmetic("remainder", a, b, _same_units(a, b), overflow, numeric_errors, integer, real)


def _wrapped_power(x: Column, n: Column, size: int) -> Column:
    """x ** n modulo `size`, between -size / 2 and size / 2: squares of x are multiplied for each bit that n has."""
    whole, half = D.whole(size).cast("decimal(38,0)"), D.whole(size // 2).cast("decimal(38,0)")

    def reduced(v: Column) -> Column:
        r = (v % whole).cast("decimal(38,0)")
        return F.when(r >= half, r - whole).when(r < -half, r + whole).otherwise(r).cast("decimal(38,0)")

    def step(state: Column, bit: Column) -> Column:
        used = F.call_function("shiftright", n, bit) % 2 == 1
        return F.struct(F.when(used, reduced(state["out"] * state["square"])).otherwise(state["out"]).alias("out"), reduced(state["square"] * state["square"]).alias("square"))

    bits = F.sequence(F.lit(0), F.when(n > 0, F.length(F.bin(n)) - 1).otherwise(F.lit(0)).cast("int"))
    return F.aggregate(bits, F.struct(F.lit(1).cast("decimal(38,0)").alias("out"), reduced(x).alias("square")), step, lambda state: state["out"])


def power(base, exponent, *, output_units: str | None = None, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    units = U.power(_units_of(base), _units_of(exponent), None if isinstance(exponent, Raster) else exponent, output_units, base_is_raster=isinstance(base, Raster))
    d = D.result("power", *_dtypes(base, exponent), overflow="raise" if overflow == "promote" else overflow)
    if not D.is_int(d):
        return _arithmetic("power", base, exponent, units, overflow, numeric_errors, None, lambda x, y, *_: (F.pow(x.cast("double"), y.cast("double")), None))
    if overflow == "promote":
        raise DTypeError("power cannot be promoted.", code="dtype_inference_failed")
    first, (a, b) = _operands(base, exponent)
    low, high = D.bounds(d)
    size = high - low + 1
    n = _exact(b, d, False)
    x = _wide(a)
    if overflow == "wrap":
        value = _wrapped_power(x, n, size)
    else:
        steps = F.when(n > 0, F.sequence(F.lit(1), F.least(n, F.lit(64)).cast("int"))).otherwise(F.array().cast("array<int>"))
        limit = D.whole(1 << 65).cast("decimal(38,0)")

        def times(acc, _):
            p = acc.cast("decimal(38,0)") * x
            return F.when(F.abs(acc) > limit, acc).otherwise(p.cast("decimal(38,0)")).cast("decimal(38,0)")

        value = F.when((n > 64) & (F.abs(x) <= 1), F.when((x == -1) & (n % 2 == 1), F.lit(-1)).otherwise(F.abs(x)).cast("decimal(38,0)")).otherwise(F.aggregate(steps, F.lit(1).cast("decimal(38,0)"), times))
    return _domain(first, "power", D.fitted(F.when(n < 0, F.lit(0).cast("decimal(38,0)")).otherwise(value), d, overflow), _valid(a, b), d, numeric_errors, n < 0, units=units)


def _unary_exact(name: str, a: Raster, overflow: str, numeric_errors: str, f: Callable[[Column], Column], units: str | None) -> Raster:
    d = D.result(name, a.dtype, overflow=overflow)
    if d == "bool":
        raise DTypeError(f"{name} is not defined on Boolean rasters.", code="boolean_arithmetic")
    first, (a,) = _operands(a)
    value = D.fitted(f(_exact(a, d, np.dtype(a.dtype).itemsize > 4)), d, "raise" if overflow == "promote" else overflow) if D.is_int(d) else f(_v(a, d))
    return _domain(first, name, value, F.col(a.valid), d, numeric_errors, units=units)


def negative(a: Raster, *, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    return _unary_exact("negative", a, overflow, numeric_errors, lambda x: -x, a.units)


def positive(a: Raster) -> Raster:
    return a


def absolute(a: Raster, *, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    return _unary_exact("absolute", a, overflow, numeric_errors, F.abs, a.units)


def square(a: Raster, *, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    return _unary_exact("square", a, overflow, numeric_errors, lambda x: x * x, None)


def _extreme(name: str, a, b, pick: Callable, numeric_errors: str) -> Raster:
    units = _same_units(a, b)
    d = D.selection(*_dtypes(a, b)) if not all(isinstance(x, Raster) for x in (a, b)) else D.promoted(*_dtypes(a, b))
    first, (a, b) = _operands(a, b)
    x, y = _v(a, d), _v(b, d)
    value = pick(x, y)
    if D.is_float(d):
        value = F.when(F.isnan(x) | F.isnan(y), F.lit(float("nan"))).otherwise(value)
    return _domain(first, name, value, _valid(a, b), d, numeric_errors, units=units)


def minimum(a, b, *, numeric_errors: str = "invalid") -> Raster:
    return _extreme("minimum", a, b, F.least, numeric_errors)


def maximum(a, b, *, numeric_errors: str = "invalid") -> Raster:
    return _extreme("maximum", a, b, F.greatest, numeric_errors)


def _layers(layers: tuple) -> tuple:
    if not layers:
        raise OperationError("At least one layer is needed.", code="no_layers")
    return layers


def sum_layers(*layers, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    out = _layers(layers)[0]
    for x in layers[1:]:
        out = add(out, x, overflow=overflow, numeric_errors=numeric_errors)
    return out


def mean_layers(*layers, overflow: str = "raise", numeric_errors: str = "invalid") -> Raster:
    return divide(sum_layers(*layers, overflow=overflow, numeric_errors=numeric_errors), len(layers), numeric_errors=numeric_errors)


def min_layers(*layers, numeric_errors: str = "invalid") -> Raster:
    out = _layers(layers)[0]
    for x in layers[1:]:
        out = minimum(out, x, numeric_errors=numeric_errors)
    return out


def max_layers(*layers, numeric_errors: str = "invalid") -> Raster:
    out = _layers(layers)[0]
    for x in layers[1:]:
        out = maximum(out, x, numeric_errors=numeric_errors)
    return out


# Predicates


def _compared(a, b, test: Callable[[Column, Column], Column], on_nan: bool) -> Raster:
    """A comparison is valid wherever its operands are; with NaN it is false (true for 'not equal')."""
    _same_units(a, b)
    d = D.promoted(*_dtypes(a, b))
    first, (a, b) = _operands(a, b)
    if D.is_int(d) or (d == "float64" and all(D.is_int(x.dtype) if isinstance(x, Raster) else isinstance(x, int) for x in (a, b))):
        value = test(_wide(a), _wide(b))  # exact also where no common type is
    else:
        x, y = _v(a, d), _v(b, d)
        value = test(x, y)
        if D.is_float(d):
            value = F.when(F.isnan(x) | F.isnan(y), F.lit(on_nan)).otherwise(value)
    return first.derive(value, _valid(a, b), "bool")


def less(a, b) -> Raster:
    return _compared(a, b, lambda x, y: x < y, False)


def less_equal(a, b) -> Raster:
    return _compared(a, b, lambda x, y: x <= y, False)


def greater(a, b) -> Raster:
    return _compared(a, b, lambda x, y: x > y, False)


def greater_equal(a, b) -> Raster:
    return _compared(a, b, lambda x, y: x >= y, False)


def equal(a, b) -> Raster:
    return _compared(a, b, lambda x, y: x == y, False)


def not_equal(a, b) -> Raster:
    return _compared(a, b, lambda x, y: x != y, True)


def close(x: Column, y: Column, rtol: float, atol: float, equal_nan: bool) -> Column:
    finite = ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) != math.inf) & (F.abs(y) != math.inf)
    near = F.when(finite, F.abs(x - y) <= F.lit(atol) + F.lit(rtol) * F.abs(y)).otherwise(~F.isnan(x) & ~F.isnan(y) & (x == y))
    return (near | (F.isnan(x) & F.isnan(y))) if equal_nan else near


def isclose(a, b, *, rtol: float = 1e-05, atol: float = 1e-08, equal_nan: bool = False) -> Raster:
    first, (a, b) = _operands(a, b)
    x, y = (o.v.cast("double") if isinstance(o, Raster) else F.lit(float(o)) for o in (a, b))
    return first.derive(close(x, y, rtol, atol, equal_nan), _valid(a, b), "bool")


def _booleans(*xs) -> None:
    for x in xs:
        if not isinstance(x, Raster) or x.dtype != "bool":
            raise DTypeError("Boolean rasters are needed.", code="boolean_operand_required", details={"dtype": getattr(x, "dtype", type(x).__name__)})


def logical_not(a: Raster) -> Raster:
    _booleans(a)
    return a.derive(~a.v, F.col(a.valid), "bool")


def _logical(a: Raster, b: Raster, f: Callable) -> Raster:
    _booleans(a, b)
    first, (a, b) = _operands(a, b)
    both = _valid(a, b)
    return first.derive(F.when(both, f(F.col(a.value), F.col(b.value))), both, "bool")


def logical_and(a: Raster, b: Raster) -> Raster:
    return _logical(a, b, lambda x, y: x & y)


def logical_or(a: Raster, b: Raster) -> Raster:
    return _logical(a, b, lambda x, y: x | y)


def logical_xor(a: Raster, b: Raster) -> Raster:
    return _logical(a, b, lambda x, y: x != y)


# Selection and validity


def where(condition: Raster, x, y) -> Raster:
    """The chosen branch counts, the other one does not; `invalid` is a branch without valid cells."""
    _booleans(condition)
    branches = [b for b in (x, y) if b is not invalid]
    if not branches:
        return condition.derive(F.lit(False), F.lit(False), "bool")
    units = None
    rasters = [b for b in branches if isinstance(b, Raster)]
    if len(rasters) == 2:
        U.match(rasters[0].units, rasters[1].units)
    if rasters:
        units = rasters[0].units
    d = D.selection(*_dtypes(*branches))
    first, moved = _operands(condition, *branches)
    condition, moved = moved[0], moved[1:]
    it = iter(moved)
    x, y = (None if b is invalid else next(it) for b in (x, y))

    def part(b) -> tuple[Column, Column]:
        if b is None:
            return D.literal(0, d), F.lit(False)
        return _v(b, d), F.col(b.valid) if isinstance(b, Raster) else F.lit(True)

    (xv, xm), (yv, ym) = part(x), part(y)
    c = F.col(condition.value)
    return first.derive(F.when(c, xv).otherwise(yv), F.col(condition.valid) & ((c & xm) | (~c & ym)), d, units=units)


def coalesce(*operands) -> Raster:
    """The first valid operand; a scalar ends the list."""
    used = []
    for o in operands:
        used.append(o)
        if not isinstance(o, Raster):
            break
    d = D.selection(*_dtypes(*used))
    for o in used:
        if isinstance(o, Raster):
            U.match(used[0].units if isinstance(used[0], Raster) else o.units, o.units)
    first, used = _operands(*used)
    values = [_v(o, d) for o in used]
    valid = F.lit(False)
    for o in used:
        valid = valid | (F.col(o.valid) if isinstance(o, Raster) else F.lit(True))
    return first.derive(F.coalesce(*values), valid, d, units=first.units)


def is_valid(a: Raster) -> Raster:
    return a.derive(F.col(a.valid), F.lit(True), "bool")


def is_invalid(a: Raster) -> Raster:
    return a.derive(~F.col(a.valid), F.lit(True), "bool")


def set_invalid(raster: Raster, mask: Raster) -> Raster:
    _booleans(mask)
    a, m = aligned(raster, mask)
    return a.derive(F.col(a.value), F.col(a.valid) & ~F.coalesce(m.v, F.lit(False)), a.dtype, units=a.units, name=a.name)


def fill_invalid(raster: Raster, value) -> Raster:
    if not D.exactly_represents(value, raster.dtype):
        raise DTypeError("The fill value is not exact in the raster's dtype.", code="inexact_fill", details={"value": value, "dtype": raster.dtype})
    return raster.derive(F.coalesce(raster.v, D.literal(value, raster.dtype)), F.lit(True), raster.dtype, units=raster.units, name=raster.name)


# Casts, classification, normalisation


def clip(raster: Raster, *, lower=None, upper=None) -> Raster:
    if lower is None and upper is None:
        return raster
    if lower is not None and upper is not None and lower > upper:
        raise OperationError("lower must not exceed upper.", code="invalid_clip_bounds")
    out = raster
    if lower is not None:
        out = maximum(out, lower, numeric_errors="keep")
    return out if upper is None else minimum(out, upper, numeric_errors="keep")


def cast(raster: Raster, dtype, *, casting: str = "safe", overflow: str = "raise") -> Raster:
    d = D.logical(dtype)
    if casting not in ("safe", "same_kind", "unsafe") or overflow not in ("raise", "wrap"):
        raise OperationError("Unknown cast policy.", code="invalid_cast_policy", details={"casting": casting, "overflow": overflow})
    if not np.can_cast(np.dtype(raster.dtype), np.dtype(d), casting=casting):
        raise DTypeError(f"{raster.dtype} does not cast to {d} under '{casting}'.", code="cast_not_allowed", details={"from": raster.dtype, "to": d})
    v = raster.v
    if D.is_int(d):
        if D.is_float(raster.dtype):
            whole = F.when(F.isnan(v) | (F.abs(v) == math.inf), F.raise_error(F.lit("a non-finite value has no integer"))).otherwise(_truncated(v))
            value = D.fitted(whole, d, overflow)
        else:
            value = D.fitted(_wide(raster), d, overflow)
    elif d == "bool":
        value = v.cast("boolean") if raster.dtype != "bool" else v
    else:
        value = (v.cast("int") if raster.dtype == "bool" else v).cast(D.STORAGE[d])
    return raster.derive(value, F.col(raster.valid), d, units=raster.units, name=raster.name)


def _truncated(v: Column) -> Column:
    t = F.when(v >= 0, F.floor(F.least(v.cast("double"), F.lit(9.2e18)))).otherwise(F.ceil(F.greatest(v.cast("double"), F.lit(-9.2e18))))
    return F.when(F.abs(v) < 9.2e18, t.cast("decimal(38,0)")).otherwise(v.cast("double").cast("decimal(38,0)"))


def _default(raster: Raster, outputs: list, default) -> tuple[str, str | None]:
    if isinstance(default, str):
        if default not in ("invalidate", "preserve"):
            raise OperationError("default must be 'invalidate', 'preserve' or a number.", code="invalid_default", details={"default": default})
        inputs = [*outputs, raster.dtype] if default == "preserve" else outputs
    else:
        inputs = [*outputs, _scalar(default, "default")]
    return D.selection(*(inputs or [raster.dtype]))


def _classified(raster: Raster, tests: list[tuple[Column, object]], default) -> Raster:
    """tests in order of precedence, each with its output."""
    d = _default(raster, [_scalar(o) for _, o in tests], default)
    value, hit = None, F.lit(False)
    for condition, output in tests:
        value = F.when(condition, D.literal(output, d)) if value is None else value.when(condition, D.literal(output, d))
        hit = hit | condition
    other = D.stored(raster.v, d) if default == "preserve" else F.lit(None).cast(D.STORAGE[d]) if default == "invalidate" else D.literal(default, d)
    value = other if value is None else value.otherwise(other)
    valid = F.col(raster.valid) & F.coalesce(hit, F.lit(False)) if default == "invalidate" else F.col(raster.valid)
    return raster.derive(value, valid, d, units=raster.units)


def reclassify_values(raster: Raster, mapping: Mapping, *, default="invalidate") -> Raster:
    """Exact matches; of keys that match one value the later wins."""
    v = raster.v
    tests = []
    for key, output in reversed(list(mapping.items())):
        if D.exactly_represents(key, raster.dtype):
            test = v == D.literal(key, raster.dtype)
            tests.append((F.coalesce(test & ~F.isnan(v) if D.is_float(raster.dtype) else test, F.lit(False)), output))
        else:
            tests.append((F.lit(False), output))
    return _classified(raster, tests, default)


def reclassify_ranges(raster: Raster, ranges: Sequence[tuple], *, default="invalidate") -> Raster:
    """Half-open ranges (low, high, output); of overlapping ones the later wins."""
    v = raster.v.cast("double") if D.is_float(raster.dtype) else raster.v.cast("decimal(38,6)") if raster.dtype != "bool" else raster.v.cast("int")
    tests = []
    for low, high, output in reversed(list(ranges)):
        if not low < high:
            raise OperationError("A range needs low < high.", code="invalid_range", details={"low": low, "high": high})
        test = (v >= F.lit(low)) & (v < F.lit(high))
        tests.append((F.coalesce(test & ~F.isnan(v) if D.is_float(raster.dtype) else test, F.lit(False)), output))
    return _classified(raster, tests, default)


def digitize(raster: Raster, bins: Sequence, *, right: bool = False) -> Raster:
    """Number of edges at or below (right: below) each value; NaN is past the last. Decreasing bins count from the other end."""
    edges = [float(b) for b in bins]
    if not edges or any(a == b for a, b in zip(edges, edges[1:], strict=False)) or edges not in (sorted(edges), sorted(edges, reverse=True)):
        raise OperationError("bins must be strictly monotonic.", code="invalid_bins")
    v = raster.v.cast("int").cast("double") if raster.dtype == "bool" else raster.v.cast("double")
    falling = len(edges) > 1 and edges[0] > edges[1]
    array = F.array(*(F.lit(e) for e in edges))
    below = (lambda b: b < v) if right != falling else (lambda b: b <= v)
    n = F.size(F.filter(array, below)).cast("long")
    return raster.derive(F.when(F.col(raster.valid), F.lit(len(edges)) - n if falling else n), F.col(raster.valid), "int64")


def one_hot(raster: Raster, classes: Sequence) -> list[Raster]:
    out, at = [], raster
    for c in classes:
        test = raster.v == D.literal(c, raster.dtype) if D.exactly_represents(c, raster.dtype) else F.lit(False)
        at = Raster(raster.root, raster.grid, raster.dtype, raster.value, raster.valid, raster.units, raster.name, at.steps).derive(test, F.col(raster.valid), "bool")
        out.append(at)
    return [o._replaced(steps=at.steps) for o in out]


def _statistics(raster: Raster, *columns: Column) -> tuple:
    return tuple(raster.df.agg(*columns).first())


def _normalised(raster: Raster, low, width, d: str) -> Raster:
    if not width or not math.isfinite(width):
        return raster.derive(F.lit(0.0), F.lit(False), d)
    x = raster.v.cast("int").cast("double") if raster.dtype == "bool" else raster.v.cast("double")
    return _domain(raster, "normalize", (x - F.lit(float(low))) / F.lit(float(width)), F.col(raster.valid), d, "invalid")


def normalize_minmax(raster: Raster, *, minimum=None, maximum=None) -> Raster:
    """(x - minimum) / (maximum - minimum), of the valid cells where not given; a constant raster has no valid result."""
    d = D.normalization(raster.dtype, minimum, maximum)
    if minimum is None or maximum is None:
        v = raster.v.cast("int") if raster.dtype == "bool" else raster.v
        low, high = _statistics(raster, F.min(v), F.max(v))
        minimum, maximum = low if minimum is None else minimum, high if maximum is None else maximum
    if minimum is None or maximum is None:
        return _normalised(raster, 0, 0, d)
    return _normalised(raster, minimum, float(maximum) - float(minimum), d)


def standardize(raster: Raster, *, mean=None, std=None, ddof: int = 0) -> Raster:
    """(x - mean) / std, of the valid cells where not given; a standard deviation of zero has no valid result."""
    d = D.normalization(raster.dtype, mean, std)
    if mean is None or std is None:
        v = (raster.v.cast("int") if raster.dtype == "bool" else raster.v).cast("double")
        n, m, p = _statistics(raster, F.count(v), F.avg(v), F.var_pop(v))
        mean = m if mean is None else mean
        if std is None:
            std = math.sqrt(p * n / (n - ddof)) if n > ddof and p is not None else 0
    return _normalised(raster, mean or 0, std or 0, d)


# Mathematics


def _math(name: str, a: Raster, f: Callable[[Column], Column], numeric_errors: str, units: str | None = None) -> Raster:
    d = D.result("float", a.dtype)
    x = (a.v.cast("int") if a.dtype == "bool" else a.v).cast("double")
    return _domain(a, name, f(x), F.col(a.valid), d, numeric_errors, units=units)


def _ln(x: Column) -> Column:
    return F.when(x == 0, F.lit(-math.inf)).when(x < 0, F.lit(math.nan)).otherwise(F.ln(x))


def sqrt(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("sqrt", a, F.sqrt, numeric_errors)


def exp(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("exp", a, F.exp, numeric_errors)


def log(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("log", a, _ln, numeric_errors)


def log10(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("log10", a, lambda x: F.when(x <= 0, _ln(x)).otherwise(F.log10(x)), numeric_errors)


def _trig(name: str, a: Raster, f: Callable, numeric_errors: str) -> Raster:
    degrees_ = U.angle(a.units) == "degrees"
    return _math(name, a, lambda x: f(F.radians(x) if degrees_ else x), numeric_errors)


def sin(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _trig("sin", a, F.sin, numeric_errors)


def cos(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _trig("cos", a, F.cos, numeric_errors)


def tan(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _trig("tan", a, F.tan, numeric_errors)


def arcsin(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("arcsin", a, F.asin, numeric_errors, "radians")


def arccos(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("arccos", a, F.acos, numeric_errors, "radians")


def arctan(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("arctan", a, F.atan, numeric_errors, "radians")


def _pair(name: str, a: Raster, b: Raster, f: Callable, numeric_errors: str, units: str | None) -> Raster:
    if not isinstance(a, Raster) or not isinstance(b, Raster):
        raise OperationError(f"{name} takes two rasters.", code="raster_operands_required")
    d = D.result("float", a.dtype, b.dtype)
    first, (a, b) = _operands(a, b)
    return _domain(first, name, f(_v(a, d).cast("double"), _v(b, d).cast("double")), _valid(a, b), d, numeric_errors, units=units)


def arctan2(a: Raster, b: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _pair("arctan2", a, b, F.atan2, numeric_errors, "radians")


def hypot(a: Raster, b: Raster, *, numeric_errors: str = "invalid") -> Raster:
    U.match(a.units, b.units)
    return _pair("hypot", a, b, F.hypot, numeric_errors, None)


def degrees(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("degrees", a, F.degrees, numeric_errors, "degrees")


def radians(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("radians", a, F.radians, numeric_errors, "radians")


def round_half_even(a: Raster, ndigits: int = 0, *, numeric_errors: str = "invalid") -> Raster:
    f = 10.0**ndigits
    return _math("round", a, F.rint if ndigits == 0 else lambda x: F.rint(x * F.lit(f)) * F.lit(1 / f), numeric_errors, a.units)


def _floor(x: Column) -> Column:
    """Floor in double: rint never leaves the type, so values beyond 64-bit integers stay."""
    r = F.rint(x)
    return F.when(r > x, r - 1).otherwise(r)


def _ceil(x: Column) -> Column:
    r = F.rint(x)
    return F.when(r < x, r + 1).otherwise(r)


def floor(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("floor", a, _floor, numeric_errors, a.units)


def ceil(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("ceil", a, _ceil, numeric_errors, a.units)


def trunc(a: Raster, *, numeric_errors: str = "invalid") -> Raster:
    return _math("trunc", a, lambda x: F.when(x >= 0, _floor(x)).otherwise(_ceil(x)), numeric_errors, a.units)


# Operator overloads


def _install() -> None:
    def swapped(f):
        return lambda self, other: f(other, self)

    for name, f in {"add": add, "sub": subtract, "mul": multiply, "truediv": divide, "floordiv": floor_divide, "mod": remainder, "pow": power}.items():
        setattr(Raster, f"__{name}__", lambda self, other, f=f: f(self, other))
        setattr(Raster, f"__r{name}__", swapped(f))
    for name, f in {"lt": less, "le": less_equal, "gt": greater, "ge": greater_equal, "eq": equal, "ne": not_equal, "and": logical_and, "or": logical_or, "xor": logical_xor}.items():
        setattr(Raster, f"__{name}__", lambda self, other, f=f: f(self, other))
    for name, f in {"rand": logical_and, "ror": logical_or, "rxor": logical_xor}.items():
        setattr(Raster, f"__{name}__", swapped(f))
    for name, f in {"neg": negative, "pos": positive, "abs": absolute, "invert": logical_not, "floor": floor, "ceil": ceil, "trunc": trunc}.items():
        setattr(Raster, f"__{name}__", lambda self, f=f: f(self))
    Raster.__round__ = lambda self, ndigits=0: round_half_even(self, ndigits or 0)


_install()
