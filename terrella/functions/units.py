"""Units are a static analysis: they are checked and inferred before any plan is built."""

from __future__ import annotations

from terrella.errors import UnitError


def match(a: str | None, b: str | None, *, allow_unknown: bool = False) -> None:
    if a == b or (allow_unknown and (a is None or b is None)):
        return
    code = "unknown_units" if a is None or b is None else "unit_mismatch"
    raise UnitError("Units must match.", code=code, details={"left_units": a, "right_units": b})


def angle(units: str | None) -> str:
    name = (units or "").strip().lower()
    if name not in ("degrees", "radians"):
        raise UnitError("Trigonometric operators need degrees or radians.", code="missing_angle_units" if units is None else "invalid_angle_units", details={"units": units})
    return name


def declared(units: str | None) -> str | None:
    if units is not None and (not isinstance(units, str) or not units.strip()):
        raise UnitError("output_units must be a non-empty string or None.", code="invalid_output_units")
    return units.strip() if units else None


def multiply(a: str | None, b: str | None, output: str | None = None) -> str | None:
    output = declared(output)
    if a is not None and b is not None:
        if output is None:
            raise UnitError("Two operands with units need output_units.", code="missing_output_units", details={"left_units": a, "right_units": b})
        return output
    return output or a or b


def power(base: str | None, exponent_units: str | None, exponent, output: str | None, *, base_is_raster: bool = True) -> str | None:
    """exponent: the scalar, or None where the exponent is a raster."""
    output = declared(output)
    if exponent is None:
        if exponent_units is not None or (base_is_raster and base is not None) or output is not None:
            raise UnitError("A raster exponent takes no units.", code="dimensioned_exponent")
        return None
    if base is None:
        return output
    if exponent == 1 and output is None:
        return base
    if output is None:
        raise UnitError("A power of a base with units needs output_units.", code="missing_output_units", details={"base_units": base})
    return output
