"""Named, inspectable plans.

Rasters are lazy already; an expression also remembers which operators made it. Building a node runs the operator's analysis (grid, dtype, units), so errors
appear before anything is computed. Nodes with the same operator, parameters and operands are one node.
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
from pyspark.sql import DataFrame

from terrella.errors import OperationError
from terrella.functions.text import digest, canonical
from terrella.operators.temporal import TemporalRaster, lifted
from terrella.plans import registry
from terrella.raster import Raster

#: Limits of a plan.
MAX_NODES, MAX_DEPTH, MAX_SOURCES = 10_000, 500, 1_000


class Expression:
    """A node: a source, or an operator over operands (expressions and scalars)."""

    def __init__(self, operation: str, operands: tuple, parameters: dict[str, Any], result):
        self.operation, self.operands, self.parameters, self.result = operation, operands, parameters, result
        self.key = digest({"operation": operation, "operands": [o.key if isinstance(o, Expression) else canonical(o) for o in operands], "parameters": canonical(parameters)})
        nodes = self.nodes()
        if len(nodes) > MAX_NODES or _depth(self) > MAX_DEPTH or sum(n.operation in ("source", "constant", "temporal.source") for n in nodes) > MAX_SOURCES:
            raise OperationError("The plan is too large.", code="plan_limits", details={"nodes": len(nodes)})

    @property
    def grid(self):
        return getattr(self.result, "grid", None)

    @property
    def dtype(self):
        return getattr(self.result, "dtype", None)

    @property
    def units(self):
        return getattr(self.result, "units", None)

    def nodes(self) -> list[Expression]:
        """Each distinct node once, operands first."""
        seen: dict[str, Expression] = {}
        stack: list[tuple[Expression, bool]] = [(self, False)]
        while stack:
            node, ready = stack.pop()
            if node.key in seen:
                continue
            if ready:
                seen[node.key] = node
            else:
                stack.append((node, True))
                stack += [(o, False) for o in reversed(node.operands) if isinstance(o, Expression)]
        return list(seen.values())

    def to_json(self) -> str:
        nodes = self.nodes()
        ids = {n.key: f"n{i}" for i, n in enumerate(nodes)}
        return json.dumps({"version": 1, "root": ids[self.key], "nodes": [{"id": ids[n.key], "operation": n.operation, "operands": [{"node": ids[o.key]} if isinstance(o, Expression) else {"scalar": canonical(o)} for o in n.operands], "parameters": canonical(n.parameters), "dtype": n.dtype, "units": n.units, "grid": None if n.grid is None else canonical(n.grid.to_dict())} for n in nodes]}, sort_keys=True, separators=(",", ":"))

    to_canonical_json = to_json

    def scientific_identity(self) -> str:
        return self.key

    def __bool__(self):
        raise OperationError("An expression has no truth value.", code="ambiguous_truth")

    __hash__ = object.__hash__


def _depth(e: Expression) -> int:
    level = {}
    for n in e.nodes() if e.operands else [e]:
        level[n.key] = 1 + max((level[o.key] for o in n.operands if isinstance(o, Expression)), default=0)
    return level[e.key]


def source(raster: Raster | TemporalRaster, identity: str) -> Expression:
    """A leaf with a stable identity, such as the digest of stored files."""
    return Expression("temporal.source" if isinstance(raster, TemporalRaster) else "source", (), {"identity": identity}, raster)


def constant(raster: Raster) -> Expression:
    """A leaf that is known by its cells."""
    values, valid = raster.collect()
    return Expression("constant", (), {"values": np.where(valid, values, np.zeros((), values.dtype)), "valid": valid, "grid": raster.grid}, raster)


def apply(operation_id: str, *operands, **parameters) -> Expression:
    """A node of a registered operator. Cell operators over a series are applied layer by layer."""
    spec = registry.describe_operation(operation_id)
    plain = [o.result if isinstance(o, Expression) else o for o in operands]
    if any(isinstance(p, TemporalRaster) for p in plain) and spec.category != "temporal":
        result = lifted(spec.function, *plain, **parameters)
    else:
        result = spec.function(*plain, **parameters)
    return Expression(operation_id, tuple(operands), parameters, result)


def compute(expression: Expression):
    """Values and validity of a raster, or rows of a table."""
    r = expression.result
    if isinstance(r, Raster):
        return r.collect()
    return r.df.collect() if isinstance(r, TemporalRaster) else r.collect()


def explain(expression: Expression, *, physical: bool = False) -> str:
    nodes = expression.nodes()
    ids = {n.key: f"n{i}" for i, n in enumerate(nodes)}
    g = expression.grid
    lines = [f"{len(nodes)} nodes, {expression.scientific_identity()}", f"output: {f'{g.width} x {g.height} ' if g else ''}{expression.dtype}{f' [{expression.units}]' if expression.units else ''}"]
    for n in nodes:
        inputs = ", ".join(ids[o.key] if isinstance(o, Expression) else repr(o) for o in n.operands)
        shown = ", ".join(f"{k}={v!r}" for k, v in n.parameters.items() if not isinstance(v, np.ndarray))
        lines.append(f"  [{ids[n.key]}] {n.operation}({inputs}){f' {shown}' if shown else ''} -> {n.dtype}{f' [{n.units}]' if n.units else ''}")
    if physical:
        lines.append(_frame(expression)._jdf.queryExecution().executedPlan().toString())
    return "\n".join(lines)


explain_temporal = explain


def _frame(expression: Expression) -> DataFrame:
    r = expression.result
    return r.cells() if isinstance(r, Raster) else r.df if isinstance(r, TemporalRaster) else r


def plan(expression: Expression, *, output: str | None = None) -> dict[str, Any]:
    """What running the expression would take: cells, nodes, sources, shuffles, and the state of the output."""
    from terrella.sources.rasters import exists

    df = _frame(expression)
    text = df._jdf.queryExecution().executedPlan().toString()
    g = expression.grid
    return {
        "identity": expression.scientific_identity(), "nodes": len(expression.nodes()), "sources": [n.parameters.get("identity", "in memory") for n in expression.nodes() if n.operation in ("source", "constant", "temporal.source")],
        "cells": None if g is None else g.width * g.height, "dtype": expression.dtype, "units": expression.units, "shuffles": text.count("Exchange hashpartitioning"), "joins": text.count("Join"), "estimated_bytes": int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())),
        "output": None if output is None else {"path": output, "complete": exists(df.sparkSession, f"{output}/meta/_SUCCESS")},
    }


def _install() -> None:
    names = {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "mod": "remainder", "pow": "power", "lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal", "eq": "equal", "ne": "not_equal", "and": "logical_and", "or": "logical_or", "xor": "logical_xor"}
    for n, op in names.items():
        setattr(Expression, f"__{n}__", lambda self, other, op=op: apply(f"local.{op}", self, other))
        if n not in ("lt", "le", "gt", "ge", "eq", "ne"):
            setattr(Expression, f"__r{n}__", lambda self, other, op=op: apply(f"local.{op}", other, self))
    for n, op in {"neg": "negative", "abs": "absolute", "invert": "logical_not"}.items():
        setattr(Expression, f"__{n}__", lambda self, op=op: apply(f"local.{op}", self))


_install()
