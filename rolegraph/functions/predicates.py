"""Conditions as Spark columns; what types decide is decided here, so no cast can fail while running."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolegraph.functions.fold import fold, folded
from rolegraph.lang import tree as T

#: A resolved column: expression, type (str, int, float, bool), and whether it holds several values.
Resolved = tuple[Column, str, bool]

_TESTS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


def _scalar(col: Column, kind: str, op: str, value: object) -> Column:
    """A present scalar against a literal."""
    if op == "contains":
        text = folded(col) if kind == "str" else folded(_text(col, kind))
        return F.contains(text, F.lit(fold(_python_text(value))))
    if isinstance(value, str) or kind == "str":
        if not isinstance(value, str) or kind != "str":  # types differ
            return F.when(col.isNotNull(), F.lit(op == "!="))
        return getattr(folded(col), _TESTS[op])(F.lit(fold(value)))
    if kind == "bool":
        col = col.cast("int")
    return getattr(col, _TESTS[op])(F.lit(int(value) if isinstance(value, bool) else value))


def _text(col: Column, kind: str) -> Column:
    return F.when(col, F.lit("True")).otherwise(F.lit("False")) if kind == "bool" else col.cast("string")


def _python_text(value: object) -> str:
    return value if isinstance(value, str) else str(value)


def clause(col: Column, kind: str, multi: bool, op: str, value: object) -> Column:
    """One comparison; an absent value satisfies `= none` only, and gives null elsewhere, which filters and their OR of ANDs take as false."""
    empty = col.isNull() | (F.size(col) == 0) if multi else col.isNull()
    if value is T.ABSENT:
        return empty if op == "=" else ~empty
    if not multi:
        return _scalar(col, kind, op, value)  # bare, so that it reaches the scan
    if op in ("=", "contains"):
        test = F.exists(col, lambda x: F.coalesce(_scalar(x, kind, op, value), F.lit(False)))
    elif op == "!=":
        test = ~F.exists(col, lambda x: F.coalesce(_scalar(x, kind, "=", value), F.lit(False)))
    else:
        return F.lit(False)
    return F.coalesce(test, F.lit(False))


def condition(cond: T.Cond, resolve: Callable[[T.Path], Resolved]) -> Column:
    """OR of ANDs."""
    out: Column | None = None
    for group in cond:
        both: Column | None = None
        for c in group:
            one = clause(*resolve(c.path), c.op, c.value)
            both = one if both is None else both & one
        out = both if out is None else out | both
    return F.lit(True) if out is None else out
