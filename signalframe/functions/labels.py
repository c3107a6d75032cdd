"""Label and attribute expressions: matchers, attribute predicates, numeric labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .values import anchored, checked, col, safe_pattern


def matcher(labels: str | Column, key: str, op: str, value: str) -> Column:
    """A label matcher.  = and =~ never match a series without the label; != and !~ always do.  Regular expressions match whole values."""
    v = F.element_at(col(labels), F.lit(key))
    if op == "=":
        return F.coalesce(v == value, F.lit(False))
    if op == "!=":
        return ~F.coalesce(v == value, F.lit(False))
    if op == "=~":
        return F.coalesce(v.rlike(anchored(value)), F.lit(False))
    if op == "!~":
        return ~F.coalesce(v.rlike(anchored(value)), F.lit(False))
    raise ValueError(f"unknown matcher {op!r}")


def matches_value(value: str | Column, expected: object) -> Column:
    """True where ``value`` is the expected scalar, one of a list, matches a compiled pattern, or satisfies a function of a Column; None is a wildcard."""
    v = col(value)
    if expected is None:
        return F.lit(True)
    if isinstance(expected, Column):
        return F.coalesce(v == expected, F.lit(False))
    if hasattr(expected, "pattern"):
        return F.coalesce(v.cast("string").rlike(checked(expected.pattern)), F.lit(False))
    if callable(expected):
        return F.coalesce(expected(v), F.lit(False))
    if isinstance(expected, (list, tuple, set)):
        return F.coalesce(v.isin(list(expected)), F.lit(False))
    return F.coalesce(v == expected, F.lit(False))


def _typed(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long"
    return "double" if isinstance(value, float) else "string"


def attribute(op: str, attributes: str | Column, key: str, value: object = None) -> Column:
    """An attribute predicate over a map of strings or a variant column.

    A missing attribute satisfies notExists only.  On a variant, values of
    another type than the attribute's never compare (a whole number is not a
    fraction); on a map of strings a number is compared with values that read
    as numbers.
    """
    attrs = col(attributes)
    v = F.element_at(attrs, F.lit(key))
    return _attribute(op, v, value)


def variant_attribute(op: str, attributes: str, key: str, value: object = None) -> Column:
    path = "$['" + key.replace("'", "\\'") + "']"
    raw = F.expr(f"try_variant_get(`{attributes}`, \"{path}\", 'variant')")
    if op in ("exists", "notExists"):
        return raw.isNotNull() if op == "exists" else raw.isNull()
    sample = value[0] if isinstance(value, (list, tuple)) and value else value
    kind = _typed(sample)
    names = {"long": ("BIGINT",), "double": ("DOUBLE", "DECIMAL"), "string": ("STRING",), "boolean": ("BOOLEAN",)}[kind]
    fits = F.lit(False)
    for name in names:
        fits = fits | F.expr(f"schema_of_variant(try_variant_get(`{attributes}`, \"{path}\", 'variant'))").startswith(name)
    typed = F.when(fits, F.expr(f"try_variant_get(`{attributes}`, \"{path}\", '{kind}')"))
    if op == "neq":
        return raw.isNotNull() & ~F.coalesce(typed == value, F.lit(False))
    return _attribute(op, typed, value)


def _attribute(op: str, v: Column, value: object) -> Column:
    if op == "exists":
        return v.isNotNull()
    if op == "notExists":
        return v.isNull()
    sample = value[0] if isinstance(value, (list, tuple)) and value else value
    number = isinstance(sample, (int, float)) and not isinstance(sample, bool)
    compared = v.try_cast("double") if number else v
    ops: dict[str, Callable[[], Column]] = {
        "eq": lambda: compared == value,
        "neq": lambda: v.isNotNull() & ~F.coalesce(compared == value, F.lit(False)),
        "gt": lambda: compared > value,
        "gte": lambda: compared >= value,
        "lt": lambda: compared < value,
        "lte": lambda: compared <= value,
        "regex": lambda: v.rlike(value) if isinstance(value, str) and safe_pattern(value) else F.lit(False),
        "contains": lambda: v.contains(value) if isinstance(value, str) else F.lit(False),
        "startsWith": lambda: v.startswith(value) if isinstance(value, str) else F.lit(False),
        "in": lambda: compared.isin(list(value)) if isinstance(value, (list, tuple)) else F.lit(False),
    }
    if op not in ops:
        raise ValueError(f"unknown attribute operator {op!r}")
    return F.coalesce(ops[op](), F.lit(False))


def sanitized(key: str | Column) -> Column:
    """A label name from an attribute key: what is no letter, digit or underscore becomes one."""
    return F.regexp_replace(col(key), "[^a-zA-Z0-9_]", "_")


def format_numeric(value: float | None) -> str | None:
    """A label from a number: whole numbers as they are, else 12 significant digits, less a fraction of zeros only."""
    if value is None or value != value:
        return None if value is None else "NaN"
    if value in (float("inf"), float("-inf")):
        return "Infinity" if value > 0 else "-Infinity"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    exponent = int(f"{value:.11e}".split("e")[1])
    if exponent < -6 or exponent >= 12:
        mantissa, power = f"{value:.11e}".split("e")
        return f"{mantissa}e{int(power):+d}"
    text = f"{value:.{11 - exponent}f}"
    whole, _, fraction = text.partition(".")
    return whole if fraction.strip("0") == "" else text


def _format_all(value: pd.Series) -> pd.Series:
    return value.map(lambda v: None if v is None or pd.isna(v) else format_numeric(float(v)))


def numeric_label(value: str | Column) -> Column:
    """``format_numeric`` of a column, in Arrow batches; null for null and NaN."""
    return F.pandas_udf(_format_all, StringType())(col(value))


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
