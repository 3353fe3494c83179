"""Filter rules as Column predicates.

Null rules follow dataframe (not SQL) logic: ``ne``, ``not_in`` and ``not_contains`` keep null rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.quoting import named

# Accepted spellings of each operator.
OPERATOR_SPELLINGS = {
    "eq": ("eq", "equals", "=", "=="),
    "ne": ("ne", "not_equals", "!=", "<>"),
    "gt": ("gt", "greater_than", ">"),
    "lt": ("lt", "less_than", "<"),
    "ge": ("ge", "gte", "greater_equal", "greater_than_or_equal", ">="),
    "le": ("le", "lte", "less_equal", "less_than_or_equal", "<="),
    "in": ("in",),
    "not_in": ("not_in",),
    "contains": ("contains",),
    "not_contains": ("not_contains",),
    "starts_with": ("starts_with",),
    "ends_with": ("ends_with",),
    "is_null": ("is_null",),
    "not_null": ("not_null", "is_not_null"),
    "regex": ("regex",),
}
_CANONICAL = {word: name for name, words in OPERATOR_SPELLINGS.items() for word in words}


def canonical_operator(word: str) -> str:
    """Internal operator name for any accepted spelling."""
    try:
        return _CANONICAL[str(word).strip().lower()]
    except KeyError:
        raise ValueError(f"Unknown filter operator: {word}") from None


def is_missing(df: DataFrame, column: str) -> Column:
    """Null, or NaN in a floating column."""
    col = named(column)
    if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def comparable(kind: T.DataType, value: Any) -> Column:
    """Literal that compares with a column of this type without a failing cast; null when it never can."""
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    if isinstance(value, str):
        if not isinstance(kind, T.NumericType):
            return F.lit(value).try_cast(kind)
        try:
            return F.lit(int(value))
        except ValueError:
            return F.lit(value).try_cast("double")
    return F.lit(value)


def _matches(text: Column, value: str, case_sensitive: bool, literal: bool) -> Column:
    if literal:
        if case_sensitive:
            return text.contains(value)
        return F.lower(text).contains(value.lower())
    return text.rlike(value if case_sensitive else f"(?i){value}")


def rule_predicate(df: DataFrame, rule: Mapping[str, Any]) -> Column:
    """Predicate for one rule ``{column, operator, value, case_sensitive, literal}``."""
    column = rule["column"]
    if column not in df.columns:
        raise ValueError(f"Column '{column}' not found in data")
    operator = canonical_operator(rule["operator"])
    value = rule.get("value")
    col = named(column)
    text = col.cast("string")
    sensitive = rule.get("case_sensitive", True) is not False
    literal = bool(rule.get("literal", False))

    def contains() -> Column:
        return _matches(text, str(value), sensitive, literal)

    kind = df.schema[column].dataType

    def wanted() -> Column:
        return comparable(kind, value)

    def member() -> Column:
        return col.isin([comparable(kind, v) for v in value])

    builders: dict[str, Callable[[], Column]] = {
        "eq": lambda: col == wanted(),
        "ne": lambda: F.coalesce(col != wanted(), F.lit(True)),
        "gt": lambda: col > wanted(),
        "lt": lambda: col < wanted(),
        "ge": lambda: col >= wanted(),
        "le": lambda: col <= wanted(),
        "in": member,
        "not_in": lambda: F.coalesce(~member(), F.lit(True)),
        "contains": contains,
        "not_contains": lambda: F.coalesce(~contains(), F.lit(True)),
        "starts_with": lambda: text.startswith(str(value)),
        "ends_with": lambda: text.endswith(str(value)),
        "is_null": lambda: is_missing(df, column),
        "not_null": lambda: ~is_missing(df, column),
        "regex": lambda: _matches(text, str(value), sensitive, False),
    }
    return builders[operator]()


def combine(predicates: Sequence[Column], logic: str = "AND") -> Column:
    """Conjunction or disjunction; no predicates means every row passes."""
    word = str(logic).upper()
    if word not in ("AND", "OR"):
        raise ValueError(f"Unknown logical operator: {logic}")
    if not predicates:
        return F.lit(True)
    if word == "AND":
        return reduce(lambda a, b: a & b, predicates)
    return reduce(lambda a, b: F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)), predicates)


def extraction_predicate(df: DataFrame, filters: Mapping[str, Any], dialect: str = "sql") -> Column:
    """Predicate of an extraction filter dict ``{col: value | {op: value}}``; unknown columns are ignored.

    ``like`` means SQL LIKE (``sql``), a case-insensitive regex (``document``) or a substring (``search``).
    """
    likes: dict[str, Callable[[Column, Any], Column]] = {
        "sql": lambda c, v: c.like(v),
        "document": lambda c, v: c.rlike(f"(?i){v}"),
        "search": lambda c, v: c.contains(v),
    }
    if dialect not in likes:
        raise ValueError(f"Unknown filter dialect: {dialect}")
    parts: list[Column] = []
    for column, wanted in filters.items():
        if column not in df.columns:
            continue
        col, kind = named(column), df.schema[column].dataType
        tests: dict[str, Callable[[Any], Column]] = {
            "gt": lambda v, c=col, k=kind: c > comparable(k, v),
            "lt": lambda v, c=col, k=kind: c < comparable(k, v),
            "gte": lambda v, c=col, k=kind: c >= comparable(k, v),
            "lte": lambda v, c=col, k=kind: c <= comparable(k, v),
            "in": lambda v, c=col, k=kind: c.isin([comparable(k, x) for x in v]),
            "like": lambda v, c=col: likes[dialect](c.cast("string"), v),
        }
        if not isinstance(wanted, Mapping):
            parts.append(col == comparable(kind, wanted))
            continue
        for op, value in wanted.items():
            if op not in tests:
                raise ValueError(f"Unknown extraction operator: {op}")
            parts.append(tests[op](value))
    return combine(parts)
