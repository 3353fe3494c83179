"""Grouped and global aggregation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.predicates import combine, rule_predicate
from tidemill.functions.quoting import named
from tidemill.operators.medians import exact_median
from tidemill.session import require_columns

# Accepted spellings of each aggregate function.
FUNCTION_SPELLINGS = {
    "count": ("count",), "sum": ("sum",), "avg": ("avg", "mean"), "min": ("min",), "max": ("max",),
    "median": ("median",), "std": ("std", "stddev"), "var": ("var", "variance"),
    "first": ("first",), "last": ("last",), "count_distinct": ("count_distinct", "nunique"),
    "approx_count_distinct": ("approx_count_distinct",),
}
_CANONICAL = {word: name for name, words in FUNCTION_SPELLINGS.items() for word in words}


def expand_aggregations(aggregations) -> list[dict[str, Any]]:
    """List form ``[{column, function, alias}]`` of a list or of the short ``{column: function}`` form."""
    if isinstance(aggregations, Mapping):
        aggregations = [{"column": c, "function": f} for c, f in aggregations.items()]
    out = []
    for spec in aggregations:
        word = str(spec["function"]).lower()
        if word not in _CANONICAL:
            raise ValueError(f"Unknown aggregate function: {spec['function']}")
        alias = spec.get("alias") or f"{spec['column']}_{spec['function']}"
        out.append({"column": spec["column"], "function": _CANONICAL[word], "alias": alias})
    return out


_NUMERIC_ONLY = ("sum", "avg", "median", "std", "var")


def _check_numeric(df: DataFrame, specs: Sequence[Mapping[str, Any]]) -> None:
    for spec in specs:
        kind = df.schema[spec["column"]].dataType
        if spec["function"] in _NUMERIC_ONLY and not isinstance(kind, (T.NumericType, T.BooleanType)):
            raise ValueError(f"'{spec['function']}' needs a numeric column, '{spec['column']}' is {kind.simpleString()}")


def _expression(function: str, column: str, order_by: Sequence[str]) -> Column:
    col = named(column)
    if function in ("first", "last"):
        if not order_by:
            raise ValueError(f"'{function}' needs order_by: rows have no order of their own")
        order = named(order_by[0]) if len(order_by) == 1 else F.struct(*[named(c) for c in order_by])
        key = F.when(col.isNotNull(), order)
        return F.min_by(col, key) if function == "first" else F.max_by(col, key)
    simple = {
        "count": F.count, "avg": F.avg, "min": F.min, "max": F.max,
        "std": F.stddev_samp, "var": F.var_samp, "count_distinct": F.count_distinct,
        "approx_count_distinct": F.approx_count_distinct,
    }
    if function == "sum":
        return F.coalesce(F.sum(col), F.lit(0))
    return simple[function](col)


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    aggregations,
    having: Sequence[Mapping[str, Any]] = (),
    order_by: Sequence[str] = (),
    keep_null_keys: bool = False,
) -> DataFrame:
    """Aggregate over ``group_by`` (none: one row); rows with a null key are dropped by default."""
    specs = expand_aggregations(aggregations)
    require_columns(df, [*group_by, *[s["column"] for s in specs], *order_by])
    _check_numeric(df, specs)
    flags = {s["column"] for s in specs if s["function"] in _NUMERIC_ONLY and
             isinstance(df.schema[s["column"]].dataType, T.BooleanType) and s["column"] not in group_by}
    df = df.withColumns({c: named(c).cast("int") for c in flags}) if flags else df
    source = df if keep_null_keys or not group_by else df.dropna(subset=list(group_by))
    groups = [named(c) for c in group_by]
    ranked = [s for s in specs if s["function"] == "median"]
    exprs = [_expression(s["function"], s["column"], order_by).alias(s["alias"]) for s in specs if s not in ranked]
    result = source.groupBy(*groups).agg(*(exprs or [F.count(F.lit(1)).alias("__rows")]))
    for spec in ranked:
        medians = exact_median(source, group_by, spec["column"], spec["alias"])
        if not group_by:
            result = result.withColumn(spec["alias"], medians.scalar())
            continue
        medians = medians.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(group_by)})
        on = combine([named(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(group_by)])
        result = result.join(medians, on, "left").drop(*[f"__k{i}" for i in range(len(group_by))])
    result = result.select(*groups, *[named(s["alias"]) for s in specs])
    for rule in having:
        result = result.filter(rule_predicate(result, rule))
    return result
