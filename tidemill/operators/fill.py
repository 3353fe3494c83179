"""Null filling: constants, carried values and column statistics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.predicates import is_missing
from tidemill.functions.quoting import named
from tidemill.operators.medians import exact_median
from tidemill.operators.ordering import with_range_bucket
from tidemill.session import require_columns


def _accepts(data_type: T.DataType, value: Any) -> bool:
    if isinstance(value, bool):
        return isinstance(data_type, T.BooleanType)
    if isinstance(value, (int, float)):
        return isinstance(data_type, T.NumericType)
    return isinstance(data_type, T.StringType)


def fill_value(df: DataFrame, column: str, value: Any = "") -> DataFrame:
    """Constant for the nulls of one column, cast to the column's type."""
    require_columns(df, [column])
    literal = F.lit(value).try_cast(df.schema[column].dataType)
    return df.withColumn(column, F.coalesce(_without_nan(df, column), literal))


def fill_all_value(df: DataFrame, value: Any = "") -> DataFrame:
    """Constant for the nulls of every column whose type can hold it."""
    fits = [f.name for f in df.schema.fields if _accepts(f.dataType, value)]
    return df.withColumns({
        c: F.coalesce(_without_nan(df, c), F.lit(value).cast(df.schema[c].dataType)) for c in fits
    })


def _without_nan(df: DataFrame, column: str) -> Column:
    return F.when(~is_missing(df, column), named(column))


def fill_carried(
    df: DataFrame,
    columns: Sequence[str] | None,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    direction: str = "forward",
    buckets: int | None = None,
) -> DataFrame:
    """Last (``forward``) or next (``backward``) non-null value in ``order_by`` order.

    ``order_by`` must order the rows of a group uniquely. Rows are cut into ``buckets`` ranges of group and order. Each
    range gives one row: its last non-null value of each column, with its group. A scan over these rows carries them
    on, and what a range is handed fills the rows of the same group that its own values do not reach. So a task holds
    one range of a group, however large the group is, and the table of carried values one row per range.
    """
    if not order_by:
        raise ValueError("order_by is required: rows have no order of their own")
    if direction not in ("forward", "backward"):
        raise ValueError(f"Unknown fill direction: {direction}")
    taken = set(order_by) | set(partition_by)
    columns = [c for c in df.columns if c not in taken] if columns is None else list(columns)
    require_columns(df, [*columns, *order_by, *partition_by])
    forward = direction == "forward"
    work = df.withColumns({c: _without_nan(df, c) for c in columns})
    ranged = with_range_bucket(work, [*partition_by, *order_by], "__bucket", buckets)
    groups = [named(c) for c in partition_by]
    place = F.struct(*groups, *[named(c) for c in order_by])  # a struct: a null order key is smallest, not absent
    nearest = F.max_by if forward else F.min_by
    group = F.struct(F.lit(0).alias("one"), *[g.alias(f"g{i}") for i, g in enumerate(groups)])
    edges = ranged.groupBy("__bucket").agg(*[
        nearest(F.struct(group.alias("group"), named(c).alias("value")), F.when(named(c).isNotNull(), place)).alias(f"__e{i}")
        for i, c in enumerate(columns)])
    # one row per range
    before = Window.orderBy(F.col("__bucket").asc() if forward else F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(F.col("__bucket").alias("__at"), *[F.last(f"__e{i}", ignorenulls=True).over(before).alias(f"__e{i}") for i in range(len(columns))])
    order = [named(c).asc_nulls_first() if forward else named(c).desc_nulls_last() for c in order_by]
    inside = Window.partitionBy("__bucket", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    handed = [F.when(F.col(f"__e{i}.group").eqNullSafe(group), F.col(f"__e{i}.value")) for i in range(len(columns))]
    filled = ranged.withColumns({c: F.last(named(c), ignorenulls=True).over(inside) for c in columns})
    filled = filled.join(F.broadcast(carried), F.col("__bucket") == F.col("__at"), "left")
    return filled.withColumns({c: F.coalesce(named(c), h) for c, h in zip(columns, handed, strict=True)}).select(*[named(c) for c in df.columns])


def _is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def _fill_from(df: DataFrame, column: str, one_row: DataFrame) -> DataFrame:
    """Fill from a one-row, one-column frame used as a scalar subquery."""
    return df.withColumn(column, F.coalesce(_without_nan(df, column), one_row.scalar()))


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    """Mean of a numeric column; other columns are left alone."""
    require_columns(df, [column])
    if not _is_numeric(df, column):
        return df
    return _fill_from(df, column, df.agg(F.avg(_without_nan(df, column)).alias("m")))


def fill_median(df: DataFrame, column: str, buckets: int | None = None) -> DataFrame:
    """Exact median of a numeric column; other columns are left alone."""
    require_columns(df, [column])
    if not _is_numeric(df, column):
        return df
    values = df.select(_without_nan(df, column).alias(column))
    return _fill_from(df, column, exact_median(values, [], column, "m", buckets))


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value, the smallest one on ties."""
    require_columns(df, [column])
    counts = (
        df.select(_without_nan(df, column).alias("v")).filter(F.col("v").isNotNull())
        .groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )
    # count per value first: the winner is then the smallest (-n, v), one row of state
    best = counts.agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("v"))).getField("v").alias("m"))
    return _fill_from(df, column, best)
