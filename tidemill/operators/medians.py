"""Exact medians that stay distributed for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.quoting import named
from tidemill.operators.ordering import with_range_bucket


def exact_median(df: DataFrame, keys: Sequence[str], value: str, alias: str, buckets: int | None = None) -> DataFrame:
    """One row per key group that has a value, with the exact median of ``value``; without keys one row.

    Selection by rank, one way for groups of all sizes. Rows are first counted by group and value, combined before the
    shuffle. The counts are cut into ranges of group and value; how many rows each range holds tells which one has
    the middle rows, and only that is ranked. No buffer holds the values of a group, and no job runs while the plan
    is built.
    """
    groups = [named(k) for k in keys]
    slim = df.select(*groups, named(value).alias("__v")).filter(F.col("__v").isNotNull())
    per_value = slim.groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("__n"))
    per_value = with_range_bucket(per_value, [*keys, "__v"], "__bucket", buckets)
    per_bucket = per_value.groupBy(*groups, "__bucket").agg(F.sum("__n").alias("__n"))
    # at most one row per range and group: the window stays small even for a hot group
    all_buckets = Window.partitionBy(*(groups or [F.lit(0)]))
    before = all_buckets.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("__n").over(all_buckets)
    ranges = per_bucket.select(
        *groups, "__bucket", F.col("__n"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"),
        F.floor((total + 1) / 2).alias("__low"), (F.floor(total / 2) + 1).alias("__high"),
    )
    end = F.col("__base") + F.col("__n")
    holds = ((F.col("__low") > F.col("__base")) & (F.col("__low") <= end)) | (
        (F.col("__high") > F.col("__base")) & (F.col("__high") <= end)
    )
    targets = ranges.filter(holds).select(
        *[named(k).alias(f"__t{i}") for i, k in enumerate(keys)],
        F.col("__bucket").alias("__tb"), "__base", "__low", "__high",
    )
    same = F.col("__bucket") == F.col("__tb")
    for i, k in enumerate(keys):
        same = same & named(k).eqNullSafe(F.col(f"__t{i}"))
    narrowed = per_value.join(targets, same).select(*groups, "__bucket", "__v", "__n", "__base", "__low", "__high")
    running = Window.partitionBy(*groups, "__bucket").orderBy("__v")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = narrowed.withColumn("__end", F.col("__base") + F.sum("__n").over(running))
    start = F.col("__end") - F.col("__n")

    def at(rank: str):
        return F.max(F.when((F.col(rank) > start) & (F.col(rank) <= F.col("__end")), F.col("__v").cast("double")))

    # halves are added, because the sum of two large values is no number
    middle = F.when(at("__low") == at("__high"), at("__low")).otherwise(at("__low") * 0.5 + at("__high") * 0.5)
    return ranked.groupBy(*groups).agg(middle.alias(alias))
