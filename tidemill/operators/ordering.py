"""Splitting a frame by row order, so no window ever holds one hot group or the whole table.

Cut points are found by the plan itself: an aggregate keeps the rows with the smallest hash in each of a fixed number
of residue classes, whose order keys are a sample that does not depend on how the rows were partitioned. The plan reads
it as a scalar subquery, so no job runs while the plan is built, and the bucket of a row is a pure function of its key
and stays the same when a lost executor forces a recomputation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.quoting import named
from tidemill.session import materialize, require_columns

_SAMPLES_PER_BUCKET = 8
_BUCKETS_PER_PARTITION = 4


def default_buckets(df: DataFrame) -> int:
    """Four buckets per shuffle partition: the setting that fits partitions to the data fits buckets too."""
    return _BUCKETS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_cuts(df: DataFrame, order_by: Sequence[str], buckets: int) -> DataFrame:
    """One row with an array ``cuts`` of fewer than ``buckets`` order keys that cut ``df`` evenly."""
    key = F.struct(*[named(c).alias(f"k{i}") for i, c in enumerate(order_by)])
    luck = df.select(key.alias("key")).withColumn("hash", F.xxhash64("key"))
    kept = luck.groupBy(F.pmod("hash", F.lit(_SAMPLES_PER_BUCKET * buckets)).alias("class")).agg(
        F.min(F.struct("hash", "key")).alias("first"))
    sample = kept.agg(F.array_sort(F.collect_list("first.key")).alias("sample"))
    at = F.sequence(F.lit(1), F.lit(buckets - 1)) if buckets > 1 else F.array().cast("array<int>")
    picked = F.transform(at, lambda i: F.get("sample", F.floor(i * F.size("sample") / F.lit(buckets)).cast("int")))
    return sample.select(F.filter(picked, lambda c: c.isNotNull()).alias("cuts"))


def with_range_bucket(df: DataFrame, order_by: Sequence[str], column: str, buckets: int | None = None) -> DataFrame:
    """Add the number of the row's order bucket: how many cut points lie at or before it.

    The binary search is unrolled into one projection per halving, which generated code runs.
    """
    buckets = buckets or default_buckets(df)
    if buckets <= 1:
        return df.withColumn(column, F.lit(0))
    cuts = range_cuts(df, order_by, buckets).scalar()
    key = F.struct(*[named(c).alias(f"k{i}") for i, c in enumerate(order_by)])
    out = df.withColumn(column, F.lit(0))
    step = 1 << (buckets - 2).bit_length()
    while step:
        # beyond the end there is no cut, which counts as none before the row
        before = F.get(cuts, named(column) + F.lit(step - 1)) <= key
        out = out.withColumn(column, named(column) + F.when(before, F.lit(step)).otherwise(F.lit(0)))
        step >>= 1
    return out


def dense_ids(df: DataFrame, order_by: Sequence[str], id_column: str = "id", start: int = 1) -> DataFrame:
    """Add a gap-free id in ``order_by`` order without a window over the data.

    One range-partitioned sort, written to the shared folder; the id is the row's place in its partition plus the row
    counts of earlier partitions. The joined offset table has one row per partition.
    """
    require_columns(df, order_by)
    slot = F.monotonically_increasing_id()
    # the tie column lets equal keys fall into different sort partitions
    ordered = df.withColumn("__tie", F.monotonically_increasing_id()).orderBy(*order_by, "__tie").drop("__tie")
    placed = materialize(ordered.withColumn("__slot", slot))
    part = F.shiftright(F.col("__slot"), 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # one row per partition of the sort: small by construction
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__base"))
    place = F.col("__slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .select((F.col("__base") + place + F.lit(start)).alias(id_column), *[named(c) for c in df.columns])
    )
