"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

# Runtime options every plan here relies on.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even if that costs the next operator a shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # generated code of a full join holds all pairs of a key in memory, the plain operator only the key's rows
    "spark.sql.codegen.join.fullOuterSortMergeJoin.enabled": "false",
}

_local_dirs: dict[str, str] = {}


def build_session(
    app_name: str = "tidemill", master: str | None = None, shuffle_partitions: int | None = None,
    options: Mapping[str, str] | None = None,
) -> SparkSession:
    """A session with the runtime options set; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_OPTIONS, **(options or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime options to an existing session."""
    for key, value in RUNTIME_OPTIONS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a temp folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="tidemill-")
    return _local_dirs[context.applicationId]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/tidemill/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared folder and read them back.

    This cuts the lineage: later reads see the same rows even when executors are lost, and each reads only
    the columns it needs.
    """
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def require_columns(df: DataFrame, names) -> None:
    """Raise ``ValueError`` for the first name the frame lacks."""
    for name in names:
        if name not in df.columns:
            raise ValueError(f"Column '{name}' not found in data")
