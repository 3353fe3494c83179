"""File sinks: folders of part files, written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _shaped(df: DataFrame, single_file: bool) -> DataFrame:
    return df.coalesce(1) if single_file else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False, **options) -> None:
    """CSV with a header. ``single_file`` funnels all rows through one task: for small exports only."""
    writer = _shaped(df, single_file).write.mode(mode).option("header", True).option("escape", '"')
    writer.options(**options).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """One JSON object per line; null fields are kept."""
    _shaped(df, single_file).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=()) -> None:
    """Parquet files, in folders per value of ``partition_by`` when given."""
    df.write.mode(mode).parquet(path, partitionBy=list(partition_by) or None)
