"""Versions of a table: numbered folders beside each other, of which the catalog points at one."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_FACTS = "_facts"


def _path(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path, files = _path(spark, folder)
    return files.exists(path)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, in order."""
    path, files = _path(spark, pattern)
    return sorted(str(s.getPath()) for s in files.globStatus(path) or ())


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all it holds."""
    path, files = _path(spark, folder)
    files.delete(path, True)


def versions(spark: SparkSession, base: str) -> list[str]:
    """Folders of all versions below ``base``, oldest first; also such whose write never ended."""
    return matching(spark, f"{base}/v_*")


def next_version(spark: SparkSession, base: str) -> str:
    """A new folder, numbered after all others."""
    numbers = [int(name.split("_")[1]) for v in versions(spark, base) if (name := v.rsplit("/", 1)[1]).split("_")[1].isdigit()]
    return f"{base}/v_{max(numbers, default=0) + 1:010d}_{uuid.uuid4().hex[:12]}"


def write_facts(spark: SparkSession, folder: str, facts: Mapping[str, Any]) -> None:
    """Keep facts with a version: they hold from the moment the table points at it. Parquet readers skip the folder."""
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{folder}/{_FACTS}")


def read_facts(spark: SparkSession, folder: str) -> dict[str, Any]:
    """The facts of a version, none if it has none."""
    if not folder_exists(spark, f"{folder}/{_FACTS}"):
        return {}
    return json.loads(spark.read.text(f"{folder}/{_FACTS}").agg(F.max("value")).first()[0])


def expire(spark: SparkSession, base: str, current: str, keep: int) -> list[str]:
    """Delete versions older than the ``keep`` newest up to the current one; later ones are writes under way."""
    name = current.rstrip("/").rsplit("/", 1)[1]
    older = [v for v in versions(spark, base) if v.rsplit("/", 1)[1] <= name]
    gone = older[:-keep] if keep else []
    for folder in gone:
        remove(spark, folder)
    return gone
