"""Table sinks: replace, append, fail, upsert.

A table is a catalog table over a folder of Parquet files. Replacing or merging writes a new numbered folder beside the
old ones and then points the table at it, which is one change in the catalog. A failed write leaves the old table, and
a plan that reads the table it replaces never overwrites its own input. The last versions stay, so that running reads
end and ``restore_version`` can go back; older ones are removed. Without a location a table lives in its database's
folder in the warehouse.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.conversion import spark_type_name
from tidemill.functions.quoting import named
from tidemill.operators.columns import sanitize_name
from tidemill.operators.inspect import infer_types
from tidemill.session import materialize, require_columns
from tidemill.sinks import versions

#: Versions that stay when a table gets a new one, the new one included.
KEEP_VERSIONS = 3
_KEYS = "tidemill.keys"

SAVE_MODES = ("replace", "append", "fail", "upsert", "merge", "replace_rows")


def _quoted(table: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in table.split("."))


def location_of(spark: SparkSession, table: str) -> str:
    """Folder that the table points at."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {_quoted(table)}").filter("col_name = 'Location'").collect()
    return rows[0]["data_type"]


def base_of(spark: SparkSession, table: str, location: str | None = None) -> str:
    """Folder that holds the table's versions."""
    if location:
        return location.rstrip("/")
    if spark.catalog.tableExists(table):
        return location_of(spark, table).rsplit("/", 1)[0]
    *database, name = table.split(".")
    found = spark.catalog.getDatabase(database[-1] if database else spark.catalog.currentDatabase())
    return f"{found.locationUri.rstrip('/')}/{name.lower()}"


def _create(spark: SparkSession, table: str, folder: str, schema: T.StructType, properties: Mapping[str, str]) -> None:
    columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    marks = ", ".join(f"'{k}' = '{v}'" for k, v in properties.items())
    spark.sql(f"CREATE TABLE {_quoted(table)} ({columns}) USING parquet LOCATION '{folder}'" + (f" TBLPROPERTIES ({marks})" if marks else ""))


def _rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {_quoted(old)} RENAME TO {_quoted(new)}")


def _properties(spark: SparkSession, table: str) -> dict[str, str]:
    rows = spark.sql(f"SHOW TBLPROPERTIES {_quoted(table)}").collect()
    return {r["key"]: r["value"] for r in rows if r["key"].startswith("tidemill.")}


def _point_at(spark: SparkSession, table: str, folder: str, schema: T.StructType) -> None:
    """Make the table read ``folder``: one metadata change when the schema stays the same.

    With another schema a table of a new name is made first and the two change names; the old one goes last, and gets
    its name back if the change fails.
    """
    if not spark.catalog.tableExists(table):
        _create(spark, table, folder, schema, {})
        return
    old = spark.table(table).schema
    if [(f.name, f.dataType) for f in old.fields] == [(f.name, f.dataType) for f in schema.fields]:
        spark.sql(f"ALTER TABLE {_quoted(table)} SET LOCATION '{folder}'")
        spark.catalog.refreshTable(table)
        return
    mark = uuid.uuid4().hex[:12]
    new, aside = f"{table}__new_{mark}", f"{table}__old_{mark}"
    _create(spark, new, folder, schema, _properties(spark, table))
    _rename(spark, table, aside)
    try:
        _rename(spark, new, table)
    except Exception:
        _rename(spark, aside, table)
        spark.sql(f"DROP TABLE IF EXISTS {_quoted(new)}")
        raise
    spark.sql(f"DROP TABLE {_quoted(aside)}")


def write_version(df: DataFrame, base: str) -> str:
    """Rows as a new version below ``base``, which no table points at yet."""
    folder = versions.next_version(df.sparkSession, base)
    df.write.mode("errorifexists").parquet(folder)
    return folder


def publish(spark: SparkSession, table: str, folder: str, schema: T.StructType, keep_versions: int = KEEP_VERSIONS) -> None:
    """Point the table at a version that is written, then remove old ones."""
    _point_at(spark, table, folder, schema)
    versions.expire(spark, folder.rsplit("/", 1)[0], folder, keep_versions)


def table_versions(spark: SparkSession, table: str) -> list[str]:
    """Folders of the versions that stay, up to the one the table points at, oldest first."""
    current = location_of(spark, table)
    name = current.rsplit("/", 1)[1]
    return [v for v in versions.versions(spark, current.rsplit("/", 1)[0]) if v.rsplit("/", 1)[1] <= name]


def restore_version(spark: SparkSession, table: str, folder: str) -> None:
    """Point the table at one of its older versions."""
    if folder not in table_versions(spark, table):
        raise ValueError(f"'{folder}' is no version of table '{table}'")
    _point_at(spark, table, folder, spark.read.parquet(folder).schema)


def save_replace(df: DataFrame, table: str, location: str | None = None) -> None:
    """Table with exactly these rows; an older one is replaced."""
    spark = df.sparkSession
    publish(spark, table, write_version(df, base_of(spark, table, location)), df.schema)


def save_fail(df: DataFrame, table: str, location: str | None = None) -> None:
    """New table; an error when it exists."""
    if df.sparkSession.catalog.tableExists(table):
        raise ValueError(f"Table '{table}' already exists")
    save_replace(df, table, location)


def _aligned(df: DataFrame, target: T.StructType) -> DataFrame:
    """Columns in the target's order and types; columns the frame lacks are null."""
    return df.select(*[
        (named(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in target.fields
    ])


def _check_subset(df: DataFrame, target: DataFrame) -> None:
    extra = [c for c in df.columns if c not in target.columns]
    if extra:
        raise ValueError(f"Columns not in the target table: {', '.join(extra)}")


def save_append(df: DataFrame, table: str, location: str | None = None) -> None:
    """Add rows; their columns must exist in the table, columns they lack become null."""
    spark = df.sparkSession
    if not spark.catalog.tableExists(table):
        save_replace(df, table, location)
        return
    target = spark.table(table)
    _check_subset(df, target)
    _aligned(df, target.schema).write.insertInto(table)


def latest_rows(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Last row per key in ``order_by`` order: an aggregate with map-side combine, so hot keys are cheap."""
    require_columns(df, [*keys, *order_by])
    row = F.struct(*[named(c) for c in df.columns])
    newest = df.groupBy(*[named(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(row, F.struct(*[named(c) for c in order_by])).alias("__row")
    )
    return newest.select("__row.*")


def upserted(
    target: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str] = (),
    keep_missing: bool = True,
) -> DataFrame:
    """Target after an upsert: given columns are updated, new keys inserted; null keys match null keys.

    ``order_by`` decides which of several batch rows per key wins (the last); without it the batch must
    hold each key once. ``keep_missing=False`` sets columns the batch lacks to null (row replacement).
    """
    require_columns(batch, keys)
    _check_subset(batch, target)
    one = latest_rows(batch, keys, order_by) if order_by else batch
    marked = _aligned(one, target.schema).select(
        *[named(c).alias(f"__b_{c}") for c in target.columns], F.lit(True).alias("__hit")
    )
    same = reduce(lambda a, b: a & b, [named(k).eqNullSafe(named(f"__b_{k}")) for k in keys])
    hit = F.col("__hit").isNotNull()
    given = set(batch.columns)
    updated = target.join(marked, same, "left").select(*[
        F.when(hit, named(f"__b_{c}")).otherwise(named(c)).alias(c)
        if c in given or not keep_missing else named(c)
        for c in target.columns
    ])
    # only keys that the batch holds are shuffled; with a small batch the target stays where it is
    asked = marked.select(*[named(f"__b_{k}") for k in keys])
    known = target.select(*[named(k) for k in keys]).join(asked, same, "left_semi")
    known = known.select(*[named(k).alias(f"__t_{k}") for k in keys]).distinct()
    absent = reduce(lambda a, b: a & b, [named(k).eqNullSafe(named(f"__t_{k}")) for k in keys])
    inserted = _aligned(one, target.schema).join(known, absent, "left_anti")
    return updated.unionByName(inserted)


def set_keys(spark: SparkSession, table: str, keys: Sequence[str]) -> None:
    """Keep the key columns with the table, for upserts that name none."""
    require_columns(spark.table(table), keys)
    text = json.dumps(list(keys)).replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"ALTER TABLE {_quoted(table)} SET TBLPROPERTIES ('{_KEYS}' = '{text}')")


def table_keys(spark: SparkSession, table: str) -> list[str]:
    """The key columns kept with a table, none if it has none."""
    return json.loads(_properties(spark, table).get(_KEYS, "[]"))


def save_upsert(
    df: DataFrame,
    table: str,
    keys: Sequence[str] = (),
    order_by: Sequence[str] = (),
    location: str | None = None,
    keep_missing: bool = True,
) -> None:
    """Upsert into a table; without a table it is made, with its keys.

    Without ``keys`` those kept with the table count; a table that has none gets the rows appended. The batch is
    computed once and written to the shared folder, so that the check of its keys and the merge see the same rows.
    """
    spark = df.sparkSession
    exists = spark.catalog.tableExists(table)
    keys = list(keys) or (table_keys(spark, table) if exists else [])
    if not keys:
        save_append(df, table, location)
        return
    require_columns(df, keys)
    batch = materialize(latest_rows(df, keys, order_by) if order_by else df)
    if not order_by and batch.groupBy(*[named(k) for k in keys]).count().filter("count > 1").limit(1).count():
        raise ValueError("several batch rows share a key: order_by must say which one wins")
    if not exists:
        save_replace(batch, table, location)
        set_keys(spark, table, keys)
        return
    merged = upserted(spark.table(table), batch, keys, (), keep_missing)
    publish(spark, table, write_version(merged, base_of(spark, table, location)), merged.schema)
    if table_keys(spark, table) != keys:
        set_keys(spark, table, keys)


def save_replace_rows(df: DataFrame, table: str, keys: Sequence[str], order_by: Sequence[str] = (), **kw) -> None:
    """Upsert that replaces whole rows: columns the batch lacks become null."""
    save_upsert(df, table, keys, order_by, keep_missing=False, **kw)


save_merge = save_upsert


def save(df: DataFrame, table: str, mode: str = "replace", **options: Any) -> None:
    """Write with one of the load modes."""
    writers = {
        "replace": save_replace, "append": save_append, "fail": save_fail, "upsert": save_upsert,
        "merge": save_merge, "replace_rows": save_replace_rows,
    }
    if mode not in writers:
        raise ValueError(f"Unknown load mode: {mode}")
    writers[mode](df, table, **options)


def ddl_for(df: DataFrame, table: str, numeric_text: bool = True) -> str:
    """Relational ``CREATE TABLE`` text for the inferred types, with a generated id when there is no valid one."""
    types = infer_types(df, numeric_text)
    lines, has_id = [], False
    for column in df.columns:
        name, sql_type = sanitize_name(column), types[column].sql_type
        if name == "id":
            if sql_type in ("SMALLINT", "INTEGER", "BIGINT", "BOOLEAN", "DOUBLE PRECISION", "NUMERIC"):
                lines.append('"id" BIGINT PRIMARY KEY')
                has_id = True
                continue
            name = "id_original"
        lines.append(f'"{name}" {sql_type}')
    if not has_id:
        lines.insert(0, '"id" BIGSERIAL PRIMARY KEY')
    return f'CREATE TABLE IF NOT EXISTS "{table}" (\n    ' + ",\n    ".join(lines) + "\n)"


def create_table(spark: SparkSession, table: str, columns: Mapping[str, str], location: str | None = None) -> None:
    """Create an empty table from relational column types when it does not exist."""
    body = ", ".join(f"`{c}` {spark_type_name(t)}" for c, t in columns.items())
    folder = versions.next_version(spark, base_of(spark, table, location))
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_quoted(table)} ({body}) USING parquet LOCATION '{folder}'")
