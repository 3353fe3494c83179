"""Column steps: rename, drop, mapping, split, merge, names, ids and defaults."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.conversion import to_whole
from tidemill.functions.quoting import named
from tidemill.operators.ordering import dense_ids
from tidemill.session import require_columns


def rename(df: DataFrame, rename_map: Mapping[str, str]) -> DataFrame:
    """Rename columns; every old name must exist."""
    require_columns(df, rename_map)
    return df.withColumnsRenamed(dict(rename_map))


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; every name must exist."""
    require_columns(df, columns)
    return df.drop(*columns)


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep the listed columns in the given order."""
    require_columns(df, columns)
    return df.select(*[named(c) for c in columns])


def apply_column_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by ``mapping`` and keep only mapped columns."""
    return df.select(*[named(c).alias(mapping[c]) for c in df.columns if c in mapping])


def positional_mapping(file_columns: Sequence[str], target_columns: Sequence[str]) -> dict[str, str]:
    """Pair file columns with target columns by place; file columns beyond the targets pair by their clean name.

    A file column ``id`` pairs with ``id_original`` if the target has that and no ``id``. What fits nothing is left out.
    """
    targets = list(target_columns)
    clean = {c: sanitize_name(c) for c in file_columns}
    by_name = {c: n for c, n in clean.items() if n in targets}
    by_place = dict(zip(file_columns, targets, strict=False))
    moved = {} if "id" in targets or "id_original" not in targets else {c: "id_original" for c, n in clean.items() if n == "id"}
    chosen = by_name | by_place | moved
    return {c: chosen[c] for c in file_columns if c in chosen}


def sanitize_name(name: str) -> str:
    """Lower-case name of letters, digits and underscores that is safe in SQL."""
    text = re.sub(r"[ .-]", "_", str(name).strip().lower())
    text = "".join(ch for ch in text if ch == "_" or ch.isalnum())
    if not text:
        return "unnamed_column"
    return f"col_{text}" if text[0].isdigit() else text


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Sanitise all column names; names that would clash get ``_2``, ``_3`` ..."""
    used: dict[str, int] = {}
    names = []
    for c in df.columns:
        name = sanitize_name(c)
        used[name] = used.get(name, 0) + 1
        names.append(name if used[name] == 1 else f"{name}_{used[name]}")
    return df.toDF(*names)


def split_column(
    df: DataFrame,
    column: str,
    new_columns: Sequence[str],
    delimiter: str | None = None,
    pattern: str | None = None,
    keep_original: bool = False,
) -> DataFrame:
    """Split a text column by a delimiter or by the groups of a regex; missing parts are null.

    A one-character delimiter is literal, a longer one is a regex.
    """
    require_columns(df, [column])
    text = named(column).cast("string")
    if delimiter:
        regex = re.escape(delimiter) if len(delimiter) == 1 else delimiter
        parts = F.split(text, regex, len(new_columns))
        values = {name: F.get(parts, F.lit(i)) for i, name in enumerate(new_columns)}
    elif pattern:
        groups = re.compile(pattern).groups
        values = {
            name: F.when(text.rlike(pattern), F.regexp_extract(text, pattern, i + 1))
            if i < groups else F.lit(None).cast("string")
            for i, name in enumerate(new_columns)
        }
    else:
        raise ValueError("Either delimiter or pattern must be specified for column split")
    out = df.withColumns(values)
    return out if keep_original or column in new_columns else out.drop(column)


def merge_columns(
    df: DataFrame, columns: Sequence[str], new_column: str, separator: str = " ", drop_original: bool = False
) -> DataFrame:
    """Join columns as text; nulls are skipped."""
    require_columns(df, columns)
    out = df.withColumn(new_column, F.concat_ws(separator, *[named(c).cast("string") for c in columns]))
    return out.drop(*[c for c in columns if c != new_column]) if drop_original else out


def add_metadata(df: DataFrame, operation: str, timestamp=None) -> DataFrame:
    """Add when and by which operation the rows were synchronised."""
    when = F.current_timestamp() if timestamp is None else F.lit(timestamp)
    return df.withColumns({"_sync_timestamp": when, "_sync_operation": F.lit(operation)})


def add_surrogate_id(df: DataFrame, order_by: Sequence[str] | None = None, start: int = 1) -> DataFrame:
    """Numeric ``id`` column: kept as BIGINT when all its values are whole numbers of that range, else generated.

    Any other ``id`` is kept as ``id_original``, so that no value is lost; generated ids follow ``order_by`` and have no
    gaps. Ids that are kept may repeat or be null: ``id_report`` counts such rows.
    """
    if "id" in df.columns:
        other = named("id").isNotNull() & to_whole(named("id")).isNull()
        if df.agg(F.count_if(other)).first()[0] == 0:
            return df.withColumn("id", to_whole(named("id")))
        df = df.withColumnRenamed("id", "id_original")
    if not order_by:
        raise ValueError("order_by is required to generate ids: rows have no order of their own")
    order = ["id_original" if c == "id" else c for c in order_by]
    return dense_ids(df, order, "id", start)


def id_report(df: DataFrame, column: str = "id") -> DataFrame:
    """One row: rows, null ids, ids that are no whole number of 64 bits, and rows beyond the first of their id."""
    require_columns(df, [column])
    other = named(column).isNotNull() & to_whole(named(column)).isNull()
    per_id = df.groupBy(named(column).alias("v"), other.alias("other")).agg(F.count(F.lit(1)).alias("n"))
    known = F.col("v").isNotNull()

    def total(value, keep):
        return F.coalesce(F.sum(F.when(keep, value)), F.lit(0))

    return per_id.agg(
        total(F.col("n"), F.lit(True)).alias("rows"), total(F.col("n"), ~known).alias("null_ids"),
        total(F.col("n"), F.col("other")).alias("other_ids"), total(F.col("n") - 1, known).alias("repeated_ids"))


def with_defaults(df: DataFrame, column_configs: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Fill nulls of configured columns with their default value, cast to the column's type."""
    require_columns(df, [c["name"] for c in column_configs])
    values = {}
    for config in column_configs:
        if config.get("default_value") is None:
            continue
        name = config["name"]
        kind = df.schema[name].dataType
        values[name] = F.coalesce(named(name), F.lit(config["default_value"]).cast(kind))
    return df.withColumns(values) if values else df


def constraint_rules(column_configs: Sequence[Mapping[str, Any]]) -> list:
    """Quality rules equal to the nullable, unique and primary-key settings of a column config."""
    from tidemill.operators.quality import not_null, unique

    rules = []
    for config in column_configs:
        key = bool(config.get("primary_key"))
        if key or config.get("nullable", True) is False:
            rules.append(not_null(config["name"]))
        if key or config.get("unique"):
            rules.append(unique(config["name"]))
    return rules


def flatten_struct(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested objects become columns named by their path; arrays stay as values."""

    def walk(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType) and field.dataType.fields:
                yield from walk(field.dataType, here)
            else:
                yield here

    def column(path: tuple[str, ...]):
        col = named(path[0])
        for part in path[1:]:
            col = col.getField(part)
        return col.alias(separator.join(path))

    return df.select(*[column(p) for p in walk(df.schema, ())])


def united(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames below each other, columns by name; columns of equal name but different type meet as text."""
    kinds: dict[str, set] = {}
    for df in frames:
        for f in df.schema.fields:
            kinds.setdefault(f.name, set()).add(f.dataType.simpleString())
    mixed = [c for c, found in kinds.items() if len(found) > 1]
    out = None
    for df in frames:
        aligned = df.withColumns({c: named(c).cast("string") for c in mixed if c in df.columns})
        out = aligned if out is None else out.unionByName(aligned, allowMissingColumns=True)
    return out
