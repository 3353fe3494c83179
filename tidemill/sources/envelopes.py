"""Reshaping of messages, API responses, search hits, key-value dumps and change events."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.quoting import named
from tidemill.operators.columns import united

# Where API responses keep their records and their totals.
RECORD_FIELDS = ("data", "results", "items", "records")
TOTAL_FIELDS = ("total", "count", "total_count")
# Operations of document and row-image changes.
WHOLE_DOCUMENT_OPS = ("insert", "replace")


def parse_payload(col: Column) -> Column:
    """Message value: parsed JSON when it is JSON, else the raw text; null stays null."""
    return F.coalesce(F.try_parse_json(col), col.cast("variant"))


def payload_text(col: Column) -> Column:
    """Message value as text: compact JSON when it is JSON, else the raw text."""
    return F.coalesce(F.to_json(F.try_parse_json(col)), col)


def flatten_envelope(
    df: DataFrame, payload: str, fields: str | T.StructType, prefix: str | None = None
) -> DataFrame:
    """Keep the envelope columns and add ``<prefix><k>`` for each declared top-level payload key.

    A payload that is no JSON object gives nulls and stays readable as ``<payload>``.
    """
    prefix = f"{payload}_" if prefix is None else prefix
    schema = T.StructType.fromDDL(fields) if isinstance(fields, str) else fields
    parsed = F.from_json(named(payload).cast("string"), schema)
    envelope = [named(c) for c in df.columns]
    flat = df.select(*envelope, parsed.alias("__p"))
    return flat.select(*envelope, *[F.col("__p").getField(f.name).alias(prefix + f.name) for f in schema.fields])


def payload_keys(df: DataFrame, payload: str) -> DataFrame:
    """Top-level keys that occur in the payloads, with their row counts: the input of a field list."""
    keys = F.explode(F.json_object_keys(named(payload).cast("string")))
    return df.select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def flatten_discovered(df: DataFrame, payload: str, max_keys: int | None = None, prefix: str | None = None) -> DataFrame:
    """``flatten_envelope`` with every key found in the data, as text columns; ``max_keys`` is a wish of the caller."""
    found = [r["key"] for r in payload_keys(df, payload).select("key").collect()]
    if max_keys is not None and len(found) > max_keys:
        raise ValueError(f"more than {max_keys} payload keys: declare the fields instead")
    fields = T.StructType([T.StructField(k, T.StringType()) for k in sorted(found)])
    return flatten_envelope(df, payload, fields, prefix) if found else df


def _arrays(df: DataFrame) -> list[str]:
    return [c for c in RECORD_FIELDS if c in df.columns and isinstance(df.schema[c].dataType, T.ArrayType)]


def unwrap_response(df: DataFrame) -> DataFrame:
    """Records under the first of data, results, items, records that a response has; without any it is one row itself.

    Fields whose records differ in type are unpacked each by its own type and united by name; columns of equal name
    but different type meet as text. Totals alone make no row.
    """
    arrays = _arrays(df)
    if not arrays:
        return df
    first = F.coalesce(*[F.when(named(c).isNotNull(), F.lit(c)) for c in arrays])
    by_kind: dict[str, list[str]] = {}
    for c in arrays:
        by_kind.setdefault(df.schema[c].dataType.elementType.simpleString(), []).append(c)
    frames = []
    for fields in by_kind.values():
        rows = df.where(first.isin(*fields)).select(F.coalesce(*[F.when(first == c, named(c)) for c in fields]).alias("__r"))
        record = df.schema[fields[0]].dataType.elementType
        frames.append(rows.select(F.inline("__r")) if isinstance(record, T.StructType) else rows.select(F.explode("__r").alias("value")))
    bare = [c for c in df.columns if c not in arrays]
    if bare:
        own = [c for c in bare if c not in TOTAL_FIELDS]
        if own:
            present = F.coalesce(*[F.when(named(c).isNotNull(), True) for c in own], F.lit(False))
            frames.append(df.where(first.isNull() & present).select(*[named(c) for c in bare]))
    return united(frames)


def response_total(df: DataFrame) -> DataFrame:
    """Total the response states, else the size of its first record array."""
    stated = [named(c).try_cast("long") for c in TOTAL_FIELDS if c in df.columns]
    sizes = [F.when(named(c).isNotNull(), F.size(named(c))).cast("long") for c in _arrays(df)]
    parts = [*stated, *sizes] or [F.lit(1)]
    return df.select(F.coalesce(*parts).alias("total"))


def document_hits(df: DataFrame, hits: str = "hits.hits") -> DataFrame:
    """Search hits as rows: source fields plus id, score and index."""
    if hits:
        df = df.select(F.inline(F.col(hits)))
    meta = [named(c) for c in ("_id", "_score", "_index") if c in df.columns]
    return df.select("_source.*", *meta)


def _stringify(col: Column, kind: T.DataType) -> tuple[Column, bool]:
    if isinstance(kind, T.StructType):
        if kind.fieldNames() == ["$oid"]:
            return col.getField("$oid").cast("string"), True
        parts = [(f.name, *_stringify(col.getField(f.name), f.dataType)) for f in kind.fields]
        if not any(changed for _, _, changed in parts):
            return col, False
        return F.when(col.isNotNull(), F.struct(*[c.alias(n) for n, c, _ in parts])), True
    if isinstance(kind, T.ArrayType):
        _, changed = _stringify(F.lit(None).cast(kind.elementType), kind.elementType)
        if not changed:
            return col, False
        return F.transform(col, lambda e: _stringify(e, kind.elementType)[0]), True
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(col)), True
    return col, False


def stringify_ids(df: DataFrame) -> DataFrame:
    """Object ids (``{"$oid": ...}`` or binary), also inside objects and arrays, become text."""
    return df.select(*[_stringify(named(f.name), f.dataType)[0].alias(f.name) for f in df.schema.fields])


def value_size(col: Column) -> Column:
    """Length of a value's text form; 0 for null and empty values."""
    return F.coalesce(F.length(col.cast("string")), F.lit(0))


def _exploded(df: DataFrame, value: str, generator: Column, names: Sequence[str], kind: str) -> DataFrame:
    kept = [named(c) for c in df.columns if c != value]
    out = df.select(*kept, generator.alias(*names))
    return out.withColumns({"type": F.lit(kind), "size": value_size(F.col("value"))})


def explode_string(df: DataFrame, value: str = "value") -> DataFrame:
    """Plain values: one row each."""
    return df.withColumnRenamed(value, "value").withColumns(
        {"type": F.lit("string"), "size": value_size(F.col("value"))}
    )


def explode_hash(df: DataFrame, value: str = "value") -> DataFrame:
    """Map values: one row per field."""
    return _exploded(df, value, F.explode(named(value)), ["field", "value"], "hash")


def explode_list(df: DataFrame, value: str = "value") -> DataFrame:
    """List values: one row per element with its position from 0."""
    return _exploded(df, value, F.posexplode(named(value)), ["index", "value"], "list")


def explode_set(df: DataFrame, value: str = "value") -> DataFrame:
    """Set values: one row per distinct member."""
    return _exploded(df, value, F.explode(F.array_distinct(named(value))), ["value"], "set")


def explode_zset(df: DataFrame, value: str = "value") -> DataFrame:
    """Scored sets (arrays of value and score): one row per member."""
    kept = [named(c) for c in df.columns if c != value]
    out = df.select(*kept, F.inline(named(value)))
    return out.withColumns({"type": F.lit("zset"), "size": value_size(F.col("value"))})


def dump_rows(df: DataFrame, columns: Mapping[str, str] | None = None) -> DataFrame:
    """A key-value dump of mixed types as one frame: ``(key, type, field, index, value, score, ttl, size)``.

    ``df`` has ``key``, ``type``, ``ttl`` and a value column for each type, named like it or as ``columns`` says:
    ``string`` text, ``hash`` map, ``list`` and ``set`` arrays, ``zset`` array of value and score. A string gives one row, also
    if it is null; the others one row per field, element, distinct member or scored member, none if they are empty. Keys
    of another type give no row. All kinds are opened in one pass.
    """
    place = {k: named((columns or {}).get(k, k)) for k in ("string", "hash", "list", "set", "zset")}

    def entry(field=None, index=None, value=None, score=None) -> Column:
        given = {"field": (field, "string"), "index": (index, "int"), "value": (value, "string"), "score": (score, "double")}
        return F.struct(*[(F.lit(None) if v is None else v).cast(t).alias(k) for k, (v, t) in given.items()])

    opened = {
        "string": F.array(entry(value=place["string"])),
        "hash": F.transform(F.map_entries(place["hash"]), lambda e: entry(field=e["key"], value=e["value"])),
        "list": F.transform(place["list"], lambda v, i: entry(index=i, value=v)),
        "set": F.transform(F.array_distinct(place["set"]), lambda v: entry(value=v)),
        "zset": F.transform(place["zset"], lambda e: entry(value=e["value"], score=e["score"])),
    }
    entries = F.lit(None)
    for kind, rows in opened.items():
        entries = F.when(named("type") == kind, rows).otherwise(entries)
    out = df.select("key", "type", F.inline(entries), "ttl")
    return out.select("key", "type", "field", "index", "value", "score", "ttl", value_size(F.col("value")).alias("size"))


def _as_kind(value: Column, given: T.DataType, kind: T.DataType) -> Column:
    """An updated value as the type of its document field, null where it does not fit."""
    if given == kind:
        return value
    if isinstance(given, T.VariantType):
        return F.try_variant_get(value, "$", kind.simpleString())
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(value.cast("string"), kind)
    return value.try_cast(kind)


def change_event_document(df: DataFrame, key: str = "_id", rest: str = "_updated_fields") -> DataFrame:
    """Document changes as rows: whole document, updated fields only, or key only; other kinds are dropped.

    Input has operationType, fullDocument, documentKey, updateDescription.updatedFields (a map of texts, variants or
    other values, or a struct) and clusterTime. Fields keep the document's types, object ids become text. ``rest`` maps
    the updated fields that no column shows: names the document lacks, values of other type, and fields set to null.
    """
    doc = df.schema["fullDocument"].dataType
    op = F.col("operationType")
    updated = F.col("updateDescription").getField("updatedFields")
    changes = df.schema["updateDescription"].dataType["updatedFields"].dataType
    if isinstance(changes, T.StructType):
        changes = T.MapType(T.StringType(), T.VariantType())
        updated = F.from_json(F.to_json(updated), changes)
    columns, shown = [], [F.lit(None).cast("string")]
    for field in doc.fields:
        if field.name == key:
            continue
        f, kind, value = field.name, field.dataType, updated[field.name]
        if isinstance(kind, T.BinaryType) and not isinstance(changes.valueType, T.BinaryType):
            value = _as_kind(value, changes.valueType, T.StringType())  # an id, given as text
        else:
            value = _stringify(_as_kind(value, changes.valueType, kind), kind)[0]
        whole = _stringify(F.col("fullDocument").getField(f), kind)[0]
        columns.append(F.when(op.isin(*WHOLE_DOCUMENT_OPS), whole).when(op == "update", value).alias(f))
        shown.append(F.when(value.isNotNull(), F.lit(f)))
    names = F.filter(F.array(*shown), lambda name: name.isNotNull())
    hidden = F.map_filter(updated, lambda name, _: ~F.array_contains(names, name))
    object_key = next(f.dataType for f in df.schema["documentKey"].dataType.fields if f.name == key)
    return df.filter(op.isin(*WHOLE_DOCUMENT_OPS, "update", "delete")).select(
        _stringify(F.col("documentKey").getField(key), object_key)[0].alias(key), *columns,
        F.when((op == "update") & (F.size(hidden) > 0), hidden).alias(rest),
        op.alias("_change_operation"), F.col("clusterTime").alias("_change_timestamp"),
    )


def change_event_rows(df: DataFrame) -> DataFrame:
    """Row-image changes as rows: new values, the values before an update as JSON text, and log position.

    Input has op, ts, table, values, before_values, after_values (same struct), log_file and log_pos.
    """
    op = F.col("op")
    image = F.when(op == "update", F.col("after_values")).otherwise(F.col("values"))
    names = df.schema["values"].dataType.fieldNames()
    return df.filter(op.isin("insert", "update", "delete")).select(
        *[image.getField(n).alias(n) for n in names],
        F.when(op == "update", F.to_json("before_values")).alias("_before_values"),
        op.alias("_change_operation"), F.col("ts").alias("_change_timestamp"),
        F.col("table").alias("_table_name"), F.col("log_file").alias("_log_file"), F.col("log_pos").alias("_log_pos"),
    )
