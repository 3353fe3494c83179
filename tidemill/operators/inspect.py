"""Type inference, profiles and previews."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.conversion import DATE_FORMATS, fits_format, has_time, to_double
from tidemill.functions.predicates import is_missing
from tidemill.functions.quoting import named
from tidemill.operators.columns import sanitize_name

# Texts with a boolean meaning, and the ranges of the whole-number types.
BOOLEAN_TEXTS = ("true", "false", "True", "False", "TRUE", "FALSE")
WHOLE_LIMITS = (("SMALLINT", 2**15), ("INTEGER", 2**31), ("BIGINT", 2**63))
MAX_VARCHAR = 255
COLUMNS_PER_JOB = 100


@dataclass(frozen=True)
class InferredType:
    """SQL type of a column, the date format that fits all of its values, and the type to load when it differs."""

    sql_type: str
    date_format: str | None = None
    wide: bool = False

    @property
    def load_type(self) -> str:
        """Numbers of more digits than a decimal holds are loaded as text."""
        return "TEXT" if self.wide else self.sql_type


def _present(df: DataFrame, column: str) -> Column:
    return F.when(~is_missing(df, column), named(column))


def _date_mask(text: Column) -> Column:
    """Bit set of the known date formats a text fits; bits above them stand for ISO date-times."""
    def fits(separator: str, timed: bool) -> Column:
        bits = [F.when(fits_format(text, i), 1 << i).otherwise(0) for i, (_, sep, _) in enumerate(DATE_FORMATS)
                if sep == separator and has_time(i) == timed]
        return reduce(lambda a, b: a + b, bits)

    dash = text.contains("-")
    timed = F.when(dash, fits("-", True)).otherwise(fits("/", True))
    dated = F.when(dash, fits("-", False)).otherwise(fits("/", False))
    known = F.when(text.contains(":"), timed).otherwise(dated)
    iso = F.when(text.try_cast("timestamp_ntz").isNotNull(), _ISO_BIT).otherwise(0)
    # one cheap test decides whether any format can fit
    return F.when(text.rlike(_DATE_LIKE), known).when(text.rlike(_ISO_LIKE), iso).otherwise(0)


_DATE_LIKE = r"^\d{1,4}[-/]\d{1,2}[-/]\d{1,4}( \d{1,2}:\d{1,2}:\d{1,2})?$"
_ISO_LIKE = r"^\d{4}-\d{2}-\d{2}T"
_ISO_BIT = 1 << len(DATE_FORMATS)
# doubles beyond this bound lose digits, so such numbers are also compared as decimals
_EXACT_BOUND = 2.0**52


def _text_counters(cells: DataFrame) -> DataFrame:
    """Counters per text column. ``cells`` has one row per cell (place, text), so the generated code stays
    small however many columns there are, and each text is parsed once for all of its counters."""
    text, number = F.col("text"), F.col("number")
    exact = F.when(F.abs(number) >= _EXACT_BOUND, text.try_cast("decimal(38,0)"))
    parsed = cells.filter(text.isNotNull()).withColumns({"number": to_double(text), "dates": _date_mask(text)})
    return parsed.groupBy("place").agg(
        F.count(text).alias("present"), F.count_if(text.isin(*BOOLEAN_TEXTS)).alias("bool"),
        F.count(number).alias("number"),
        F.count_if((F.abs(number) >= _EXACT_BOUND) | (number == F.floor(number))).alias("whole"),
        F.count_if(number.isin(0.0, 1.0)).alias("binary"), F.min(number).alias("low"), F.max(number).alias("high"),
        F.min(exact).alias("exact_low"), F.max(exact).alias("exact_high"), F.max(F.length(text)).alias("length"),
        F.bit_and("dates").alias("dates"),
    )


def _typed_counters(kind: T.DataType, col: Column) -> dict[str, Column]:
    counters = {"present": F.count(col)}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        counters["timed"] = F.count_if(col != F.date_trunc("day", col))
    elif isinstance(kind, T.NumericType):
        counters |= {
            "binary": F.count_if(col.isin(0, 1)), "low": F.min(col), "high": F.max(col),
            "whole": F.count_if(col == F.floor(col)),
        }
    return counters


def _whole_type(low, high) -> str:
    for name, limit in WHOLE_LIMITS:
        if low >= -limit and high < limit:
            return name
    return "NUMERIC"


def _decide_text(v: Mapping, numeric_text: bool) -> InferredType:
    n = v["present"]
    if n == 0:
        return InferredType("TEXT")
    if v["bool"] == n:
        return InferredType("BOOLEAN")
    if numeric_text and v["number"] == n and v["binary"] == n:
        return InferredType("BOOLEAN")
    for i, (fmt, _, _) in enumerate(DATE_FORMATS):
        if v["dates"] & (1 << i):
            return InferredType("TIMESTAMP" if has_time(i) else "DATE", fmt)
    if v["dates"] & _ISO_BIT:
        return InferredType("TIMESTAMP")
    if v["number"] == n:
        if v["whole"] != n:
            return InferredType("DOUBLE PRECISION")
        low, high = v["low"], v["high"]
        if abs(low) >= 1e38 or abs(high) >= 1e38:
            return InferredType("NUMERIC", wide=True)
        if abs(low) >= _EXACT_BOUND:
            low = v["exact_low"]
        if abs(high) >= _EXACT_BOUND:
            high = v["exact_high"]
        return InferredType(_whole_type(low, high))
    if v["length"] <= MAX_VARCHAR:
        return InferredType(f"VARCHAR({min(v['length'] * 2, MAX_VARCHAR)})")
    return InferredType("TEXT")


def _decide_typed(kind: T.DataType, v: Mapping) -> InferredType:
    if isinstance(kind, T.BooleanType):
        return InferredType("BOOLEAN" if v["present"] else "TEXT")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType, T.VariantType)):
        return InferredType("JSONB")
    if isinstance(kind, T.BinaryType):
        return InferredType("BLOB")
    if v["present"] == 0:
        return InferredType("TEXT")
    if isinstance(kind, T.DateType):
        return InferredType("DATE")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return InferredType("TIMESTAMP" if v["timed"] else "DATE")
    if v["binary"] == v["present"]:
        return InferredType("BOOLEAN")
    if v["whole"] == v["present"]:
        return InferredType(_whole_type(v["low"], v["high"]))
    return InferredType("DOUBLE PRECISION")


def infer_types(
    df: DataFrame, numeric_text: bool = True, sample_fraction: float | None = None
) -> dict[str, InferredType]:
    """SQL type of every column: one aggregate for all text columns, one per 100 typed columns.

    ``numeric_text`` treats number texts as numbers, as a file import does.
    """
    source = df.sample(fraction=sample_fraction, seed=17) if sample_fraction else df
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    typed = [f for f in df.schema.fields if not isinstance(f.dataType, T.StringType)]
    out: dict[str, InferredType] = {}
    if texts:
        cells = source.select(F.posexplode(F.array(*[_present(df, c) for c in texts])).alias("place", "text"))
        found = {r["place"]: r.asDict() for r in _text_counters(cells).collect()}
        out |= {c: _decide_text(found.get(i, {"present": 0}), numeric_text) for i, c in enumerate(texts)}
    for start in range(0, len(typed), COLUMNS_PER_JOB):
        batch = typed[start:start + COLUMNS_PER_JOB]
        counters = [_typed_counters(f.dataType, _present(df, f.name)) for f in batch]
        row = source.agg(*[c.alias(f"{i}_{k}") for i, of in enumerate(counters) for k, c in of.items()]).first()
        for i, f in enumerate(batch):
            out[f.name] = _decide_typed(f.dataType, {k: row[f"{i}_{k}"] for k in counters[i]})
    return {c: out[c] for c in df.columns}


def _per_value(df: DataFrame) -> DataFrame:
    """``(place, value, n)``: how often each column holds each value, as text; nulls are counted too.

    Cells are unpivoted and counted before anything else, so a frequent value is one row after the map side and no task
    holds the values of a column. The place stands for the column's name, which would be moved with each value.
    """
    cells = F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), _as_text(df, c).alias("value")) for i, c in enumerate(df.columns)
    ]))
    return df.select(cells.alias("cell")).select("cell.*").groupBy("place", "value").agg(F.count(F.lit(1)).alias("n"))


def _statistics(per_value: DataFrame) -> DataFrame:
    return per_value.groupBy("place").agg(
        F.count(F.col("value")).alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
    )


def column_statistics(df: DataFrame) -> DataFrame:
    """Per column: null count and number of distinct non-null values."""
    name = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("place") + 1)
    return _statistics(_per_value(df)).select("place", name.alias("column_name"), "distinct_values", "null_count")


def _as_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    present = _present(df, column)
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(present)
    return present.cast("string")


def _examples(per_value: DataFrame, count: int) -> DataFrame:
    """``(place, sample_values)``: up to ``count`` values per column, the same ones however the rows are partitioned.

    These are the values with the smallest hashes, and where a column has fewer different ones, these again, as often as
    rows hold them. The rank limit works in each task before the shuffle, so a column moves ``count`` rows per task.
    """
    mark = F.xxhash64("value")
    rank = F.row_number().over(Window.partitionBy("place").orderBy(mark, "value"))
    few = per_value.filter(F.col("value").isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= count)
    found = few.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("found"))
    again = F.flatten(F.transform("found", lambda v: F.array_repeat(v["value"], F.least(v["n"] - 1, F.lit(count)).cast("int"))))
    return found.select("place", F.slice(F.concat(F.col("found.value"), again), 1, count).alias("sample_values"))


def samples(df: DataFrame, count: int = 5) -> dict[str, list[str]]:
    """Up to ``count`` non-null values per column as text, from one aggregate over all rows."""
    found = {r["place"]: list(r["sample_values"]) for r in _examples(_per_value(df), count).collect()}
    return {c: found.get(i, []) for i, c in enumerate(df.columns)}


def column_preview(df: DataFrame, numeric_text: bool = True, sample_count: int = 5) -> DataFrame:
    """Per column: clean and original name, suggested type, nullability, distinct values, nulls, sample values.

    A null counts as one distinct value here.
    """
    types = infer_types(df, numeric_text)

    def by_place(values) -> Column:
        return F.element_at(F.array(*[F.lit(values(c)) for c in df.columns]), F.col("place") + 1)

    nulls, per_value = F.col("null_count"), _per_value(df)
    # both sides have one row per column and read the same counts
    found = _statistics(per_value).join(_examples(per_value, sample_count), "place", "left")
    return found.select(
        by_place(sanitize_name).alias("name"), by_place(str).alias("original_name"),
        by_place(lambda c: types[c].sql_type).alias("suggested_type"), (nulls > 0).alias("nullable"),
        (F.col("distinct_values") + F.when(nulls > 0, 1).otherwise(0)).alias("unique_values"),
        nulls.alias("null_count"), F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def source_preview(df: DataFrame, limit: int = 100) -> dict:
    """First rows of a source and what they hold, as a report of bounded size."""
    head = df.limit(limit)
    rows = [r.asDict(recursive=True) for r in head.collect()]
    small = df.sparkSession.createDataFrame([tuple(r.values()) for r in rows], df.schema) if rows else df.limit(0)
    types = infer_types(small)
    stats = {r["column_name"]: r for r in column_statistics(small).collect()} if rows else {}
    columns = [
        {
            "name": f.name, "type": f.dataType.simpleString(), "sql_type": types[f.name].sql_type,
            "null_count": stats[f.name]["null_count"] if rows else 0,
            "unique_count": stats[f.name]["distinct_values"] if rows else 0,
        }
        for f in df.schema.fields
    ]
    return {"columns": columns, "sample_data": rows, "row_count": len(rows)}


def nested_arrays(schema: T.StructType) -> list[tuple[tuple[str, ...], int]]:
    """Paths of all arrays of objects that can be reached through objects, with their field counts."""

    def walk(fields, path):
        for f in fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, here)
            elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
                yield here, len(f.dataType.elementType.fields)

    return list(walk(schema.fields, ()))


def nested_array_inventory(df: DataFrame) -> DataFrame:
    """One row per array of objects: its path, number of records and number of fields."""
    found = nested_arrays(df.schema)
    empty = df.sparkSession.createDataFrame([], "path string, record_count long, field_count int")
    if not found:
        return empty

    def reach(path):
        col = named(path[0])
        for part in path[1:]:
            col = col.getField(part)
        return col

    sums = df.agg(*[
        F.coalesce(F.sum(F.when(reach(p).isNotNull(), F.size(reach(p)))), F.lit(0)).alias(f"s{i}")
        for i, (p, _) in enumerate(found)
    ])
    entries = F.array(*[
        F.struct(F.lit(".".join(p)).alias("path"), F.col(f"s{i}").cast("long").alias("record_count"),
                 F.lit(n).alias("field_count"))
        for i, (p, n) in enumerate(found)
    ])
    return sums.select(F.inline(entries))


def file_inventory(listing: DataFrame, sample_count: int = 5) -> DataFrame:
    """Files of a listing grouped by extension: count, total size, first keys.

    The rank filter is applied per partition before the shuffle, so a very common extension is no hot group.
    """
    last = F.element_at(F.split("path", "/"), -1)
    ext = F.when(last.contains("."), F.lower(F.element_at(F.split(last, r"\."), -1))).otherwise("no_extension")
    keyed = listing.withColumn("extension", ext)
    totals = keyed.groupBy("extension").agg(
        F.count(F.lit(1)).alias("file_count"), F.sum("length").alias("total_size")
    )
    first = Window.partitionBy("extension").orderBy("path")
    heads = (
        keyed.select("extension", "path").withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= sample_count)
        .groupBy("extension").agg(F.sort_array(F.collect_list("path")).alias("sample_files"))
    )
    return totals.join(heads, "extension")


def run_statistics(runs: DataFrame) -> DataFrame:
    """Per job: runs, successes, failures, success rate in percent, mean seconds, last start.

    ``runs`` has job_id, status, start_time and end_time.
    """
    ok = F.col("status").isin("success", "completed")
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp"))
               - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    return runs.groupBy("job_id").agg(
        F.count(F.lit(1)).alias("total_runs"), F.count_if(ok).alias("successful_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        (F.count_if(ok) * 100.0 / F.count(F.lit(1))).alias("success_rate"),
        F.avg(seconds).alias("average_duration"), F.max("start_time").alias("last_run"),
    )
