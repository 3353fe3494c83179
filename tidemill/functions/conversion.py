"""Type conversion that turns bad values into nulls (every cast is a ``try_`` form)."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.quoting import named

# Texts that count as true for a boolean conversion.
TRUE_TEXTS = ("true", "True", "TRUE", "1", "t", "T", "yes", "Yes", "YES")
# Texts with a boolean meaning when data is loaded.
LOAD_TRUE = ("true", "True", "TRUE", "1")
LOAD_FALSE = ("false", "False", "FALSE", "0")
# Strptime directive -> datetime pattern letters.
DATE_DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm",
    "%S": "ss", "%f": "SSSSSS", "%p": "a", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%z": "xx",
}
# DDL names that differ from Spark's own type names.
DDL_SYNONYMS = {
    "TEXT": "STRING", "TINYTEXT": "STRING", "MEDIUMTEXT": "STRING", "LONGTEXT": "STRING", "CLOB": "STRING",
    "UUID": "STRING", "TIME": "STRING", "VARCHAR": "STRING", "CHAR": "STRING", "CHARACTER VARYING": "STRING",
    "BLOB": "BINARY", "TINYBLOB": "BINARY", "MEDIUMBLOB": "BINARY", "LONGBLOB": "BINARY",
    "VARBINARY": "BINARY", "BYTEA": "BINARY", "DATETIME": "TIMESTAMP", "BIT": "BOOLEAN", "BOOL": "BOOLEAN",
    "JSON": "VARIANT", "JSONB": "VARIANT", "DOUBLE PRECISION": "DOUBLE", "FLOAT8": "DOUBLE",
    "REAL": "FLOAT", "FLOAT4": "FLOAT", "INT2": "SMALLINT", "INT4": "INT", "INT8": "BIGINT",
    "INTEGER": "INT", "MEDIUMINT": "INT", "YEAR": "INT", "SERIAL": "BIGINT", "BIGSERIAL": "BIGINT",
    "NUMERIC": "DECIMAL(38,0)", "DECIMAL": "DECIMAL(38,0)",
}
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)$"
WHOLE_TEXT = r"^\s*[+-]?\d+\s*$"


def datetime_pattern(fmt: str) -> str:
    """Spark pattern for a strptime format."""
    out, pos = [], 0
    for match in re.finditer(r"%[A-Za-z]|[A-Za-z]+|'", fmt):
        out.append(fmt[pos:match.start()])
        token = match.group()
        if token.startswith("%"):
            if token not in DATE_DIRECTIVES:
                raise ValueError(f"Unsupported date directive: {token}")
            out.append(DATE_DIRECTIVES[token])
        else:
            out.append("''" if token == "'" else f"'{token}'")
        pos = match.end()
    return "".join(out) + fmt[pos:]


def to_double(col: Column) -> Column:
    """Number, or null for any text that is not a plain number."""
    text = col.cast("string")
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def to_whole(col: Column, type_name: str = "bigint") -> Column:
    """Whole number, keeping all digits beyond 2^53; fractions and bad text become null."""
    text = col.cast("string")
    number = to_double(col)
    via_double = F.when(number == F.floor(number), number.try_cast(type_name))
    return F.when(text.rlike(WHOLE_TEXT), text.try_cast(type_name)).otherwise(via_double)


def to_timestamp(col: Column, fmt: str | None = None) -> Column:
    """Timestamp parsed with a strptime format, or by the known formats without one."""
    text = col.cast("string")
    if fmt is None:
        return loaded_timestamp(text)
    return F.try_to_timestamp(text, F.lit(datetime_pattern(fmt))).cast("timestamp_ntz")


def to_load_boolean(col: Column) -> Column:
    """Boolean for the known boolean texts and for the numbers one and zero in any spelling, otherwise null."""
    text, number = col.cast("string"), to_double(col)
    return F.when(text.isin(*LOAD_TRUE) | (number == 1), True).when(text.isin(*LOAD_FALSE) | (number == 0), False)


def check_default(kind: str, default: Any) -> None:
    """Refuse a default that is no number where a number is wanted, before any job runs."""
    kinds = {"integer": int, "int": int, "bigint": int, "float": float, "double": float, "number": float}
    if kind in kinds and not isinstance(default, Column):
        try:
            kinds[kind](default)
        except (TypeError, ValueError) as error:
            raise ValueError(f"The default {default!r} is no {kind}") from error


def converted(df: DataFrame, column: str, target_type: str, fmt: str | None = None, default: Any = None) -> Column:
    """Conversion of one column to integer, float, string, date, datetime, boolean, json or array."""
    col, text = named(column), named(column).cast("string")
    kind = str(target_type).lower()
    if kind in ("integer", "int", "bigint"):
        out = to_whole(col)
    elif kind in ("float", "double", "number"):
        out = to_double(col)
    elif kind in ("string", "text"):
        out = text
    elif kind == "date":
        out = to_timestamp(col, fmt).cast("date")
    elif kind in ("datetime", "timestamp"):
        out = to_timestamp(col, fmt)
    elif kind in ("boolean", "bool"):
        out = F.coalesce(text.isin(*TRUE_TEXTS), F.lit(False))
    elif kind == "json":
        out = F.try_parse_json(text)
    elif kind == "array":
        if isinstance(df.schema[column].dataType, T.ArrayType):
            out = col.try_cast("array<string>")
        else:
            out = F.from_json(text, "array<string>")
    else:
        raise ValueError(f"Unsupported target type: {target_type}")
    if default is None:
        return out
    check_default(kind, default)
    if kind == "json":
        return F.coalesce(out, F.try_parse_json(F.lit(str(default))))
    return F.coalesce(out, F.lit(default))


def spark_type_name(sql_type: str) -> str:
    """Spark DDL name of a relational type name."""
    name = re.sub(r"\s+", " ", sql_type.strip().upper())
    base = re.sub(r"\s*\(.*\)$", "", name)
    if base in ("NUMERIC", "DECIMAL") and "(" in name:
        return "DECIMAL" + name[name.index("("):]
    return DDL_SYNONYMS.get(base, base)


def loaded(col: Column, sql_type: str, boolean_default: bool | None = None) -> Column:
    """Cast of file text to a relational type as the data is loaded."""
    name = spark_type_name(sql_type)
    if name in ("SMALLINT", "INT", "BIGINT", "TINYINT"):
        return to_whole(col, name.lower())
    if name in ("DOUBLE", "FLOAT"):
        return to_double(col).cast(name.lower())
    if name == "BOOLEAN":
        if boolean_default is None:
            return to_load_boolean(col)
        text = col.cast("string")
        return F.when(text.isin(*LOAD_TRUE), True).when(text.isin(*LOAD_FALSE), False).otherwise(boolean_default)
    if name == "DATE":
        return loaded_timestamp(col).cast("date")
    if name in ("TIMESTAMP", "TIMESTAMP_NTZ"):
        return loaded_timestamp(col)
    if name == "VARIANT":
        return F.try_parse_json(col.cast("string"))
    if name == "STRING":
        return col.cast("string")
    return col.try_cast(name.lower())


# Date formats in the order they are tried, the separator of the date, and the places of year,
# month and day in the text.
DATE_FORMATS = (
    ("%Y-%m-%d", "-", (0, 1, 2)),
    ("%d/%m/%Y", "/", (2, 1, 0)),
    ("%m/%d/%Y", "/", (2, 0, 1)),
    ("%Y/%m/%d", "/", (0, 1, 2)),
    ("%Y-%m-%d %H:%M:%S", "-", (0, 1, 2)),
    ("%d/%m/%Y %H:%M:%S", "/", (2, 1, 0)),
    ("%m/%d/%Y %H:%M:%S", "/", (2, 0, 1)),
)


def has_time(index: int) -> bool:
    """Whether the ``index``-th known date format holds a time of day."""
    return "%H" in DATE_FORMATS[index][0]


# Month and day patterns of the calendar, and the years that have a 29 February.
_MONTH_DAYS = (
    (r"(?:0?[13578]|1[02])", r"(?:0?[1-9]|[12]\d|3[01])"),
    (r"(?:0?[469]|11)", r"(?:0?[1-9]|[12]\d|30)"),
    (r"0?2", r"(?:0?[1-9]|1\d|2[0-8])"),
)
_ANY_YEAR = r"(?!0000)\d{4}"
_LEAP_YEAR = r"(?!0000)(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)"
_TIME = r" (?:[01]?\d|2[0-3]):[0-5]?\d:[0-5]?\d"


def date_regex(index: int) -> str:
    """Regex of all real dates in the ``index``-th known format.

    One compact regex instead of a parse: a failing parse raises an exception per value inside.
    """
    _, separator, places = DATE_FORMATS[index]
    dates = [(_ANY_YEAR, month, day) for month, day in _MONTH_DAYS] + [(_LEAP_YEAR, "0?2", "29")]
    options = []
    for parts in dates:
        placed = {place: part for place, part in zip(places, parts, strict=True)}
        options.append(separator.join(placed[i] for i in range(3)))
    return f"^(?:{'|'.join(options)}){_TIME if has_time(index) else ''}$"


def fits_format(col: Column, index: int) -> Column:
    """Whether a text is a real date in the ``index``-th known format."""
    return F.coalesce(col.cast("string").rlike(date_regex(index)), F.lit(False))


def parsed_with(col: Column, index: int) -> Column:
    """Timestamp by the ``index``-th known date format, null when the text is no date in it."""
    text = col.cast("string")
    count = 6 if has_time(index) else 3
    pieces = F.split(text, "[-/ :]")
    parts = [F.get(pieces, F.lit(i)).try_cast("int") for i in [*DATE_FORMATS[index][2], 3, 4, 5][:count]]
    parts += [F.lit(0)] * (6 - count)
    return F.when(text.rlike(date_regex(index)), F.make_timestamp_ntz(*parts))


def loaded_timestamp(col: Column) -> Column:
    """Timestamp by the first known format that fits, else ISO text."""
    tries = [parsed_with(col, i) for i in range(len(DATE_FORMATS))]
    return F.coalesce(*tries, col.cast("string").try_cast("timestamp_ntz"))
