"""Row steps: filters, cleaning, conversion, set operations, sort, page and search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.cleaning import cleaned
from tidemill.functions.conversion import DATE_FORMATS, NUMBER_TEXT, PLAIN_NUMBER, converted, loaded, parsed_with
from tidemill.functions.predicates import combine, rule_predicate
from tidemill.functions.quoting import named
from tidemill.operators.ordering import with_range_bucket
from tidemill.session import require_columns


def filter_rows(df: DataFrame, rules: Sequence[Mapping[str, Any]], logical_operator: str = "AND") -> DataFrame:
    """Rows that pass all (``AND``) or any (``OR``) of the rules; duplicates are kept."""
    return df.filter(combine([rule_predicate(df, r) for r in rules], logical_operator))


def clean(df: DataFrame, rules: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Apply cleaning rules ``{column, rule_type, parameters}`` in order."""
    require_columns(df, [r["column"] for r in rules])
    for rule in rules:
        df = df.withColumn(rule["column"], cleaned(named(rule["column"]), rule["rule_type"], rule.get("parameters")))
    return df


def convert(
    df: DataFrame, column: str, target_type: str, format: str | None = None, default_value: Any = None
) -> DataFrame:
    """Convert one column; bad values become null, then ``default_value``."""
    require_columns(df, [column])
    return df.withColumn(column, converted(df, column, target_type, format, default_value))


def cast_on_load(
    df: DataFrame, column_types: Mapping[str, str], date_formats: Mapping[str, str] | None = None
) -> DataFrame:
    """Cast text columns to their detected SQL types; values that do not fit become null."""
    formats = {f[0]: i for i, f in enumerate(DATE_FORMATS)}
    out = {}
    for column, sql_type in column_types.items():
        if column not in df.columns:
            continue
        fmt = (date_formats or {}).get(column)
        if fmt in formats and sql_type in ("DATE", "TIMESTAMP"):
            stamp = parsed_with(named(column), formats[fmt])
            out[column] = stamp.cast("date") if sql_type == "DATE" else stamp
        else:
            out[column] = loaded(named(column), sql_type)
    return df.withColumns(out) if out else df


def cast_to_ddl(df: DataFrame, column_types: Mapping[str, str]) -> DataFrame:
    """Cast to user-declared types; an unknown boolean text is false here.

    A NUMERIC without precision gets the scale that its values need (one job finds it). Where they need more than 38
    digits the column stays text, so that no number is rounded or lost; ``lost_cells`` counts what other casts lose.
    """
    open_ended = [c for c, t in column_types.items() if c in df.columns and t.strip().upper() in ("NUMERIC", "DECIMAL")]
    kinds = decimal_types(df, open_ended)
    out = {c: _decimal(named(c), kinds[c]) if c in kinds else loaded(named(c), t, boolean_default=False)
           for c, t in column_types.items() if c in df.columns}
    return df.withColumns(out) if out else df


def decimal_types(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """For each column the decimal type that holds all its plain numbers exactly, ``string`` if none does.

    Texts that are no number at all count for nothing; a number with an exponent keeps its column text.
    """
    if not columns:
        return {}
    facts = []
    for i, c in enumerate(columns):
        text = F.trim(named(c).cast("string"))
        plain, number = text.rlike(PLAIN_NUMBER), text.rlike(NUMBER_TEXT)
        whole = F.regexp_extract(text, r"^[+-]?0*(\d*)", 1)
        part = F.regexp_extract(text, r"\.(\d*?)0*$", 1)
        facts += [F.max(F.when(plain, F.length(whole))).alias(f"w{i}"), F.max(F.when(plain, F.length(part))).alias(f"s{i}"),
                  F.count_if(number & ~plain).alias(f"e{i}")]
    row = df.agg(*facts).first()
    out = {}
    for i, c in enumerate(columns):
        digits, scale = row[f"w{i}"] or 0, row[f"s{i}"] or 0
        out[c] = "string" if row[f"e{i}"] or digits + scale > 38 else f"decimal(38,{scale})"
    return out


def _decimal(col: Column, kind: str) -> Column:
    text = F.trim(col.cast("string"))
    return col.cast("string") if kind == "string" else F.when(text.rlike(PLAIN_NUMBER), text.try_cast(kind))


def lost_cells(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Per column the cells that hold a value in ``before`` but none in ``after``: one count of each frame."""
    old, new = (df.agg(*[F.count(named(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first() for df in (before, after))
    return {c: old[f"c{i}"] - new[f"c{i}"] for i, c in enumerate(columns)}


def preserve_big_integers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Numbers as exact decimals of the scale they need; columns that need more than 38 digits stay text.

    Texts that are no plain number become null, numbers never.
    """
    require_columns(df, columns)
    kinds = decimal_types(df, columns)
    return df.withColumns({c: _decimal(named(c), kinds[c]) for c in columns})


# Copies of one row that a single task writes; more are spread over tasks.
COPIES_PER_TASK = 1_000_000


def _copies(counted: DataFrame, columns: Sequence[str], per_task: int) -> DataFrame:
    """Each row ``__n`` times; a row with very many copies is cut into pieces that are spread over tasks."""
    def repeated(df: DataFrame) -> DataFrame:
        return df.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*columns)

    names = [named(c) for c in columns]
    pieces = F.sequence(F.lit(0), F.floor((F.col("__n") - 1) / per_task))
    many = counted.filter(F.col("__n") > per_task).select(*names, F.col("__n").alias("__all"), F.explode(pieces).alias("__p"))
    size = F.least(F.lit(per_task), F.col("__all") - F.col("__p") * per_task)
    spread = many.withColumn("__n", size).drop("__all").repartition(*names, "__p")
    return repeated(counted.filter(F.col("__n").between(1, per_task))).unionByName(repeated(spread))


def set_operation(
    frames: Sequence[DataFrame], kind: str, all_rows: bool = False, copies_per_task: int = COPIES_PER_TASK
) -> DataFrame:
    """UNION, INTERSECT or EXCEPT of frames with the same columns.

    Intersections and differences are one aggregate of row counts per side, combined before the shuffle, so
    a row with very many copies is no hot key.
    """
    word = kind.lower()
    if word not in ("union", "intersect", "except"):
        raise ValueError(f"Unknown set operation: {kind}")
    if word == "union":
        out = reduce(lambda a, b: a.unionByName(b), frames)
        return out if all_rows else out.distinct()
    columns = frames[0].columns

    def pair(a: DataFrame, b: DataFrame) -> DataFrame:
        sides = a.withColumn("__a", F.lit(1)).unionByName(
            b.select(*[named(c) for c in columns]).withColumn("__a", F.lit(0))
        )
        counted = sides.groupBy(*[named(c) for c in columns]).agg(
            F.sum("__a").alias("__left"), F.sum(1 - F.col("__a")).alias("__right")
        )
        left, right = F.col("__left"), F.col("__right")
        if not all_rows:
            keep = (left > 0) & ((right > 0) if word == "intersect" else (right == 0))
            return counted.filter(keep).select(*[named(c) for c in columns])
        copies = F.least(left, right) if word == "intersect" else left - right
        return _copies(counted.withColumn("__n", copies).drop("__left", "__right"), columns, copies_per_task)

    return reduce(pair, frames)


def _spread_ties(df: DataFrame, order: Sequence) -> DataFrame:
    """Ordered rows; rows with equal keys may lie in different sort partitions, so a frequent key is no hot one."""
    return df.withColumn("__tie", F.monotonically_increasing_id()).orderBy(*order, "__tie").drop("__tie")


def sort(df: DataFrame, column: str, direction: str = "ASC") -> DataFrame:
    """Order by one column."""
    require_columns(df, [column])
    col = named(column)
    return _spread_ties(df, [col.desc() if direction.upper() == "DESC" else col.asc()])


def page(
    df: DataFrame, order_by: Sequence[str | Column], page: int = 1, page_size: int = 25, with_total: bool = False,
    shallow: int = 10_000,
) -> DataFrame:
    """One page of the rows ordered by columns, ``-column`` for falling order; ``with_total`` adds the count of all rows.

    Ties are ordered by the whole row, so pages neither lose nor repeat rows. A page among the first ``shallow`` rows is
    read off a top-k. For a deeper one the rows are cut into ranges of the order, and the ranges' counts tell in which
    the page lies; only these are sorted. That takes one direction for all columns and, as ``order_by`` may hold any
    expressions, names; with others the page is always read off a top-k.
    """
    skip = (page - 1) * page_size
    whole = F.to_json(F.struct(*[named(c) for c in df.columns]))
    names, falling = _directions(df, order_by)
    if skip + page_size <= shallow or names is None:
        order = order_by if names is None else [named(c).desc() if d else named(c).asc() for c, d in zip(names, falling, strict=True)]
        out = df.orderBy(*order, whole.desc() if falling and all(falling) else whole).offset(skip).limit(page_size)
    else:
        out = _located_page(df.withColumn("__whole", whole), names, any(falling), skip, page_size).select(*[named(c) for c in df.columns])
    if not with_total:
        return out
    return out.withColumn("total_count", df.agg(F.count(F.lit(1))).scalar())


def _directions(df: DataFrame, order_by: Sequence[str | Column]) -> tuple[list[str] | None, list[bool]]:
    """Column names and whether each falls; no names if an entry is an expression or the directions differ."""
    names, falling = [], []
    for entry in order_by:
        if not isinstance(entry, str):
            return None, []
        down = entry not in df.columns and entry.startswith("-")
        names.append(entry[1:] if down else entry)
        falling.append(down)
    require_columns(df, names)
    return (names, falling) if len(set(falling)) <= 1 else (None, [])


def _located_page(df: DataFrame, names: Sequence[str], falling: bool, skip: int, size: int) -> DataFrame:
    keys = [*names, "__whole"]
    ranged = with_range_bucket(df, keys, "__bucket")
    # one row per range
    order = F.col("__bucket").desc() if falling else F.col("__bucket").asc()
    earlier = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n")).select(
        F.col("__bucket").alias("__at"), "__n", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__base"))
    holds = counts.where((F.col("__base") < skip + size) & (F.col("__base") + F.col("__n") > skip))
    near = ranged.join(F.broadcast(holds), F.col("__bucket") == F.col("__at"))
    inside = Window.partitionBy("__bucket").orderBy(*[named(c).desc() if falling else named(c).asc() for c in keys])
    place = near.withColumn("__place", F.col("__base") + F.row_number().over(inside))
    return place.where(F.col("__place").between(skip + 1, skip + size)).orderBy("__place")


def page_after(df: DataFrame, key: str, last_value: Any, page_size: int = 25) -> DataFrame:
    """Page that follows ``last_value`` of a unique key: as cheap for deep pages as for the first."""
    return df.filter(named(key) > F.lit(last_value)).orderBy(key).limit(page_size)


def table_view(
    df: DataFrame, search_column: str | None = None, search_value: str | None = None, order_by: str | None = None,
    direction: str = "ASC", page_number: int = 1, page_size: int = 25, shallow: int = 10_000,
) -> DataFrame:
    """A page of a table as a viewer wants it: searched, ordered, and with the count of all rows that the search found.

    Without a column to search or a text, all rows count; without an order, rows go by their content.
    """
    if direction.upper() not in ("ASC", "DESC"):
        raise ValueError(f"Unknown direction: {direction}")
    found = search(df, search_column, search_value) if search_column and search_value else df
    order = [f"-{order_by}" if direction.upper() == "DESC" else order_by] if order_by else []
    return page(found, order, page_number, page_size, with_total=True, shallow=shallow)


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Rows whose column contains the literal text."""
    require_columns(df, [column])
    return df.filter(named(column).cast("string").contains(text))


def top_n(df: DataFrame, order_by: Sequence, n: int) -> DataFrame:
    """First ``n`` rows of an order."""
    return df.orderBy(*order_by).limit(n)
