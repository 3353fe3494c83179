"""Equi-joins with dataframe null semantics, cross join, and join diagnostics.

No side is broadcast by hand: the optimizer does that below its size threshold, at planning time or from
runtime statistics. It splits skewed keys at run time, but only on the preserved side of an outer join and on
neither side of a full join. So outer joins salt the frequent keys of the side that cannot be split. A bounded
frequent-items summary of its keys, which the plan reads as a scalar subquery, names them. Rows of such a key are dealt
out by a salt, the other side's rows of it are repeated once per salt, and what such a repeated row finds nothing for
is dropped: as the key was seen on the salted side, some copy has a partner.

A key that few rows of both sides share can still give very many rows: all pairs. The optimizer splits and merges
partitions by their bytes, which do not show that. So the rows of keys whose pairs are too many by the summaries of both
sides are joined apart, in a grid: a row falls into one line of cells of its side and is repeated along it, and each pair
meets in one cell. As such keys were seen on both sides, all their rows have partners, whatever the kind of join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.quoting import named

# Accepted spellings of the join types.
JOIN_TYPES = {
    "inner": "inner", "left": "left", "left_outer": "left", "right": "right", "right_outer": "right",
    "full": "full", "outer": "full", "full_outer": "full", "cross": "cross",
    "semi": "semi", "left_semi": "semi", "anti": "anti", "left_anti": "anti",
}


# Tasks that a frequent key is dealt out to.
SALTS = 16
# Fewer rows of a key than this are no burden for a task.
HOT_KEY_ROWS = 1_000_000
# Fewer pairs of a key than this are no burden for a task; a cell of a key's grid has about so many.
HOT_KEY_PAIRS = 1_000_000
# Tasks that grids are dealt out to, for each shuffle partition.
GRID_TASKS = 4


# Key types whose text says exactly which keys are equal.
_SALTABLE = (T.IntegralType, T.FractionalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BinaryType)


def _common_types(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> list[T.DataType] | None:
    """The types in which the keys of both sides are compared; None if one of them has no exact text."""
    found = []
    for lk, rk in pairs:
        kinds = [df.schema[k].dataType for df, k in ((left, lk), (right, rk))]
        if kinds[0] == kinds[1]:
            kind = kinds[0]
        elif all(isinstance(k, T.NumericType) for k in kinds):
            kind = left.sparkSession.range(0).select(F.coalesce(*[F.lit(None).cast(k) for k in kinds]).alias("k")).schema["k"].dataType
        else:
            return None
        if not (isinstance(kind, _SALTABLE) or kind == T.StringType()):
            return None
        found.append(kind)
    return found


def _key_text(columns: Sequence[Column], kinds: Sequence[T.DataType]) -> Column:
    """Keys as one text: equal keys, and only they, give equal texts."""
    texts = []
    for column, kind in zip(columns, kinds, strict=True):
        column = column.cast(kind)
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            column = column + F.lit(0).cast(kind)  # 0.0 and -0.0 are equal
        elif isinstance(kind, T.TimestampType):
            column = F.unix_micros(column)  # two instants may have one local time
        elif isinstance(kind, T.BinaryType):
            column = F.hex(column)
        texts.append(column.cast("string"))
    return F.to_json(F.struct(*[t.alias(f"k{i}") for i, t in enumerate(texts)]))


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _summary(text: DataFrame, tag: str = "") -> DataFrame:
    """One row: the most frequent texts with their counts, and the number of rows."""
    partitions = _partitions(text)
    most, tracked = min(2 * partitions, 100_000), min(max(10_000, 8 * partitions), 1_000_000)
    top = F.expr(f"approx_top_k(k, {most}, {tracked})").alias(f"{tag}top")
    return text.select(text[text.columns[0]].alias("k")).agg(top, F.count(F.lit(1)).alias(f"{tag}n"))


def _items(tag: str, least_rows: int, partitions: int) -> Column:
    least = F.greatest(F.lit(least_rows), F.col(f"{tag}n") / F.lit(partitions))
    return F.transform(F.filter(f"{tag}top", lambda t: t["count"] >= least), lambda t: t["item"])


def frequent_keys(text: DataFrame, least_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """One row with an array ``items``: texts of at least ``least_rows`` rows that are more than a shuffle partition's share.

    One scan. The summary has a bounded size, whatever the number of rows, and is combined before the shuffle; its
    counts err by a small part of that share.
    """
    return _summary(text).select(_items("", least_rows, _partitions(text)).alias("items"))


def hot_keys(left: DataFrame, right: DataFrame, least_rows: int = HOT_KEY_ROWS, least_pairs: int = HOT_KEY_PAIRS) -> DataFrame:
    """One row: the frequent texts ``left`` and ``right``, and ``cells`` with the grid of each text of many pairs.

    A grid has ``a`` lines of left rows and ``b`` of right rows, so that a cell has about ``least_pairs`` pairs.
    """
    partitions = _partitions(left)
    both = _summary(left, "l").crossJoin(_summary(right, "r")).withColumn("counts", F.map_from_entries("rtop"))
    least = F.greatest(F.lit(float(least_pairs)), F.col("ln") / F.lit(partitions), F.col("rn") / F.lit(partitions))

    def lines(own: Column, other: Column) -> Column:
        return F.ceil(own / F.greatest(F.lit(least_pairs**0.5), F.lit(float(least_pairs)) / other)).cast("long")

    counted = F.transform("ltop", lambda t: F.struct(
        t["item"].alias("item"), t["count"].cast("double").alias("l"), F.try_element_at("counts", t["item"]).cast("double").alias("r")))
    cells = F.transform(F.filter(counted, lambda t: t["l"] * t["r"] >= least), lambda t: F.struct(
        t["item"].alias("key"), F.struct(lines(t["l"], t["r"]).alias("a"), lines(t["r"], t["l"]).alias("b")).alias("value")))
    return both.select(F.struct(
        _items("l", least_rows, partitions).alias("left"), _items("r", least_rows, partitions).alias("right"),
        F.map_from_entries(cells).alias("cells")).alias("hot"))


def key_pairs(on) -> list[tuple[str, str]]:
    """Pairs of key names from a name, a list of names, or ``[{left, right}]`` conditions."""
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return [(on["left"], on["right"])]
    pairs = []
    for item in on:
        if isinstance(item, str):
            pairs.append((item, item))
        elif isinstance(item, Mapping):
            pairs.append((item["left"], item["right"]))
        else:
            pairs.append((item[0], item[1]))
    return pairs


def _check_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> None:
    for lk, rk in pairs:
        if lk not in left.columns:
            raise ValueError(f"Column '{lk}' not found in left data")
        if rk not in right.columns:
            raise ValueError(f"Column '{rk}' not found in right data")
        texts = [isinstance(df.schema[k].dataType, T.StringType) for df, k in ((left, lk), (right, rk))]
        if texts[0] != texts[1]:
            raise ValueError(f"Join keys '{lk}' and '{rk}' have different types: convert one of them first")


def _equal(a: Column, b: Column, null_safe: bool) -> Column:
    return a.eqNullSafe(b) if null_safe else a == b


def join(
    left: DataFrame,
    right: DataFrame,
    on=(),
    how: str = "inner",
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_left", "_right"),
    left_prefix: str | None = None,
    right_prefix: str | None = None,
    hot_key_rows: int = HOT_KEY_ROWS,
    salts: int = SALTS,
    hot_key_pairs: int = HOT_KEY_PAIRS,
    split_pairs: bool | None = None,
) -> DataFrame:
    """Join two frames; null keys match null keys unless ``null_safe`` is off.

    The left key names survive and hold the key of either side; right key columns are dropped. Prefixes
    rename non-key columns of a side (different sources); suffixes resolve clashes (same source). Keys of many pairs
    are split in outer joins, in inner joins only with ``split_pairs``: it reads the sides again for their keys.
    """
    kind = JOIN_TYPES.get(str(how).lower())
    if kind is None:
        raise ValueError(f"Unknown join type: {how}")
    pairs = [] if kind == "cross" else key_pairs(on)
    if kind != "cross" and not pairs:
        raise ValueError("a join needs at least one key pair")
    _check_keys(left, right, pairs)
    left_keys = [p[0] for p in pairs]
    right_keys = [p[1] for p in pairs]
    if kind in ("semi", "anti"):
        # distinct keys first: a hot key on the right side then has one row
        keys = right.select(*[named(r).alias(f"__r{i}") for i, r in enumerate(right_keys)]).distinct()
        cond = [_equal(named(lk), F.col(f"__r{i}"), null_safe) for i, lk in enumerate(left_keys)]
        return left.join(keys, reduce(lambda a, b: a & b, cond), f"left_{kind}")

    if left_prefix:
        left = left.withColumnsRenamed({c: left_prefix + c for c in left.columns if c not in left_keys})
    right_values = [c for c in right.columns if c not in right_keys]
    out_right = {c: (right_prefix or "") + c for c in right_values}
    clash = {c for c in left.columns if c in out_right.values()}
    out_left = {c: c + suffixes[0] if c in clash and c not in left_keys else c for c in left.columns}
    out_right = {c: n + suffixes[1] if n in clash else n for c, n in out_right.items()}

    r = right.select(
        *[named(k).alias(f"__k{i}") for i, k in enumerate(right_keys)],
        *[named(c).alias(f"__v{i}") for i, c in enumerate(right_values)],
    )
    left_part = [named(c).alias(out_left[c]) for c in left.columns]
    right_part = [F.col(f"__v{i}").alias(out_right[c]) for i, c in enumerate(right_values)]
    if kind == "cross":
        return left.crossJoin(r).select(*left_part, *right_part)

    cond = reduce(
        lambda a, b: a & b,
        [_equal(named(lk), F.col(f"__k{i}"), null_safe) for i, lk in enumerate(left_keys)],
    )
    key_place = {k: i for i, k in enumerate(left_keys)}

    if kind == "inner" and not split_pairs:
        return left.join(r, cond).select(*left_part, *right_part)
    coalesced = [
        F.coalesce(named(c), F.col(f"__k{key_place[c]}")).alias(c) if c in key_place else named(c).alias(out_left[c])
        for c in left.columns
    ]
    left_part = coalesced if kind in ("right", "full") else left_part
    kinds = None if left.isStreaming or right.isStreaming else _common_types(left, right, pairs)
    if kinds is None:
        return left.join(r, cond, kind).select(*left_part, *right_part)

    columns = {"left": [named(k) for k in left_keys], "right": [F.col(f"__k{i}") for i in range(len(pairs))]}
    unsplit = {"inner": (), "left": ("right",), "right": ("left",), "full": ("left", "right")}[kind]
    frame = {"left": left, "right": r}
    texts = {side: df.select(_key_text(columns[side], kinds).alias("k")) for side, df in frame.items()}
    if "left" not in unsplit:  # its keys count only where some key of the right has several rows
        several = _summary(texts["right"]).select(F.exists("top", lambda t: t["count"] > 1)).scalar()
        texts["left"] = texts["left"].where(several)
    hot = hot_keys(texts["left"], texts["right"], hot_key_rows, hot_key_pairs).scalar()
    found = {side: hot[side] for side in unsplit}
    split = split_pairs is not False

    def apart(side: str) -> Column:
        """Whether the key of a row has a grid; a null key meets nothing unless nulls match."""
        has = (F.size(hot["cells"]) > 0) & F.map_contains_key(hot["cells"], _key_text(columns[side], kinds))
        return has if null_safe else reduce(lambda a, b: a & b, [c.isNotNull() for c in columns[side]], has)

    def row_hash(df: DataFrame) -> Column:
        return F.xxhash64(*[named(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))])

    def in_grid(side: str, tag: str) -> DataFrame:
        """The rows of keys with a grid, once in each cell of their line."""
        df = frame[side].where(apart(side)).withColumn(f"{tag}text", _key_text(columns[side], kinds))
        df = df.withColumn(f"{tag}grid", F.try_element_at(hot["cells"], F.col(f"{tag}text")))
        a, b = F.col(f"{tag}grid.a"), F.col(f"{tag}grid.b")
        line = F.pmod(row_hash(frame[side]), a if side == "left" else b)
        cells = F.sequence(line * b, line * b + b - 1) if side == "left" else F.sequence(line, line + (a - 1) * b, b)
        # a number of its own: tasks of few bytes are not merged
        return df.withColumn(f"{tag}cell", F.explode(cells)).repartition(GRID_TASKS * _partitions(left), f"{tag}text", f"{tag}cell")

    # of the other keys those frequent on the right are salted there, all others that are frequent on the left there
    def dealt(side: str, tag: str) -> DataFrame:
        """Rows with a salt: of the keys frequent on their own side by hash, of those frequent on the other once each."""
        df, text = frame[side].where(~apart(side)) if split else frame[side], _key_text(columns[side], kinds)
        here = lambda s: F.array_contains(found[s], text) if s in found else F.lit(False)
        own, again = (here("right"), here("left") & ~here("right")) if side == "right" else (here("left") & ~here("right"), here("right"))
        if not null_safe:  # a null key meets nothing
            known = reduce(lambda a, b: a & b, [c.isNotNull() for c in columns[side]])
            own, again = own & known, again & known
        by_row = row_hash(df)
        every = F.sequence(F.lit(0), F.lit(salts - 1))
        one = F.array(F.when(F.coalesce(own, F.lit(False)), F.pmod(by_row, F.lit(salts)).cast("int")).otherwise(F.lit(0)))
        marked = df.withColumn(f"{tag}again", F.coalesce(again, F.lit(False)))
        return marked.withColumn(f"{tag}salt", F.explode(F.when(F.col(f"{tag}again"), every).otherwise(one)))

    if kind == "inner":
        out = left.where(~apart("left")).join(r.where(~apart("right")), cond).select(*left_part, *right_part)
    else:
        a, b = dealt("left", "__l"), dealt("right", "__r")
        both = a.join(b, cond & (F.col("__lsalt") == F.col("__rsalt")), kind)
        alone = (F.col("__lagain") & F.col("__rsalt").isNull()) | (F.col("__ragain") & F.col("__lsalt").isNull())
        out = both.where(~F.coalesce(alone, F.lit(False))).select(*left_part, *right_part)
    if not split:
        return out
    met = (F.col("__ltext") == F.col("__rtext")) & (F.col("__lcell") == F.col("__rcell"))
    return out.union(in_grid("left", "__l").join(in_grid("right", "__r"), met).select(*left_part, *right_part))


def join_check(left: DataFrame, right: DataFrame, on, null_safe: bool = True) -> DataFrame:
    """One row that tells what a join would do: rows, distinct, null and duplicate keys, matches, output size.

    Each side is reduced to one row per key before the sides meet, so no key is hot in the join.
    """
    pairs = key_pairs(on)
    _check_keys(left, right, pairs)

    def per_key(df: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
        cols = [named(k).alias(f"{tag}{i}") for i, k in enumerate(keys)]
        return df.select(*cols).groupBy(*[f"{tag}{i}" for i in range(len(keys))]).agg(
            F.count(F.lit(1)).cast("decimal(19,0)").alias(f"{tag}n")
        )

    lk = per_key(left, [p[0] for p in pairs], "l")
    rk = per_key(right, [p[1] for p in pairs], "r")
    cond = reduce(
        lambda a, b: a & b,
        [_equal(F.col(f"l{i}"), F.col(f"r{i}"), null_safe) for i in range(len(pairs))],
    )
    both = lk.join(rk, cond, "full")

    def any_null(tag: str) -> Column:
        return reduce(lambda a, b: a | b, [F.col(f"{tag}{i}").isNull() for i in range(len(pairs))])

    def total(value: Column, keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, value)), F.lit(0)).cast("long")

    ln, rn = F.col("ln"), F.col("rn")
    on_left, on_right = ln.isNotNull(), rn.isNotNull()
    product = ln.cast("decimal(38,0)") * rn.cast("decimal(38,0)")
    facts = both.agg(
        total(ln, on_left).alias("left_rows"), total(rn, on_right).alias("right_rows"),
        F.count_if(on_left).alias("left_distinct_keys"), F.count_if(on_right).alias("right_distinct_keys"),
        total(ln, on_left & any_null("l")).alias("left_null_keys"),
        total(rn, on_right & any_null("r")).alias("right_null_keys"),
        F.count_if(ln > 1).alias("left_duplicate_keys"), F.count_if(rn > 1).alias("right_duplicate_keys"),
        total(ln, on_left & on_right).alias("left_matched_rows"),
        total(product, on_left & on_right).alias("inner_rows"),
    )
    cross = F.col("left_rows").cast("double") * F.col("right_rows").cast("double")
    rate = F.col("left_matched_rows") / F.nullif(F.col("left_rows"), F.lit(0))
    return facts.withColumns({"match_rate": rate, "cross_rows": cross})


def check_key_types(left: DataFrame, right: DataFrame, on) -> list[str]:
    """Key pairs whose types differ, as messages."""
    out = []
    for lk, rk in key_pairs(on):
        lt, rt = left.schema[lk].dataType, right.schema[rk].dataType
        if lt != rt:
            out.append(f"{lk} is {lt.simpleString()} but {rk} is {rt.simpleString()}")
    return out
