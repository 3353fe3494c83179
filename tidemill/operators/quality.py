"""Data-quality rules, reports, isolation of dirty rows and the quarantine table.

All rules are evaluated in one annotating pass that adds an array of issues to every row. Row-local rules
are expressions; a uniqueness or reference rule adds one join against a table with one row per key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.conversion import to_double
from tidemill.functions.predicates import is_missing
from tidemill.functions.quoting import named
from tidemill.session import require_columns

# Severities and issue types.
SEVERITIES = ("low", "medium", "high", "critical")
NULL_VALUE = "null_value"
TYPE_MISMATCH = "type_mismatch"
RANGE_VIOLATION = "range_violation"
DUPLICATE_KEY = "duplicate_key"
REFERENTIAL_INTEGRITY = "referential_integrity"
FORMAT_VIOLATION = "format_violation"
BUSINESS_RULE = "business_rule"

ISSUES = "__issues"


@dataclass(frozen=True)
class Rule:
    """One check of one column."""

    kind: str
    issue_type: str
    column: str
    severity: str
    params: Mapping[str, Any] = field(default_factory=dict)

    @property
    def rule_id(self) -> str:
        return f"{self.kind}:{self.column}:" + ",".join(
            f"{k}={v}" for k, v in sorted(self.params.items()) if not isinstance(v, DataFrame)
        )

    def __post_init__(self):
        if self.severity not in SEVERITIES:
            raise ValueError(f"Unknown severity: {self.severity}")


def not_null(column: str, severity: str = "medium") -> Rule:
    """No null in the column."""
    return Rule("not_null", NULL_VALUE, column, severity)


def data_type(column: str, expected: str, severity: str = "high") -> Rule:
    """Values are ``int``, ``float``, ``str`` or ``datetime``."""
    if expected not in ("int", "float", "str", "datetime"):
        raise ValueError(f"Unknown expected type: {expected}")
    return Rule("data_type", TYPE_MISMATCH, column, severity, {"expected": expected})


def in_range(column: str, low: Any, high: Any, severity: str = "medium") -> Rule:
    """Values lie within inclusive bounds; a null passes."""
    return Rule("range", RANGE_VIOLATION, column, severity, {"low": low, "high": high})


def unique(column: str, severity: str = "high") -> Rule:
    """No value occurs twice; nulls equal each other."""
    return Rule("unique", DUPLICATE_KEY, column, severity)


def references(column: str, lookup: DataFrame, lookup_column: str, severity: str = "high") -> Rule:
    """Every non-null value exists in the lookup column."""
    return Rule("reference", REFERENTIAL_INTEGRITY, column, severity,
                {"lookup": lookup, "lookup_column": lookup_column})


def matches_format(column: str, pattern: str, severity: str = "medium") -> Rule:
    """Non-null text matches a regex."""
    return Rule("format", FORMAT_VIOLATION, column, severity, {"pattern": pattern})


def satisfies(column: str, expression: str, severity: str = "medium") -> Rule:
    """A SQL predicate holds; an unknown result passes."""
    return Rule("expression", BUSINESS_RULE, column, severity, {"expression": expression})


def _type_violation(df: DataFrame, rule: Rule) -> Column:
    col, kind = named(rule.column), df.schema[rule.column].dataType
    expected = rule.params["expected"]
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.BooleanType)
    if expected == "int" and isinstance(kind, T.StringType):
        return ~is_missing(df, rule.column) & ~col.rlike("^[0-9]+$")
    fits = {
        "int": isinstance(kind, whole),
        "float": isinstance(kind, (T.NumericType, T.BooleanType)),
        "str": isinstance(kind, T.StringType),
        "datetime": isinstance(kind, (T.TimestampType, T.TimestampNTZType)),
    }[expected]
    return F.lit(False) if fits else ~is_missing(df, rule.column)


def _local_violation(df: DataFrame, rule: Rule) -> Column | None:
    col = named(rule.column)
    if rule.kind == "not_null":
        return is_missing(df, rule.column)
    if rule.kind == "data_type":
        return _type_violation(df, rule)
    if rule.kind == "range":
        low, high = rule.params["low"], rule.params["high"]
        text_column = isinstance(df.schema[rule.column].dataType, T.StringType)
        value = to_double(col) if text_column and not isinstance(low, str) else col
        return (value < F.lit(low)) | (value > F.lit(high))
    if rule.kind == "format":
        return ~col.cast("string").rlike(rule.params["pattern"])
    if rule.kind == "expression":
        return ~F.expr(rule.params["expression"])
    return None


def _expected(rule: Rule) -> str:
    p = rule.params
    texts = {
        "not_null": "non-null value", "unique": "unique value",
        "data_type": str(p.get("expected")), "range": f"between {p.get('low')} and {p.get('high')}",
        "reference": f"value of {p.get('lookup_column')}", "format": f"text matching {p.get('pattern')}",
        "expression": str(p.get("expression")),
    }
    return texts[rule.kind]


def _issue(rule: Rule) -> Column:
    value = named(rule.column).cast("string")
    message = F.concat(
        F.lit(f"{rule.issue_type} in column '{rule.column}': "), F.coalesce(value, F.lit("null")),
        F.lit(f" (expected {_expected(rule)})"),
    )
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.issue_type).alias("issue_type"),
        F.lit(rule.severity).alias("severity"), F.lit(rule.column).alias("column_name"),
        value.alias("value"), F.lit(_expected(rule)).alias("expected_value"), message.alias("message"),
    )


def _checked(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[tuple[Rule, Column]]]:
    """Frame with the flags of the joined rules, and a violation predicate per rule (never null)."""
    checks: list[tuple[Rule, Column]] = []
    work = df
    for i, rule in enumerate(r for r in rules if r.column in df.columns):
        local = _local_violation(df, rule)
        if local is not None:
            checks.append((rule, F.coalesce(local, F.lit(False))))
            continue
        key, flag = f"__k{i}", f"__f{i}"
        if rule.kind == "unique":
            found = (
                df.groupBy(named(rule.column).alias(key)).agg(F.count(F.lit(1)).alias("__n"))
                .filter(F.col("__n") > 1).select(key, F.lit(True).alias(flag))
            )
            work = work.join(found, named(rule.column).eqNullSafe(F.col(key)), "left").drop(key)
            checks.append((rule, F.col(flag).isNotNull()))
        else:
            lookup = rule.params["lookup"].select(named(rule.params["lookup_column"]).alias(key))
            found = lookup.filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
            work = work.join(found, named(rule.column) == F.col(key), "left").drop(key)
            checks.append((rule, F.col(flag).isNull() & named(rule.column).isNotNull()))
    return work, checks


def _issue_array(checks: Sequence[tuple[Rule, Column]]) -> Column:
    if not checks:
        return F.expr(
            "cast(array() as array<struct<rule_id string, issue_type string, severity string, column_name string,"
            " value string, expected_value string, message string>>)"
        )
    return F.array_compact(F.array(*[F.when(bad, _issue(rule)) for rule, bad in checks]))


def _violations(checks: Sequence[tuple[Rule, Column]]) -> Column:
    """Number of violated rules of a row."""
    return reduce(lambda a, b: a + b, [bad.cast("int") for _, bad in checks], F.lit(0))


def annotate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the array column ``__issues``; rules on unknown columns are skipped."""
    work, checks = _checked(df, rules)
    return work.select(*[named(c) for c in df.columns], _issue_array(checks).alias(ISSUES))


def issues(df: DataFrame, rules: Sequence[Rule], row_key: Sequence[str]) -> DataFrame:
    """One row per issue, identified by the row's key columns."""
    require_columns(df, row_key)
    needed = [c for c in df.columns if c in set(row_key) | {r.column for r in rules}]
    if any(r.kind == "expression" for r in rules):
        needed = df.columns
    flat = annotate(df.select(*[named(c) for c in needed]), rules)
    flat = flat.select(*[named(c) for c in row_key], F.explode(ISSUES).alias("i"))
    parts = [named(c).cast("string") for c in row_key]
    issue_id = F.sha2(F.concat_ws("|", F.col("i.rule_id"), *parts), 256)
    return flat.select(
        issue_id.alias("issue_id"), *[named(c) for c in row_key], "i.issue_type", "i.severity", "i.column_name",
        "i.value", "i.expected_value", "i.message", F.current_timestamp().alias("timestamp"),
    )


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One report row: total rows and columns, dirty and clean rows, number of issues."""
    work, checks = _checked(df, rules)
    flagged = work.select(_violations(checks).alias("__bad"))
    return flagged.agg(
        F.count(F.lit(1)).alias("total_rows"), F.lit(len(df.columns)).alias("total_columns"),
        F.count_if(F.col("__bad") > 0).alias("dirty_rows"), F.count_if(F.col("__bad") == 0).alias("clean_rows"),
        F.coalesce(F.sum("__bad"), F.lit(0)).cast("long").alias("issue_count"),
    )


def issues_by_type(found: DataFrame) -> DataFrame:
    """Issue count per type."""
    return found.groupBy("issue_type").agg(F.count(F.lit(1)).alias("issue_count"))


def issues_head(found: DataFrame, row_key: Sequence[str], limit: int = 100) -> DataFrame:
    """First ``limit`` issues in row order; ``has_more`` tells whether others exist."""
    order = [*row_key, "column_name", "issue_type"]
    head = found.orderBy(*order).limit(limit + 1)
    # the window sees at most limit + 1 rows
    seen = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    return head.withColumn("has_more", seen > limit).orderBy(*order).limit(limit)


def isolate(df: DataFrame, rules: Sequence[Rule], strategy: str = "quarantine") -> tuple[DataFrame, DataFrame]:
    """Clean and dirty rows: ``quarantine`` splits, ``fix_and_continue`` repairs, ``ignore`` keeps all.

    The fix writes "" into null text cells of columns with a not-null rule. Dirty rows keep their issues.
    """
    columns = [named(c) for c in df.columns]
    if strategy == "quarantine":
        work, checks = _checked(df, rules)
        clean = work.filter(_violations(checks) == 0).select(*columns)
        return clean, work.filter(_violations(checks) > 0).select(*columns, _issue_array(checks).alias(ISSUES))
    nothing = annotate(df, []).filter(F.lit(False))
    if strategy in ("fix_and_continue", "fix"):
        fixable = {
            r.column for r in rules
            if r.kind == "not_null" and r.column in df.columns
            and isinstance(df.schema[r.column].dataType, T.StringType)
        }
        return df.withColumns({c: F.coalesce(named(c), F.lit("")) for c in fixable}), nothing
    if strategy == "ignore":
        return df, nothing
    raise ValueError(f"Unknown isolation strategy: {strategy}")


def write_quarantine(dirty: DataFrame, path: str, dataset_id: str, quarantine_id: str) -> None:
    """Append dirty rows (as JSON, with their issues) to the quarantine table.

    One folder per ``quarantine_id`` is overwritten as a whole, so a retried write leaves no duplicates.
    """
    data = [named(c) for c in dirty.columns if c != ISSUES]
    rows = dirty.select(
        F.lit(dataset_id).alias("dataset_id"), F.to_json(F.struct(*data)).alias("record"),
        F.col(ISSUES).alias("issues"), F.lit(None).cast("string").alias("reason"),
        F.current_timestamp().alias("timestamp"),
    )
    rows.write.mode("overwrite").parquet(f"{path}/quarantine_id={quarantine_id}")


def quarantine_records(records: DataFrame, path: str, dataset_id: str, quarantine_id: str, reason: str) -> None:
    """Put records aside by hand, with a reason."""
    empty = annotate(records, []).withColumn("__reason", F.lit(reason))
    data = [named(c) for c in records.columns]
    empty.select(
        F.lit(dataset_id).alias("dataset_id"), F.to_json(F.struct(*data)).alias("record"),
        F.col(ISSUES).alias("issues"), F.col("__reason").alias("reason"), F.current_timestamp().alias("timestamp"),
    ).write.mode("overwrite").parquet(f"{path}/quarantine_id={quarantine_id}")


def list_quarantine(spark, path: str) -> DataFrame:
    """Rows and issues per quarantine entry."""
    kinds = spark.read.parquet(path).schema
    as_text = T.StructType([T.StructField(f.name, T.StringType() if f.name == "quarantine_id" else f.dataType) for f in kinds])
    table = spark.read.schema(as_text).parquet(path)
    return table.groupBy("quarantine_id", "dataset_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.sum(F.size("issues")).alias("issue_count")
    )


def auto_profile(df: DataFrame, sample_size: int | None = None) -> list[Rule]:
    """Rules suggested by the data, from all rows; with ``sample_size`` only nulls are counted over all rows.

    One aggregate gives counts, limits and an estimate of the distinct values. Only columns whose estimate comes near
    their number of values are counted exactly, so that columns with few values are not shuffled for it.
    """
    columns = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if not columns:
        return []
    values = {f.name: F.when(~is_missing(df, f.name), named(f.name)) for f in columns}
    nulls = [F.count_if(is_missing(df, f.name)).alias(f"n{i}") for i, f in enumerate(columns)]
    facts = []
    for i, f in enumerate(columns):
        col = values[f.name]
        facts += [F.count(col).alias(f"c{i}"), F.approx_count_distinct(col).alias(f"d{i}")]
        if isinstance(f.dataType, T.NumericType):
            facts += [F.min(col).alias(f"lo{i}"), F.max(col).alias(f"hi{i}")]
    if sample_size is None:
        rows, seen = df, df.agg(*nulls, *facts).first().asDict()
    else:
        rows = df.limit(sample_size)
        seen = df.agg(*nulls).first().asDict() | rows.agg(*facts).first().asDict()
    # the estimate's standard error is 5 %: half the count is ten such errors away
    likely = [i for i in range(len(columns)) if seen[f"c{i}"] and 2 * seen[f"d{i}"] >= seen[f"c{i}"]]
    exact = {}
    if likely:
        exact = rows.agg(*[F.count_distinct(values[columns[i].name]).alias(f"u{i}") for i in likely]).first().asDict()
    rules: list[Rule] = []
    for i, f in enumerate(columns):
        count = seen[f"c{i}"]
        if count == 0:
            continue
        if seen[f"n{i}"] > 0:
            rules.append(not_null(f.name))
        if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
            rules += [data_type(f.name, "int"), in_range(f.name, seen[f"lo{i}"], seen[f"hi{i}"])]
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            rules += [data_type(f.name, "float"), in_range(f.name, seen[f"lo{i}"], seen[f"hi{i}"])]
        elif isinstance(f.dataType, T.StringType):
            rules.append(data_type(f.name, "str"))
        if "id" in f.name.lower() or exact.get(f"u{i}") == count:
            rules.append(unique(f.name))
    return rules


def export_report(df: DataFrame, rules: Sequence[Rule], row_key: Sequence[str], path: str, format: str = "json",
                  dataset_id: str = "dataset") -> None:
    """Write the report row and all issues as JSON, or the issues as CSV."""
    found = issues(df, rules, row_key)
    if format == "json":
        validate(df, rules).withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite").json(f"{path}/report")
        found.write.mode("overwrite").json(f"{path}/issues")
    elif format == "csv":
        found.write.mode("overwrite").option("header", True).csv(f"{path}/issues")
    else:
        raise ValueError(f"Unsupported export format: {format}")
