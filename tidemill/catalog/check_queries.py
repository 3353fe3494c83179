"""Queries for data quality, inspection and snapshots."""

from functools import reduce

from pyspark.sql import functions as F

from tidemill.catalog.registry import Tables, nulled, query
from tidemill.operators import inspect, quality
from tidemill.operators.snapshots import Snapshots, snapshot_hash
from tidemill.plans.runner import preview_steps as preview
from tidemill.plans.runner import run_steps
from tidemill.sinks import files as out
from tidemill.sources.files import file_listing

_DIRTY = """WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS priority,
 CASE WHEN o_orderkey % 11 = 0 THEN '-' || o_custkey ELSE o_custkey::VARCHAR END AS cust,
 CASE WHEN o_orderkey % 13 = 0 THEN -o_totalprice ELSE o_totalprice END AS price,
 CASE WHEN o_orderkey % 100 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN 0 ELSE o_orderkey END AS ref, o_custkey FROM orders) """


def _dirty(t: Tables):
    key = F.col("o_orderkey")
    cust = F.col("o_custkey").cast("string")
    price = F.col("o_totalprice")
    return t.orders.select(
        "o_orderkey", nulled("o_orderpriority", "o_orderkey", 7).alias("priority"),
        F.when(key % 11 == 0, F.concat(F.lit("-"), cust)).otherwise(cust).alias("cust"),
        F.when(key % 13 == 0, -price).otherwise(price).alias("price"),
        F.when(key % 101 == 0, F.when(key % 100 != 0, 0)).when(key % 100 != 0, key).cast("long").alias("ref"), "o_custkey",
    )


def _rules():
    return [
        quality.not_null("priority"), quality.data_type("cust", "int"), quality.in_range("price", 0.0, 400000.0),
        quality.unique("ref"), quality.not_null("no_such_column"),
    ]


_BAD = {
    "null_value": "priority IS NULL", "type_mismatch": "NOT regexp_matches(cust, '^[0-9]+$')",
    "range_violation": "price < 0 OR price > 400000",
    "duplicate_key": "ref IS NULL AND (SELECT count(*) FROM d WHERE ref IS NULL) > 1 OR ref IN (SELECT ref FROM d GROUP BY ref HAVING count(*) > 1)",
}
_VALUE = {"null_value": ("priority", "priority"), "type_mismatch": ("cust", "cust"),
          "range_violation": ("price", "price"), "duplicate_key": ("ref", "ref")}
_ANY_BAD = " OR ".join(f"({w})" for w in _BAD.values())


def _rule_query(name: str, rule, issue_type: str, column: str, where: str, severity: str) -> None:
    def run(t: Tables):
        found = quality.issues(_dirty(t), [rule(t)], ["o_orderkey"])
        return found.select("o_orderkey", "issue_type", "severity", "column_name")

    query(name, _DIRTY + f"SELECT o_orderkey, '{issue_type}' AS issue_type, '{severity}' AS severity, "
          f"'{column}' AS column_name FROM d WHERE {where}")(run)


_rule_query("rule_not_null", lambda t: quality.not_null("priority"), "null_value", "priority", _BAD["null_value"], "medium")
_rule_query("rule_data_type", lambda t: quality.data_type("cust", "int"), "type_mismatch", "cust", _BAD["type_mismatch"], "high")
_rule_query("rule_range", lambda t: quality.in_range("price", 0.0, 400000.0), "range_violation", "price", _BAD["range_violation"], "medium")
_rule_query("rule_unique", lambda t: quality.unique("ref"), "duplicate_key", "ref", _BAD["duplicate_key"], "high")
_rule_query("rule_referential", lambda t: quality.references("o_custkey", t.customer.filter("c_acctbal > 0"), "c_custkey"),
            "referential_integrity", "o_custkey", "o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)", "high")
_rule_query("rule_format", lambda t: quality.matches_format("priority", r"^[1-4]-"), "format_violation", "priority",
            "NOT regexp_matches(priority, '^[1-4]-')", "medium")
_rule_query("rule_expr", lambda t: quality.satisfies("price", "price > o_custkey * 10"), "business_rule", "price",
            "NOT (price > o_custkey * 10)", "medium")


@query("validate", _DIRTY + f"""SELECT count(*) AS total_rows, 6 AS total_columns, count(*) FILTER ({_ANY_BAD}) AS dirty_rows,
 count(*) - count(*) FILTER ({_ANY_BAD}) AS clean_rows, ({' + '.join(f'count(*) FILTER ({w})' for w in _BAD.values())}) AS issue_count FROM d""")
def validate(t: Tables):
    return quality.validate(_dirty(t), _rules())


@query("issues_by_type", _DIRTY + " UNION ALL ".join(
    f"SELECT '{k}' AS issue_type, count(*) AS issue_count FROM d WHERE {w}" for k, w in _BAD.items()))
def issues_by_type(t: Tables):
    return quality.issues_by_type(quality.issues(_dirty(t), _rules(), ["o_orderkey"]))


@query("issues_head", _DIRTY + "SELECT *, (SELECT count(*) FROM ({u})) > 100 AS has_more FROM ({u}) ORDER BY o_orderkey, column_name LIMIT 100".format(
    u=" UNION ALL ".join(f"SELECT o_orderkey, '{k}' AS issue_type, '{_VALUE[k][0]}' AS column_name FROM d WHERE {w}" for k, w in _BAD.items())))
def issues_head(t: Tables):
    head = quality.issues_head(quality.issues(_dirty(t), _rules(), ["o_orderkey"]), ["o_orderkey"])
    return head.select("o_orderkey", "issue_type", "column_name", "has_more")


@query("isolate_quarantine", _DIRTY + f"SELECT *, NOT coalesce({_ANY_BAD}, false) AS clean FROM d")
def isolate_quarantine(t: Tables):
    clean, dirty = quality.isolate(_dirty(t), _rules())
    return clean.withColumn("clean", F.lit(True)).unionByName(dirty.drop(quality.ISSUES).withColumn("clean", F.lit(False)))


@query("isolate_fix", _DIRTY + "SELECT o_orderkey, coalesce(priority, '') AS priority, cust, price, ref, o_custkey FROM d")
def isolate_fix(t: Tables):
    return quality.isolate(_dirty(t), _rules(), "fix_and_continue")[0]


@query("isolate_ignore", _DIRTY + "SELECT * FROM d")
def isolate_ignore(t: Tables):
    return quality.isolate(_dirty(t), _rules(), "ignore")[0]


@query("quarantine_table", _DIRTY + f"""SELECT 'q1' AS quarantine_id, 'orders' AS dataset_id, count(*) AS record_count,
 ({' + '.join(f'count(*) FILTER ({w})' for w in _BAD.values())}) AS issue_count FROM d WHERE {_ANY_BAD}
 UNION ALL SELECT 'q2', 'orders', (SELECT count(*) FROM d WHERE price > 450000), 0""")
def quarantine_table(t: Tables):
    path = t.scratch("quarantine")
    df = _dirty(t)
    quality.write_quarantine(quality.isolate(df, _rules())[1], path, "orders", "q1")
    quality.quarantine_records(df.filter("price > 450000"), path, "orders", "q2", "looks wrong")
    return quality.list_quarantine(t.spark, path)


def _profiled(column: str, value: str, number: str | None) -> str:
    kinds = [("not_null", f"count({value}) < count(*)", "NULL", "NULL"), ("unique", f"count(DISTINCT {value}) = count({value})", "NULL", "NULL"),
             ("data_type", "true", "NULL", "NULL")]
    if number:
        kinds.append(("range", "true", f"min({value})::DOUBLE", f"max({value})::DOUBLE"))
    return " UNION ALL ".join(
        f"SELECT '{kind}' AS kind, '{column}' AS column_name, {low}::DOUBLE AS low, {high}::DOUBLE AS high FROM orders HAVING {holds}"
        for kind, holds, low, high in kinds)


@query("auto_profile", " UNION ALL ".join((
    _profiled("o_orderkey", "o_orderkey", "int"), _profiled("priority", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END", None),
    _profiled("o_custkey", "o_custkey", "int"), _profiled("o_totalprice", "o_totalprice", "float"))))
def auto_profile(t: Tables):
    """The rules that the data itself suggests, with the bounds of its values."""
    df = t.orders.select("o_orderkey", nulled("o_orderpriority", "o_orderkey", 7).alias("priority"), "o_custkey", "o_totalprice")
    found = [(r.kind, r.column, *(None if (v := r.params.get(k)) is None else float(v) for k in ("low", "high"))) for r in quality.auto_profile(df)]
    return t.spark.createDataFrame(found, "kind string, column_name string, low double, high double")


@query("export_report", _DIRTY + " UNION ALL ".join(
    f"SELECT o_orderkey, '{k}' AS issue_type, {_VALUE[k][1]}::VARCHAR AS value FROM d WHERE {w}"
    for k, w in _BAD.items()))
def export_report(t: Tables):
    path = t.scratch("report")
    quality.export_report(_dirty(t), _rules(), ["o_orderkey"], path, "json")
    found = t.spark.read.schema("o_orderkey long, issue_type string, value string").json(f"{path}/issues")
    return found


@query("column_preview", " UNION ALL ".join(
    f"SELECT '{c}' AS name, '{o}' AS original_name, {kind} AS suggested_type, count(*) > count({e}) AS nullable, "
    f"count(DISTINCT {e}) + (count(*) > count({e}))::BIGINT AS unique_values, count(*) - count({e}) AS null_count, least(count({e}), 5)::INTEGER AS samples FROM orders"
    for c, o, e, kind in [
        ("order_key", "Order Key", "o_orderkey", "CASE WHEN max(o_orderkey) <= 32767 THEN 'SMALLINT' ELSE 'INTEGER' END"),
        ("priority", "priority", "CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END",
         "'VARCHAR(' || least(2 * max(length(CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END)), 255) || ')'"),
        ("placed", "placed", "o_orderdate", "'DATE'"),
    ]))
def column_preview(t: Tables):
    return inspect.column_preview(t.orders.select(
        F.col("o_orderkey").alias("Order Key"), nulled("o_orderpriority", "o_orderkey", 7).alias("priority"),
        F.col("o_orderdate").alias("placed"),
    )).withColumn("samples", F.size("sample_values")).drop("sample_values")


@query("column_statistics", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, 0 AS null_count FROM lineitem"
    for c in ("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag")))
def column_statistics(t: Tables):
    df = t.lineitem.select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag")
    return inspect.column_statistics(df).drop("place")


@query("source_preview", """SELECT 'o_orderkey' AS name, 'bigint' AS type, 0 AS null_count, least(count(*), 100) AS unique_count, least(count(*), 100) AS row_count FROM orders
 UNION ALL SELECT 'nothing', 'string', least(count(*), 100), 0, least(count(*), 100) FROM orders""")
def source_preview(t: Tables):
    report = inspect.source_preview(t.orders.select("o_orderkey", F.lit(None).cast("string").alias("nothing")), 100)
    found = [(c["name"], c["type"], c["null_count"], c["unique_count"], report["row_count"]) for c in report["columns"]]
    return t.spark.createDataFrame(found, "name string, type string, null_count long, unique_count long, row_count long")


_STEPS = [
    {"type": "filter", "config": {"rules": [{"column": "o_orderstatus", "operator": "equals", "value": "F"}]}},
    {"type": "clean", "config": {"operations": [{"column": "o_orderpriority", "operation": "lowercase"}]}},
    {"type": "rename", "config": {"rename_map": {"o_orderpriority": "priority"}}},
    {"type": "drop", "config": {"columns": ["o_custkey"]}, "enabled": False},
    {"type": "aggregate", "config": {"group_by": ["priority"], "aggregations": [
        {"column": "o_orderkey", "function": "count", "alias": "n"}, {"column": "o_totalprice", "function": "max", "alias": "top"}]}},
]


@query("run_steps", """SELECT lower(o_orderpriority) AS priority, count(o_orderkey) AS n, max(o_totalprice) AS top
 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def run_steps_query(t: Tables):
    return run_steps(t.orders, _STEPS)


@query("preview_steps", """SELECT least(count(*), 100) AS rows_in, least(count(*), 100) AS rows_out,
 'o_custkey,o_orderdate,o_orderkey,o_orderpriority,price' AS names FROM orders""")
@query("pipeline_preview", """SELECT least(count(*), 100) AS rows_in, least(count(*), 100) AS rows_out,
 'o_custkey,o_orderdate,o_orderkey,o_orderpriority,price' AS names FROM orders""")
def preview_steps(t: Tables):
    report = preview(t.orders, [
        {"type": "filter", "config": {"column": "o_orderkey", "operator": ">=", "value": 0}},
        {"type": "rename", "config": {"rename_map": {"o_totalprice": "price"}}},
        {"type": "drop", "config": {"columns": ["o_orderstatus"]}},
    ])
    row = (report["original_shape"][0], report["transformed_shape"][0], ",".join(sorted(report["columns"])))
    return t.spark.createDataFrame([row], "rows_in long, rows_out long, names string")


@query("file_inventory", """SELECT 'txt' AS extension, count(DISTINCT n_regionkey * 5 + n_nationkey % 5) AS file_count,
 sum(strlen(n_name) + 1)::BIGINT AS total_size, least(count(DISTINCT n_regionkey * 5 + n_nationkey % 5), 5)::INTEGER AS samples, true AS first_ones FROM nation
 UNION ALL SELECT 'dat', count(DISTINCT r_regionkey), sum(strlen(r_name) + 1)::BIGINT, least(count(DISTINCT r_regionkey), 5)::INTEGER, true FROM region""")
def file_inventory(t: Tables):
    """More files of one kind than samples, of known sizes."""
    root = t.scratch("inventory")
    part = (F.col("n_regionkey") * 5 + F.col("n_nationkey") % 5).alias("part")
    t.nation.select("n_name", part).repartition("part").write.partitionBy("part").text(f"{root}/a")
    t.region.select("r_name", F.col("r_regionkey").alias("part")).repartition("part").write.partitionBy("part").text(f"{root}/b")
    listing = file_listing(t.spark, root, "*.txt")
    listing = listing.withColumn("path", F.when(F.col("path").contains("/b/"), F.regexp_replace("path", "txt$", "DAT")).otherwise(F.col("path")))
    found = inspect.file_inventory(listing)
    paths = listing.groupBy(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("extension")).agg(
        F.slice(F.sort_array(F.collect_list("path")), 1, 5).alias("wanted"))
    return found.join(paths, "extension").select(
        "extension", "file_count", "total_size", F.size("sample_files").alias("samples"), (F.col("sample_files") == F.col("wanted")).alias("first_ones"))


def _moved(df, column: str):
    """The same rows in other places; a task gets no more than the advisory size, however many rows there are or share a value."""
    return df.hint("rebalance", F.col(column))


@query("snapshot_hash", """SELECT k AS kind, count(*) + (k = 'repeated')::INTEGER AS data_rows, k IN ('same', 'moved') AS alike
 FROM lineitem, (VALUES ('same'), ('moved'), ('changed'), ('swapped'), ('repeated')) v(k) GROUP BY k""")
def snapshot_hash_query(t: Tables):
    """Row order changes nothing; one changed cell, two swapped cells or a repeated row do."""
    df = t.lineitem
    row = F.struct(*df.columns)
    one = row == df.agg(F.min(row)).scalar()
    kinds = {
        "same": df, "moved": _moved(df, "l_partkey"),
        "changed": df.withColumn("l_tax", F.when(one, F.col("l_tax") + 0.01).otherwise(F.col("l_tax"))),
        "swapped": df.withColumns({"l_returnflag": F.when(one, F.col("l_linestatus")).otherwise(F.col("l_returnflag")),
                                   "l_linestatus": F.when(one, F.col("l_returnflag")).otherwise(F.col("l_linestatus"))}),
        "repeated": df.unionByName(df.filter(one)),
    }
    found = reduce(lambda a, b: a.unionByName(b), [snapshot_hash(d).withColumn("kind", F.lit(k)) for k, d in kinds.items()])
    plain = snapshot_hash(df).select(F.col("hash_sum").alias("s"), F.col("hash_xor").alias("x"))
    alike = (F.col("hash_sum") == F.col("s")) & (F.col("hash_xor") == F.col("x"))
    return found.join(F.broadcast(plain)).select("kind", "data_rows", alike.alias("alike"))


@query("snapshot_step", "SELECT 0 AS step_index, 'keep' AS step_name, count(*) AS data_rows, 6 AS data_columns FROM orders WHERE o_orderstatus = 'F'")
def snapshot_step(t: Tables):
    store = Snapshots(t.spark, t.scratch("snapshots"), "run")
    store.save(t.orders.filter("o_orderstatus = 'F'"), 0, "keep")
    return store.list().select("step_index", "step_name", "data_rows", "data_columns")


@query("snapshot_list", "SELECT i AS step_index, 'active' AS status, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS data_rows FROM range(3) r(i)")
def snapshot_list(t: Tables):
    store = Snapshots(t.spark, t.scratch("snapshots"), "run")
    run_steps(t.orders, _STEPS[:3], snapshots=store)
    return store.list().select(F.col("step_index").cast("long").alias("step_index"), "status", "data_rows")


@query("snapshot_before", """SELECT 'before_step' AS type, 0 AS step_index, count(*) AS data_rows, 0 AS next_step, 1 AS active FROM orders
 UNION ALL SELECT 'after_step', 1, count(*), 2, 3 FROM orders WHERE o_orderstatus = 'F'""")
def snapshot_before(t: Tables):
    """State of a run whose first step fails, and of the run that resumes with the stored input."""
    store = Snapshots(t.spark, t.scratch("snapshots"), "run")
    broken = {"type": "custom_python", "config": {"function": lambda df: df.select("no_such_column")}}
    try:
        run_steps(t.orders, [broken], snapshots=store, snapshot_before=True)
    except Exception:  # noqa: BLE001 - the failure is the point
        pass
    names = ["type", "step_index", "data_rows", "next_step", "active"]
    failed = t.spark.createDataFrame(store.state().select(*names).collect(), "type string, step_index int, data_rows long, next_step int, active long")
    run_steps(t.orders.limit(0), _STEPS[:2], snapshots=store, resume=True)
    return failed.unionByName(store.state().select(*names))


@query("resume_from", """SELECT lower(o_orderpriority) AS priority, count(o_orderkey) AS n, max(o_totalprice) AS top
 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1""")
def resume_from(t: Tables):
    store = Snapshots(t.spark, t.scratch("snapshots"), "run")
    run_steps(t.orders, _STEPS[:2], snapshots=store)
    # the input is not read again: the run continues after the stored step
    return run_steps(t.orders.limit(0), _STEPS, snapshots=store, resume=True)


@query("rollback_to", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def rollback_to(t: Tables):
    store = Snapshots(t.spark, t.scratch("snapshots"), "run")
    run_steps(t.orders, _STEPS[:3], snapshots=store)
    return store.rollback_to(0).select("o_orderkey", "o_orderpriority")


_RUNS = """WITH r AS (SELECT event_type AS job_id, CASE WHEN value < 2 THEN 'failed' WHEN value < 50 THEN 'success' ELSE 'running' END AS status,
 ts AS start_time, ts + to_seconds((user_id % 60)::INTEGER) AS end_time, user_id % 60 AS secs FROM events) """


@query("run_statistics", _RUNS + """SELECT job_id, count(*) AS total_runs, count(*) FILTER (status = 'success') AS successful_runs,
 count(*) FILTER (status = 'failed') AS failed_runs, round(count(*) FILTER (status = 'success') * 100.0 / count(*), 6)::DOUBLE AS success_rate,
 round(avg(secs), 6) AS average_duration, max(start_time) AS last_run FROM r GROUP BY job_id""")
def run_statistics(t: Tables):
    status = F.when(F.col("value") < 2, "failed").when(F.col("value") < 50, "success").otherwise("running")
    log = t.events.select(
        F.col("event_type").alias("job_id"), status.alias("status"), F.col("ts").alias("start_time"),
        (F.col("ts") + F.make_dt_interval(secs=(F.col("user_id") % 60).cast("decimal(18,6)"))).alias("end_time"),
    )
    stats = inspect.run_statistics(log)
    return stats.withColumns({"success_rate": F.round(F.col("success_rate").cast("double"), 6),
                              "average_duration": F.round("average_duration", 6)})
