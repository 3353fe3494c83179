"""Queries that run a stream over the given tables to its end and read what it wrote."""

from pyspark.sql import functions as F

from tidemill.catalog.document_queries import change_log
from tidemill.catalog.registry import Tables, query
from tidemill.sinks.files import write_parquet
from tidemill.sources.envelopes import flatten_envelope
from tidemill.streaming import sync


def _stream(t: Tables, name: str, path: str | None = None, **options):
    schema = t.spark.read.parquet(path).schema if path else getattr(t, name).schema
    source = {"format": "parquet", "path": path or f"{t.path(name)}*", "schema": schema, **options}
    return sync.stream_source(t.spark, source)


def _finished(running) -> None:
    running.awaitTermination()


@query("stream_source", "SELECT event_id, user_id, event_type FROM events")
def stream_source(t: Tables):
    target, mark = t.scratch("target"), t.scratch("mark")
    _finished(sync.write_batches(_stream(t, "events").select("event_id", "user_id", "event_type"), target, mark))
    return sync.read_batches(t.spark, target).drop(sync.BATCH)


@query("stream_preview", "SELECT least(count(*), 50) AS n, least(count(*), 50) AS of_the_source FROM events")
def stream_preview(t: Tables):
    """Different messages, all of them rows of the source."""
    source = {"format": "parquet", "path": t.path("events"), "schema": t.events.schema}
    found = sync.stream_preview(t.spark, source, 50)
    same = found.intersect(t.events).agg(F.count(F.lit(1))).scalar()
    return found.distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("of_the_source", same)


@query("stream_payload", "SELECT event_id, props, (props::JSON ->> 'k')::BIGINT AS props_k FROM events")
def stream_payload(t: Tables):
    target, mark = t.scratch("target"), t.scratch("mark")
    flat = flatten_envelope(_stream(t, "events").select("event_id", "props"), "props", "k bigint")
    _finished(sync.write_batches(flat, target, mark))
    return sync.read_batches(t.spark, target).drop(sync.BATCH)


@query("stream_metadata", "SELECT event_id, true AS stamped, 'message' AS _sync_operation FROM events")
def stream_metadata(t: Tables):
    target, mark = t.scratch("target"), t.scratch("mark")
    _finished(sync.sync_stream(_stream(t, "events").select("event_id"), target, mark))
    rows = sync.read_batches(t.spark, target)
    return rows.select("event_id", F.col("_sync_timestamp").isNotNull().alias("stamped"), "_sync_operation")


@query("stream_transforms", "SELECT user_id AS customer_id, upper(event_type) AS kind, replace(props, 'k', 'key') AS props FROM events")
def stream_transforms(t: Tables):
    target, mark = t.scratch("target"), t.scratch("mark")
    transforms = {
        "column_mapping": {"user_id": "customer_id", "event_type": "kind"},
        "include_columns": ["customer_id", "kind", "props"],
        "value_transforms": {"kind": {"type": "uppercase"}, "props": {"type": "replace", "from": "k", "to": "key"}},
    }
    _finished(sync.sync_stream(_stream(t, "events"), target, mark, transforms))
    return sync.read_batches(t.spark, target).select("customer_id", "kind", "props")


def _marked(t: Tables):
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "click", "update").otherwise("insert")
    return _stream(t, "events").select("event_id", "user_id", op.alias("op"))


@query("stream_append", """SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 'update' ELSE 'insert' END AS _sync_operation
 FROM events WHERE event_type <> 'error'""")
def stream_append(t: Tables):
    target, mark = t.scratch("target"), t.scratch("mark")
    _finished(sync.sync_stream(_marked(t), target, mark, operation="op"))
    return sync.read_batches(t.spark, target).select("event_id", "user_id", "_sync_operation")


@query("stream_soft_delete", "SELECT event_id, user_id, event_type = 'error' AS _deleted FROM events")
def stream_soft_delete(t: Tables):
    target, mark = t.scratch("target"), t.scratch("mark")
    _finished(sync.sync_stream(_marked(t), target, mark, operation="op", soft_delete=True))
    return sync.read_batches(t.spark, target).select("event_id", "user_id", "_deleted")


@query("stream_resume", "SELECT c_custkey, c_name, CASE WHEN c_acctbal < 3000 THEN 0 ELSE 1 END AS batch FROM customer")
def stream_resume(t: Tables):
    inbox, target, mark = t.scratch("inbox"), t.scratch("target"), t.scratch("mark")
    columns = ["c_custkey", "c_name"]
    write_parquet(t.customer.filter("c_acctbal < 3000").select(columns), inbox, mode="append")
    _finished(sync.write_batches(_stream(t, "customer", inbox), target, mark))
    write_parquet(t.customer.filter("c_acctbal >= 3000").select(columns), inbox, mode="append")
    # a new query with the same checkpoint reads only the new files
    _finished(sync.write_batches(_stream(t, "customer", inbox), target, mark))
    return sync.read_batches(t.spark, target).withColumnRenamed(sync.BATCH, "batch")


@query("stream_apply_changes", """WITH latest AS (SELECT user_id, arg_max(value, event_id) AS value,
 arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id)
 SELECT user_id, value FROM latest WHERE kind <> 'error' UNION ALL
 SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM latest)""")
def stream_apply_changes(t: Tables):
    log, mark, source = t.scratch("log"), t.scratch("mark"), t.scratch("changes")
    write_parquet(change_log(t), source)
    _finished(sync.changes_stream(_stream(t, "events", source, max_files_per_trigger=1), log, mark))
    base = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return sync.state_of(t.spark, log, ["user_id"], ["event_id"], base=base)
