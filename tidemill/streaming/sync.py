"""Streaming synchronisation: follow a source, reshape its messages, append or apply changes.

Each micro-batch is written to a folder named by the run and the batch id, overwritten as a whole. A batch that is
replayed after a failure therefore replaces its own rows and nothing is lost or repeated. The run is the id that the
checkpoint gave the query: a query that starts with a new checkpoint counts its batches anew, in folders of its own.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemill.functions.cleaning import value_transformed
from tidemill.functions.quoting import named
from tidemill.operators.changes import apply_changes, current_state
from tidemill.operators.columns import add_metadata, rename, select_columns
from tidemill.session import materialize
from tidemill.sinks import tables, versions

RUN = "_run"
BATCH = "_batch"
_SEQUENCES = "_sequences"


def kafka_options(config: Mapping[str, Any]) -> dict[str, str]:
    """Kafka reader options of a connection config."""
    servers = config["bootstrap_servers"]
    options = {
        "kafka.bootstrap.servers": servers if isinstance(servers, str) else ",".join(servers),
        "subscribe": config["topic"], "startingOffsets": config.get("starting_offsets", "earliest"),
    }
    renamed = {
        "security_protocol": "kafka.security.protocol", "sasl_mechanism": "kafka.sasl.mechanism",
        "sasl_jaas_config": "kafka.sasl.jaas.config", "group_id": "kafka.group.id",
    }
    return options | {theirs: config[ours] for ours, theirs in renamed.items() if config.get(ours)}


def _envelope(df: DataFrame) -> DataFrame:
    return df.select(
        "offset", "partition", F.unix_millis("timestamp").alias("timestamp"), F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def stream_source(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """Stream of a Kafka topic, or of new files in a folder (``format``, ``path``, ``schema``)."""
    if config.get("type") == "kafka":
        return _envelope(spark.readStream.format("kafka").options(**kafka_options(config)).load())
    reader = spark.readStream.format(config.get("format", "json")).schema(config["schema"])
    if config.get("max_files_per_trigger"):
        reader = reader.option("maxFilesPerTrigger", config["max_files_per_trigger"])
    return reader.options(**config.get("options", {})).load(config["path"])


def stream_preview(spark: SparkSession, config: Mapping[str, Any], limit: int = 100) -> DataFrame:
    """A few messages of a stream's source, read in batch: no consumer position moves."""
    if config.get("type") == "kafka":
        return _envelope(spark.read.format("kafka").options(**kafka_options(config)).load()).limit(limit)
    reader = spark.read.format(config.get("format", "json")).schema(config["schema"])
    return reader.options(**config.get("options", {})).load(config["path"]).limit(limit)


def stream_transforms(df: DataFrame, transforms: Mapping[str, Any]) -> DataFrame:
    """Column mapping, column selection and value changes, in this order."""
    if transforms.get("column_mapping"):
        known = {k: v for k, v in transforms["column_mapping"].items() if k in df.columns}
        df = rename(df, known)
    if transforms.get("include_columns"):
        df = select_columns(df, transforms["include_columns"])
    changes: dict[str, Column] = {}
    for column, change in (transforms.get("value_transforms") or {}).items():
        if column in df.columns:
            changes[column] = value_transformed(
                named(column), change["type"], change.get("from", ""), change.get("to", "")
            )
    return df.withColumns(changes) if changes else df


def route_changes(df: DataFrame, operation: str = "op", soft_delete: bool = False) -> DataFrame:
    """Rows to append: inserts, updates and messages; deletes as marked rows, or not at all."""
    deleted = F.coalesce(named(operation) == "delete", F.lit(False))
    marked = df.withColumn("_deleted", deleted)
    return marked if soft_delete else marked.filter(~deleted).drop("_deleted")


def write_batches(
    stream: DataFrame, target: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
    available_now: bool = True, **trigger: Any,
) -> StreamingQuery:
    """Append a stream to a Parquet folder, exactly once per batch."""

    run: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if not run:  # written before the first batch
            run.append(json.loads(batch.sparkSession.read.text(f"{checkpoint}/metadata").first()[0])["id"])
        out = prepare(batch) if prepare else batch
        out.write.mode("overwrite").parquet(f"{target}/{RUN}={run[0]}/{BATCH}={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if available_now else trigger)).start()


def read_batches(spark: SparkSession, target: str) -> DataFrame:
    """All rows a stream has appended, each with the number of its batch."""
    return spark.read.parquet(target).drop(RUN)


def _batches(spark: SparkSession, log: str, after: Mapping[str, int]) -> dict[tuple[str, int], str]:
    """Folders of the batches of a log by run and number, later ones than ``after`` says for their run."""
    found = {}
    for path in versions.matching(spark, f"{log}/{RUN}=*/{BATCH}=*"):
        *_, run, batch = path.split("/")
        run, number = run.removeprefix(f"{RUN}="), int(batch.removeprefix(f"{BATCH}="))
        if number > after.get(run, -1) and versions.folder_exists(spark, f"{path}/_SUCCESS"):
            found[run, number] = path
    return found


def sync_stream(
    stream: DataFrame, target: str, checkpoint: str, transforms: Mapping[str, Any] | None = None,
    operation: str | None = None, soft_delete: bool = False, available_now: bool = True, **trigger: Any,
) -> StreamingQuery:
    """Transform a stream, add the synchronisation columns, and append it."""

    def prepare(batch: DataFrame) -> DataFrame:
        if operation:
            batch = route_changes(batch, operation, soft_delete)
        batch = stream_transforms(batch, transforms or {})
        if operation and operation in batch.columns:
            out = add_metadata(batch, "message")
            return out.withColumn("_sync_operation", named(operation))
        return add_metadata(batch, "message")

    return write_batches(stream, target, checkpoint, prepare, available_now, **trigger)


def changes_stream(
    stream: DataFrame, log: str, checkpoint: str, available_now: bool = True, **trigger: Any
) -> StreamingQuery:
    """Append change events, deletes included, to a change log that ``state_of`` reads."""
    return write_batches(stream, log, checkpoint, None, available_now, **trigger)


def state_of(
    spark: SparkSession, log: str, keys: Sequence[str], sequence: Sequence[str], operation: str = "op",
    base: DataFrame | None = None,
) -> DataFrame:
    """Table behind a change log: the base table with the newest change per key applied.

    Merging at read time keeps each micro-batch as small as its own events; ``compact`` folds the log from time to time.
    For a table that ``compact`` has made see ``state_of_table``.
    """
    changes = read_batches(spark, log).drop(BATCH)
    if base is None:
        return current_state(changes, keys, sequence, operation)
    return apply_changes(base, changes, keys, sequence, operation)


def _later_changes(spark: SparkSession, log: str, table: str, keys: Sequence[str], sequence: Sequence[str]):
    """``(newest, sequences, batches)``: per key the newest change not yet folded into the table, unless the table holds a later one.

    ``sequences`` are those of the changes folded so far, by key, deleted keys included; None before the first fold.
    """
    folder = tables.location_of(spark, table) if spark.catalog.tableExists(table) else None
    facts = versions.read_facts(spark, folder) if folder else {}
    batches = _batches(spark, log, facts.get("folded", {}))
    known = spark.read.parquet(f"{folder}/{_SEQUENCES}") if facts else None
    if not batches:
        return None, known, batches, facts
    changes = spark.read.option("basePath", log).parquet(*batches.values()).drop(RUN, BATCH)
    newest = tables.latest_rows(changes, keys, sequence)
    if known is not None:
        seen = known.select(*[F.col(f"k{i}").alias(f"__k{i}") for i in range(len(keys))], F.col("sequence").alias("__seen"))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & named(k).eqNullSafe(F.col(f"__k{i}"))
        place = F.struct(*[named(c).alias(f"s{i}") for i, c in enumerate(sequence)])
        newest = newest.join(seen, same, "left").where(F.col("__seen").isNull() | (place > F.col("__seen"))).select(*[named(c) for c in changes.columns])
    return newest, known, batches, facts


def state_of_table(
    spark: SparkSession, log: str, table: str, keys: Sequence[str], sequence: Sequence[str], operation: str = "op",
) -> DataFrame:
    """A table that ``compact`` keeps, with the changes that it has not folded yet; earlier batches are not read."""
    newest, *_ = _later_changes(spark, log, table, keys, sequence)
    base = spark.table(table)
    return base if newest is None else apply_changes(base, newest, keys, sequence, operation)


def compact(
    spark: SparkSession, log: str, table: str, keys: Sequence[str], sequence: Sequence[str], operation: str = "op",
    location: str | None = None, remove_folded: bool = True,
) -> None:
    """Fold the batches that came since the last time into the base table (made when absent).

    What has been folded, and the sequence of each key's last change, is kept with the new version of the table, so both
    hold from the same moment on. A change that arrives after a later one of its key was folded changes nothing. A
    failure before the table points at its new version leaves the old one, and the next call folds the same batches
    again; a failure after it leaves folders that are no longer read. Folded batches are removed.
    """
    newest, known, batches, facts = _later_changes(spark, log, table, keys, sequence)
    if newest is None:
        return
    newest = materialize(newest)
    exists = spark.catalog.tableExists(table)
    folded = apply_changes(spark.table(table), newest, keys, sequence, operation) if exists else current_state(newest, keys, sequence, operation)
    folder = tables.write_version(folded, tables.base_of(spark, table, location))
    names = [F.col(f"k{i}") for i in range(len(keys))]
    places = newest.select(*[named(k).alias(f"k{i}") for i, k in enumerate(keys)], F.struct(*[named(c).alias(f"s{i}") for i, c in enumerate(sequence)]).alias("sequence"))
    if known is not None:
        places = known.unionByName(places).groupBy(*names).agg(F.max("sequence").alias("sequence"))
    places.write.parquet(f"{folder}/{_SEQUENCES}")
    last = dict(facts.get("folded", {}))
    for run, number in batches:
        last[run] = max(number, last.get(run, -1))
    versions.write_facts(spark, folder, {"folded": last})
    tables.publish(spark, table, folder, folded.schema)
    if remove_folded:
        for path in batches.values():
            versions.remove(spark, path)
