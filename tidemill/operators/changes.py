"""Change logs: the current state of a table and the application of changes to a base table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.quoting import named
from tidemill.session import require_columns
from tidemill.sinks.tables import latest_rows


def current_state(
    log: DataFrame, keys: Sequence[str], sequence: Sequence[str], operation: str = "op",
    delete_values: Sequence[str] = ("delete",),
) -> DataFrame:
    """Newest row per key of an append-only log, without keys whose newest change is a delete."""
    require_columns(log, [operation])
    newest = latest_rows(log, keys, sequence)
    return newest.filter(F.coalesce(~named(operation).isin(list(delete_values)), F.lit(True)))


def apply_changes(
    base: DataFrame, log: DataFrame, keys: Sequence[str], sequence: Sequence[str], operation: str = "op",
    delete_values: Sequence[str] = ("delete",),
) -> DataFrame:
    """Base table after a log of changes: per key the newest change wins and deletes remove the row."""
    newest = latest_rows(log, keys, sequence)
    touched = newest.select(*[named(k).alias(f"__n_{k}") for k in keys])
    same = F.lit(True)
    for k in keys:
        same = same & named(k).eqNullSafe(named(f"__n_{k}"))
    untouched = base.join(touched, same, "left_anti")
    alive = newest.filter(F.coalesce(~named(operation).isin(list(delete_values)), F.lit(True)))
    changed = alive.select(*[
        (named(f.name).cast(f.dataType) if f.name in log.columns else F.lit(None).cast(f.dataType)).alias(f.name)
        for f in base.schema.fields
    ])
    return untouched.unionByName(changed)
