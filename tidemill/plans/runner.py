"""Runs a list of step configs as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame

from tidemill.operators import aggregate as agg
from tidemill.operators import columns, fill, joins, rows, sql
from tidemill.operators.snapshots import Snapshots
from tidemill.plans import config as cfg

Step = Callable[[DataFrame], DataFrame]
Sources = Mapping[str, DataFrame]


def _filter(c, sources) -> Step:
    n = cfg.filter_config(c)
    return lambda df: rows.filter_rows(df, n["rules"], n["logical_operator"])


def _clean(c, sources) -> Step:
    n = cfg.clean_config(c)
    return lambda df: rows.clean(df, n["rules"])


def _aggregate(c, sources) -> Step:
    n = cfg.aggregate_config(c)
    agg.expand_aggregations(n["aggregations"])
    return lambda df: agg.aggregate(df, **n)


def _join(c, sources) -> Step:
    n = cfg.join_config(c)
    right = n["right"]
    if not isinstance(right, DataFrame):
        if right not in sources:
            raise ValueError(f"Unknown join source: {right}")
        foreign = n["left"] is not None and n["left"] != right
        prefixes = {"left_prefix": f"ds{n['left']}_", "right_prefix": f"ds{right}_"} if foreign else {}
        right = sources[right]
    else:
        prefixes = {}
    return lambda df: joins.join(df, right, n["on"], n["how"], n["null_safe"], n["suffixes"], **prefixes)


def _split(c, sources) -> Step:
    names = ("column", "new_columns", "delimiter", "pattern", "keep_original")
    return lambda df: columns.split_column(df, **{k: c[k] for k in names if k in c})


def _merge(c, sources) -> Step:
    names = ("columns", "new_column", "separator", "drop_original")
    return lambda df: columns.merge_columns(df, **{k: c[k] for k in names if k in c})


def _convert(c, sources) -> Step:
    specs = cfg.conversion_configs(c)

    def step(df: DataFrame) -> DataFrame:
        for s in specs:
            df = rows.convert(df, **s)
        return df

    return step


def _rename(c, sources) -> Step:
    return lambda df: columns.rename(df, c.get("rename_map", c.get("mapping", {})))


def _drop(c, sources) -> Step:
    return lambda df: columns.drop(df, c.get("columns", []))


def _fill(c, sources) -> Step:
    method, column = c.get("method", "value"), c.get("column")
    order, parts = c.get("order_by", ()), c.get("partition_by", ())
    if method in ("forward", "backward"):
        targets = [column] if column else None
        return lambda df: fill.fill_carried(df, targets, order, parts, method)
    if method == "value":
        value = c.get("value", "")
        return lambda df: fill.fill_value(df, column, value) if column else fill.fill_all_value(df, value)
    by_statistic = {"mean": fill.fill_mean, "median": fill.fill_median, "mode": fill.fill_mode}
    if method not in by_statistic or not column:
        raise ValueError(f"Unknown fill method: {method}")
    return lambda df: by_statistic[method](df, column)


def _sql(c, sources) -> Step:
    return lambda df: sql.step_sql(df, c.get("query", c.get("sql", "")))


def _python(c, sources) -> Step:
    if not callable(c.get("function")):
        raise ValueError("a Python step needs a callable 'function'")
    return lambda df: sql.step_python(df, c["function"], **c.get("parameters", {}))


_BUILDERS: dict[str, Callable[[Mapping[str, Any], Sources], Step]] = {
    "filter": _filter, "clean": _clean, "aggregate": _aggregate, "join": _join, "split": _split, "merge": _merge,
    "type_conversion": _convert, "rename": _rename, "drop": _drop, "fill_null": _fill, "custom_sql": _sql,
    "custom_python": _python,
}


def make_step(step: Mapping[str, Any], sources: Sources | None = None) -> Step:
    """Callable for one step ``{type, config}``."""
    kind = cfg.step_type(step.get("type", step.get("step_type")))
    return _BUILDERS[kind](step.get("config", step), sources or {})


def run_steps(
    df: DataFrame,
    steps: Sequence[Mapping[str, Any]],
    sources: Sources | None = None,
    fail_on_empty: bool = False,
    snapshots: Snapshots | None = None,
    resume: bool = False,
    snapshot_before: bool = False,
) -> DataFrame:
    """Fold the steps over a frame; steps with ``enabled: false`` are skipped.

    With ``snapshots`` each result is stored and the next step reads the stored rows; ``resume`` continues
    after the newest stored step. ``snapshot_before`` also stores what goes into the first step that runs and into each
    step marked ``checkpoint_before: true``, so that a run which fails there resumes with its very input.
    """
    made = [(s.get("name", str(i)), make_step(s, sources) if s.get("enabled", True) else None)
            for i, s in enumerate(steps)]
    start = 0
    if resume and snapshots is not None:
        found = snapshots.resume()
        if found:
            df, start = found
    first = next((i for i, (_, step) in enumerate(made) if i >= start and step is not None), None)
    for i, (name, step) in enumerate(made):
        if i < start or step is None:
            continue
        if snapshots is not None and snapshot_before and (i == first or steps[i].get("checkpoint_before")):
            df = snapshots.save(df, i, name, "before_step")
        df = df.transform(step)
        if snapshots is not None:
            df = snapshots.save(df, i, name)
        if fail_on_empty and df.isEmpty():
            raise ValueError(f"step '{name}' left no rows")
    return df


def preview_steps(
    df: DataFrame, steps: Sequence[Mapping[str, Any]], sources: Sources | None = None, preview_rows: int = 100
) -> dict[str, Any]:
    """Run the steps on the first rows and report shapes, columns and types."""
    head = df.limit(preview_rows)
    out = run_steps(head, steps, sources)
    sample = [r.asDict(recursive=True) for r in out.limit(preview_rows).collect()]
    return {
        "original_shape": (head.count(), len(df.columns)), "transformed_shape": (out.count(), len(out.columns)),
        "columns": out.columns, "data_types": dict(out.dtypes), "data": sample,
    }
