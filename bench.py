"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs per
query (median counts, after one warm-up run), ``BENCH_ALL=1`` takes every query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tidemill.catalog import all_queries
from tidemill.session import build_session

HEADLINE = (
    # filters, cleaning, conversion
    "filter_and", "filter_or", "filter_not_contains", "clean_trim", "clean_remove_punctuation", "clean_remove_html",
    "clean_remove_urls", "convert_integer", "convert_date", "convert_boolean", "cast_on_load",
    # columns and fill
    "split_delimiter", "merge_columns", "add_surrogate_id", "fill_forward", "fill_backward", "fill_forward_all",
    "fill_mean", "fill_median", "fill_mode",
    # relations
    "agg_group", "agg_median", "agg_median_price", "agg_first", "agg_count_distinct", "join_inner", "join_full",
    "join_chain", "join_check", "anti_join", "union", "except_all", "top_n", "sql_exists", "sql_group_having", "step_pandas",
    # quality and inspection
    "validate", "rule_unique", "issues_by_type", "isolate_quarantine", "infer_types", "column_statistics", "snapshot_hash",
    # documents, changes, sources, sinks
    "flatten_envelope", "unwrap_response", "current_state", "apply_changes", "read_text_lines", "read_parquet",
    "write_csv", "save_upsert", "stream_apply_changes",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        {"spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    names = list(registered) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in registered]
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 4)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 4), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
