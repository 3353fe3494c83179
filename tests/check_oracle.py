"""Run registered queries against DuckDB: ``python -m tests.check_oracle [folder] [name ...]``."""

import sys
import time
import traceback

from tests.oracle import difference, duck, duck_table, spark_table
from tidemill.catalog import all_oracles, all_queries
from tidemill.session import build_session

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("check", "local[8]", 8, {"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), all_oracles(), 0
    for name, run in all_queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = spark_table(run(spark, folder))
            took = time.time() - start
            problem = difference(got, duck_table(con, oracles[name])) if name in oracles else f"no oracle, {len(got[1])} rows"
            bad += bool(problem) and name in oracles
            print(f"{'ok ' if not problem else 'DIFF'} {name} rows={len(got[1])} {took:.2f}s {problem or ''}", flush=True)
        except Exception as error:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: {str(error)[:700]}", flush=True)
            if names:
                traceback.print_exc()
    print(f"{bad} problems")
