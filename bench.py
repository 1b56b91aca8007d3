"""Benchmark: run every registered query at $BENCH_SF_DIR on local[$BENCH_CPUS] and
print one JSON line.

Each query is built and then fully executed with a ``noop`` write (every column is
numbers: warm JVM, median of $BENCH_REPEAT runs (default 3); Spark's cache is cleared
before every run, so tables persisted by one run never speed up the next. ``cold`` holds
each query's first run. Test views that are staged once per dataset (the rendered sheet
CSV, the typed sheet table, record sheets, spec table) are prepared before timing and
reported as ``staging_sec``. Queries over a stream's or a landing's state start from an empty
state in every run, so their times hold the whole ingest; ``refresh`` has the time of one more
run on the last state, without new files. Lookups in a state (``state_*``) share one: their first
run fills it.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    from plantwise.session import get_session

    spark = get_session(f"local[{cpus}]", int(cpus) * 2, app_name="plantwise-bench",
                        extra_conf={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    from plantwise.plans.catalog import QUERIES
    from plantwise.sources import fixtures as fxt
    from plantwise.streaming.ingest import NAMESPACE

    t0 = time.time()
    fxt.sheet_raw(spark, sf_dir)
    fxt.typed_sheet_table(spark, sf_dir)
    for name in fxt.RECORD_SHEETS:
        fxt.record_sheet_path(spark, sf_dir, name)
    fxt.spec_table_path(spark, sf_dir)
    staging = time.time() - t0

    # warm the JVM once (codegen, class loading) so the first query is not penalised
    QUERIES["calendar_attrs"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    refresh: dict[str, float] = {}
    failed: dict[str, str] = {}

    def run(name: str) -> float:
        spark.catalog.clearCache()
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.time() - t

    for name in sorted(QUERIES):
        if only and name not in only:
            continue
        runs = []
        try:
            stateful = name.startswith(("stream_", "landing_"))
            for _ in range(repeat):
                spark.conf.set(NAMESPACE, f"-{uuid.uuid4().hex}" if stateful else "")
                runs.append(run(name))
            if stateful:
                refresh[name] = round(run(name), 3)
            cold[name] = round(runs[0], 3)
            times[name] = round(sorted(runs)[len(runs) // 2], 3)
        except Exception as e:  # noqa: BLE001
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "staging_sec": round(staging, 3),
        "flagship": "oee_overall",
        "flagship_sec": times.get("oee_overall"),
        "repeat": repeat,
        "cold_total_sec": round(sum(cold.values()), 3),
        "cold": cold,
        "refresh": refresh,
    }
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
