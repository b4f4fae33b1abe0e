"""Time the headline queries on one machine and print one JSON line.

Each query runs twice and the better time counts: the first run of a plan is
mostly the compilation of its generated code.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default
all), BENCH_QUERIES (comma list, default the headline queries).
"""

from __future__ import annotations

import json
import os
import time

from checks.compare import local_session
from checks.queries import QUERIES

HEADLINE = (
    "scan_project_filter", "run_sql_passthrough", "redact_rows", "redact_conversations", "redact_pages",
    "scan_text_pii", "redact_text_spans", "anon_sql", "classify_columns", "classify_statements",
    "mask_credentials", "query_stats", "top_queries_total", "top_queries_resources", "table_constraints",
    "table_details", "duplicate_indexes", "index_bloat", "wraparound_headroom", "health_report",
    "validate_unique", "validate_not_null", "validate_foreign_key", "column_stats", "key_headroom",
    "stream_redact_events",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus)
    # start the JVM, its compiler and the session catalog outside the timings
    QUERIES["run_sql_passthrough"](spark, directory).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
