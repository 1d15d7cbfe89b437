"""Wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 4) the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vistrata.catalog import QUERIES  # noqa: E402
from vistrata.session import local_session  # noqa: E402

HEADLINE = [
    "kpis", "basic_statistics", "spread_and_moments", "percentiles", "percentiles_two_pass", "modes",
    "distinct_counts", "histograms", "correlation_matrix", "linear_regression", "spearman", "full_statistics",
    "value_counts", "chart_bars", "group_detail", "series_preview", "distinct_rows", "clean_table",
    "categorical_summary", "isolation_forest_scores", "prepared_series", "forecast_daily_orders", "sql_question",
    "stage_question",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    # The first job pays for starting the JVM's code paths, not for any query.
    QUERIES["value_counts"](spark, sf_dir).collect()
    seconds, warm = {}, {}
    # The first run compiles a query's generated code; the second one is what a session pays from then on.
    for taken in (seconds, warm):
        for name in HEADLINE:
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.time() - started, 3)
            print(f"{name}: {taken[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "warm": warm, "warm_total": round(sum(warm.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": cores}))
    spark.stop()


if __name__ == "__main__":
    main()
