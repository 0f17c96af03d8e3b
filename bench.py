"""Times the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` (optional,
comma separated, or ``all``) the queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from sluice import plans
from sluice.session import build_session

HEADLINE = [
    "tumble_mean", "tumble_median", "tumble_last", "status_counts", "top_sensors", "latency_histogram",
    "to_points", "clean_numeric", "decode_sensor_json", "parse_timestamp", "rolling_features", "proxy_score",
    "moving_aggregate", "tail_sequence", "followup_join", "asof_latest", "offset_align", "corr_matrix",
    "mutual_info", "selection_run", "drop_then_rise", "cooldown", "energy_score", "percentile_threshold",
    "grid_search_f1", "incremental_fit", "forecast", "forecast_backtest", "error_by_step", "surrogate_dataset",
    "attribution", "topk_last", "stream_tumble", "stream_rolling", "pattern_stream",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    data = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    named = os.environ.get("BENCH_QUERIES", "")
    available = plans.queries()
    names = list(available) if named == "all" else named.split(",") if named else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    run(available["tumble_mean"](spark, data))
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        run(available[name](spark, data))
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(data.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
