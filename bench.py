"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` (comma separated, or
``all``) other queries than the default ones.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vaneworks.operators.scale import release_scratch  # noqa: E402
from vaneworks.plans.queries import QUERIES  # noqa: E402
from vaneworks.session import get_session  # noqa: E402

HEADLINE = [
    "c1_time_join",
    "c2_latest_image",
    "c3_apply_scaler",
    "c4_window_images",
    "d1_fit_scaler",
    "d4_roc_auc",
    "d5_mean_over_batches",
    "d6_pointwise_by_series",
    "d9_average_precision",
    "e1_series_position",
    "e2_sliding_windows",
    "e3_complete_windows",
    "e5_pool_and_fuse",
    "e6_one_giant_series",
    "f1_random_split",
    "f2_head_split",
    "f3_shuffled_batches",
    "g1_fit_logistic",
    "g3_linear_score",
    "g5_early_stopping",
    "h1_stream_scoring",
    "h2_stream_windows",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    asked = os.environ.get("BENCH_QUERIES")
    names = list(QUERIES) if asked == "all" else asked.split(",") if asked else HEADLINE
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["e3_complete_windows"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines

    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        release_scratch(spark)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
