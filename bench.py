"""Headline timings: one JSON line, every query read from the tables and run to the end.

Each query builds all of its intermediate tables inside its own time. The JVM and the Python
workers are warmed on another folder, whose time is printed apart.

BENCH_SF_DIR, BENCH_WARM_DIR and BENCH_CPUS choose data and cores.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from loomline.functions.session import local_session  # noqa: E402
from loomline.plans.catalog import QUERIES  # noqa: E402
from loomline.plans.tables import Tables  # noqa: E402

HEADLINE = [
    "attention_daily", "trailing_vol", "shocks_w5", "kernel_cov", "kernel_cov_blocks", "kernel_cov_wide", "panel_moments", "lambda_path", "oos_run",
    "study_metrics", "study_wide", "pricing_k1", "term_impact", "link_map", "elastic_net", "window_sweep", "spearman_ties", "fix_100x", "compare_sources",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), 8, "bench")
    warm_dir, start = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001"), time.perf_counter()
    for name in ("shocks_w5", "panel_moments"):
        QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    print("warm-up", round(time.perf_counter() - start, 3), file=sys.stderr, flush=True)
    seconds = {}
    for name in HEADLINE:
        Tables.forget()
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
