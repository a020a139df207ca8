"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is fully materialised with a ``noop`` write (all rows computed,
nothing collected to the driver).  The shared preparation (labelled log and
sequence numbering) is timed separately as ``prepare_*``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rectide.plans.prepare import content_bundle, watch_bundle  # noqa: E402
from rectide.plans.queries import REGISTRY  # noqa: E402
from rectide.session import build_session  # noqa: E402

HEADLINE = [
    "sequence_positions",
    "time_deltas",
    "popular_topk",
    "eval_popular",
    "itemcf_neighbors",
    "itemcf_topk",
    "item_features",
    "user_features",
    "beam_search",
    "generative_topk",
    "cosine_topk",
    "mean_query_topk",
    "ranking_metrics",
    "freshness_longtail",
    "rerank",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(app_name="rectide-bench")
    timings: dict[str, float] = {}

    t0 = time.time()
    watch_bundle(spark, sf_dir).seq.write.format("noop").mode("overwrite").save()
    timings["prepare_watch"] = round(time.time() - t0, 3)
    t0 = time.time()
    content_bundle(spark, sf_dir).seq.write.format("noop").mode("overwrite").save()
    timings["prepare_content"] = round(time.time() - t0, 3)

    for name in names:
        t0 = time.time()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - t0, 3)
        print(f"# {name}: {timings[name]}s", file=sys.stderr, flush=True)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
