"""Headline-query timings.

Runs each headline query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]``: one warm-up, then the median of
``$BENCH_RUNS`` (default 3) timed runs; each run builds the plan (including
any iterative, eager parts) and executes it fully into a no-op sink.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from agora.plans.registry import all_queries  # noqa: E402
from agora.session import local_session  # noqa: E402

HEADLINE = [
    "edges", "pagerank", "ranked_users", "clean_text", "lemmas", "phrased_tokens", "discussion_domains",
    "feature_rows", "thread_depth", "kl_content_domain", "domain_stats", "box_domain", "aqua_score",
    "feature_merge", "histogram20", "kde_grid", "dbscan", "coherence_cv",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16)
    qs = all_queries()
    names = [q for q in (only or HEADLINE) if q in qs]
    out = {}
    for name in names:
        times = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            qs[name](spark, sf).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                times.append(dt)
        out[name] = round(statistics.median(times), 3)
    total = round(sum(out.values()), 3)
    print(json.dumps({"metric": "headline_total_median_sec", "value": total, "unit": "sec", "queries": out,
                      "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
