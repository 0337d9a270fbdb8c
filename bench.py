"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line {"metric", "value", "unit", "queries", "sf"}.

Each query is executed completely through the ``noop`` sink (no collect to
the driver); the JVM is warmed up first and not timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "kappa_by_variant",       # agreement: one scan of all label sets
    "fleiss_kappa",
    "kappa_pair_matrix",
    "confusion_long",
    "postings",               # index build (in-row term frequencies)
    "rank_all_models",        # 21 weighting models, top-1000 per topic/model
    "evaluate_runs",          # MAP / P@k / nDCG@k for two label sets
    "sensitivity",            # paired t-tests over all model pairs
    "kendall_tau_models",
    "clean_relation",         # web-table ingest
    "rated_tables_inner",     # 8-way judgement join
    "tables_for_qrels_right",
    "render_prompt",          # prompt construction
    "token_lengths",
    "cost_kth",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from relkit.plans.registry import queries
    from relkit.session import get_session
    spark = get_session(app="relkit-bench", master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": "16g"})
    qs = queries()
    # warm-up: JVM, parquet readers, Python workers
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
        print(f"# {n}: {times[n]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
