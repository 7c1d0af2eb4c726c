"""Benchmark of the headline queries.

Runs each query at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints ONE JSON line.  Every query is executed
completely through the ``noop`` sink (no driver-side collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "rpt_status_counts", "rpt_progress", "sel_pending", "rpt_reconcile_missing",
    "cat_upsert", "cat_apply_transitions",
    "bnd_census", "bnd_global",
    "dlo_retry_schedule", "dlo_batch_summary",
    "com_curated", "com_file_states",
    "gen_needle_corpus", "gen_lookup_corpus", "gen_real_passages",
    "tok_hashed_ids", "tok_vocab", "tok_batches",
    "mem_token_table", "mem_summaries", "mem_refresh",
    "ret_doc_scores", "ret_fine_doc_mass", "ret_rounds",
    "evl_accuracy", "evl_hit_rate", "tel_epoch_means", "tel_needle_precision",
    "str_status_fold", "str_window_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [a for a in sys.argv[1:]]
    from corpusflow.plans.registry import all_queries
    from corpusflow.session import build_session

    spark = build_session(f"local[{cpus}]", max(cpus, 8),
                          extra={"spark.driver.memory": "16g", "spark.sql.files.maxPartitionBytes": str(64 << 20)})
    qs = all_queries()
    names = only or HEADLINE
    # warm-up: JVM, parquet footers, Python workers
    qs["rpt_status_counts"].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        try:
            qs[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        except Exception as e:  # record and continue
            print(f"{name} failed: {str(e).splitlines()[0][:200]}", file=sys.stderr)
            times[name] = None
    ok = [v for v in times.values() if v is not None]
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(ok), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "failed": [k for k, v in times.items() if v is None]}))


if __name__ == "__main__":
    main()
