"""Time the headline queries: one JSON line on standard output.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs once after one small
warm-up query, and its whole result is consumed without being collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "kcore",
    "encode_ids",
    "split_user_last_k",
    "split_global_time",
    "user_histories",
    "train_last_window",
    "train_sliding_windows",
    "eval_windows_test",
    "next_item_pairs",
    "item_probabilities",
    "genre_multihot",
    "encode_sequences",
    "exact_topk",
    "topk_masked",
    "ivf_search",
    "ivfpq_search",
    "hard_negatives_user",
    "random_negatives_user",
    "sampled_candidates_uniform",
    "sampled_candidates_popularity",
    "ranker_train_table",
    "ranker_features",
    "info_nce_loss",
    "bpr_loss",
    "batch_metrics",
    "eval_popularity",
    "eval_retrieval",
    "recommend",
    "latency_summary",
    "history_string",
    "sft_examples",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tasteloom.registry import QUERIES
    from tasteloom.session import drop_stored, local_session

    spark = local_session(cpus)
    names = sys.argv[1:] or HEADLINE

    def run(name: str, path: str) -> float:
        began = time.perf_counter()
        QUERIES[name](spark, path).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    run("item_counts", sf_dir)
    times = {}
    for name in names:
        times[name] = round(run(name, sf_dir), 3)
        drop_stored(spark)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
