"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and fully executed into Spark's ``noop`` sink (no
collect), timed end to end including any eager steps the query performs.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "raw_standardize", "rating_triples", "price_weighted_ratings", "split_train", "item_popularity",
    "seen_lists", "score_pairs", "recommend_unseen_top5", "minmax_masked_top5", "heldout_rank_hr_ndcg",
    "heldout_rank_unseen", "metrics_by_k", "coverage_share", "recommend_lookup", "test_negatives_unseen",
    "train_negatives", "log_loss", "stream_requests", "als_recommend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from recoflow.plans.catalogue import catalogue
    from recoflow.session import build_session, checkpoint_root
    spark = build_session(master=f"local[{cpus}]", app="recoflow-bench", shuffle_partitions=int(cpus) * 2)
    checkpoint_root(spark)
    cat = catalogue()
    # warm-up: JVM, Python workers, parquet footers
    cat["dataset_counts"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        cat[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
