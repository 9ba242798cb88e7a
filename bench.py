"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from neighborflow.queries import QUERIES
from neighborflow.scratch import clear
from neighborflow.session import local_session

NAMES = ("onehop_uniform", "onehop_weighted", "hetero_twohop", "disjoint_onehop", "replace_onehop", "gather_vec", "scatter_upsert", "cooccurrence", "csr_row_ptr", "edge_ids", "negative_temporal", "link_batches", "dedup_grads", "adam_step", "mean_aggregate", "auc", "lfu_admission")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        runs = []
        for _ in range(2):  # the first run compiles
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(min(runs), 3)
        clear(spark)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
