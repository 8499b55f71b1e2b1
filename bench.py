"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracklens.plans import load_all
from tracklens.session import build_session

HEADLINE = [
    "flagship", "win_activity", "win_resp_decay", "win_targets3", "win_knn_prior", "jn_multi_overlap", "agg_matrix_audit", "agg_canonical_dup",
    "spl_cold_item", "evl_multi_seed", "top_precision_ndcg", "rec_candidates", "seq_density17", "seq_perm_space", "seq_grid", "cor_stats26", "mdl_mf_als",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench")
    queries = load_all()[0]
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    took = {}
    for n in names:
        t = time.perf_counter()
        queries[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
        print(n, took[n], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
