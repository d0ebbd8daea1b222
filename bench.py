"""Headline benchmark: runs the main queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and prints one JSON line with seconds per query.

Each query is executed fully with the ``noop`` sink (all rows computed, none
collected).  The ontology closure/levels are a derived dimension built once per
data folder; that build is timed on its own ("dims_closure_levels").
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "g8_w1_propagated_top500",
    "g8_max_propagation",
    "g7_label_propagation",
    "g9_min_propagation",
    "g11_fill_propagation",
    "g15_conditional_any_parent",
    "g20_negative_propagation",
    "g21_ternary_labels",
    "a18_weighted_ensemble",
    "j18_partitioned_blend",
    "v1_weighted_fmax",
    "v4_protein_fmax",
    "n10_net_knn",
    "a25_first_k_hit_means",
    "l7_sparse_target_matrix",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from termflow.plans import QUERIES
    from termflow.plans.common import Dims
    from termflow.session import get_spark

    spark = get_spark()
    # warm the JVM (class loading, codegen) so it is not billed to the first query
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    t0 = time.time()
    dims = Dims.of(spark, sf_dir)
    _ = dims.closure
    times["dims_closure_levels"] = round(time.time() - t0, 3)
    for name in HEADLINE:
        if name not in QUERIES:
            continue
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
