"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "factor_scores", "scored_people", "customer_quintiles", "fixed_width", "name_pick", "assign_goals", "html_items",
    "layer_edges_opn", "layer_edges_neu", "multilayer_edges", "adjacency_coo", "node_strength", "class_degrees",
    "pagerank10", "class_pagerank", "pagerank_trade", "personalized_pagerank", "components", "class_components",
    "components_trade", "sales_tensor", "mttkrp_mode1", "tensor_contract", "cp_als", "layer_communities", "incremental_cp",
    "profile_match", "member_profiles",
]


def main() -> None:
    from layerweave.plans.queries import QUERIES
    from layerweave.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["first_people"](spark, folder).write.format("noop").mode("overwrite").save()  # starts the JVM's engine
    times = {}
    for name in chosen:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
