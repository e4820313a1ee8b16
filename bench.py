"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and the cores."""

from __future__ import annotations

import json
import os
import time

from laminet.plans import catalog, queries  # noqa: F401
from laminet.session import local_session

HEADLINE = ["edges_aggregate_degree", "edges_aggregate_raw", "net_summary", "layer_stats", "coupling_existing", "supra_adjacency_multilayer", "layer_cooccurrence", "encode_multiedgelist", "subnetwork_names", "hin_weights_ig", "triangles", "modularity_by_nation", "codelength_by_nation", "powerlaw_alpha_by_xmin", "enrichment_counts", "rule_pairs_topk", "temporal_slices", "pagerank_k10"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory="16g")
    run = lambda name: catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # starts the JVM's code
    took = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
