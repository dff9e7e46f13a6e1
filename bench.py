"""Times the headline queries and prints one line of JSON. BENCH_SF_DIR and BENCH_CPUS choose tables and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from meshwork import catalog
from meshwork.plans.louvain import louvain
from meshwork.sources.projections import projection

SINGLE = ["vertex_weight", "csr_offsets", "modularity_singleton", "best_move_start_local_up", "best_move_start_global_up", "community_weight_delta", "coarse_edges", "degree_bins_move"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in SINGLE:
        began = time.time()
        catalog.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    runs = {}
    for name, sweeps in (("po", 3), ("ps", 2)):
        began = time.time()
        graph = projection(spark, sf_dir, name)
        result = louvain(graph, max_phases=1, max_iter=sweeps)
        seconds[f"louvain_{name}_phase0_{sweeps}_sweeps"] = round(time.time() - began, 3)
        runs[name] = {"q": result.q, "edges": result.levels[0][2], "sweeps": [round(t[4], 3) for t in result.trace], "edges_per_second": [round(result.levels[0][2] / t[4]) for t in result.trace]}
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": total, "unit": "sec", "queries": seconds, "runs": runs, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))
    spark.stop()


if __name__ == "__main__":
    main()
