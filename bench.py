"""Headline queries on one machine; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vecstrata.plans.queries import QUERIES  # noqa: E402
from vecstrata.session import local_session  # noqa: E402

NAMES = ["knn_exact_batch", "knn_exact_quant", "quantize_codes", "quant_error_stats", "select_heuristic_refill", "edges_pruned", "index_stats", "ann_build", "ann_top10", "ann_after_insert"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    named = {n: QUERIES[n] for n in NAMES}
    try:
        import corpus_pipeline
        from vecstrata.llm import registry

        named |= registry.QUERIES | {"pipeline": corpus_pipeline.run}
    except ModuleNotFoundError:
        pass
    # the start of the session and of its Python workers is not a query
    spark.range(1000).repartition(spark.sparkContext.defaultParallelism).mapInArrow(lambda it: it, "id long").selectExpr("sum(id)").collect()
    # nor is the first compilation of a plan: the first query of the list runs once before it is timed
    named[NAMES[0]](spark, sf).write.format("noop").mode("overwrite").save()
    taken = {}
    for name, query in named.items():
        began = time.perf_counter()
        query(spark, sf).write.format("noop").mode("overwrite").save()
        taken[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(taken.values()), 3), "unit": "sec", "queries": taken, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
