"""Headline queries, timed: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]. Prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ranklab.catalog import QUERIES, load_all  # noqa: E402
from ranklab.session import build_session  # noqa: E402

HEADLINE = ("tokenize_corpus", "bm25_refined", "bm25_baseline", "dense_rank", "tag_bm25", "tag_weighted_cosine", "hubness_center",
            "equivalence_classes", "rrf_fuse_n", "evaluate_all", "judging_pool", "merge_labels_first_wins", "normalize_by_query",
            "candidate_features", "cohen_kappa", "auc", "bootstrap_ci", "budget_fit", "text_retrieval_quality", "provider_bench",
            "tagger_bench")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    load_all()
    spark = build_session("bench", f"local[{cpus}]", 2 * int(cpus), **{"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
