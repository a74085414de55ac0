"""Time the headline queries; prints one JSON line."""

import json
import os
import tempfile
import time

from tallyspark.operators import retrieval
from tallyspark.plans import registry
from tallyspark.session import local_session

HEADLINE = ("h05_bm25", "h08_top_k", "h04_postings", "b03_strip_boilerplate", "b10_score_pages", "b12_candidate_pages", "d10_sum_finer_rows", "d16_buckets_by_year", "d20_tie_to_anchor", "e01_eval_identity", "f04_merge_majority", "g12_sector_stats", "g08_compare_periods", "i16_three_way_merge", "j05_accuracy_by_section", "j12_diff_snapshots", "c11_verify_quote", "e05_score_confidence_full", "f04_merge_majority_full", "g07_review_queue", "j04_accuracy")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries, took = registry.queries(), {}
    registry.flagship(spark, sf).count()  # start-up is not timed
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    index = tempfile.mkdtemp(prefix="tallyspark-index-")
    began = time.time()
    retrieval.write_index(registry.chunks_of(spark, sf), index)
    took["h04_index_build"] = round(time.time() - began, 3)
    began = time.time()
    retrieval.top_k(retrieval.stored_bm25(registry.questions(spark), index)).collect()
    took["h08_warm_search"] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
