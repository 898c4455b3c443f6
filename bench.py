"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with a ``noop`` write (no collect), after one
warm-up query that is not counted. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "knn_predict_ratings",      # LSH script: neighbours + prediction
    "lsh_neighbors",            # LSH script: the reference's own join
    "ridge_predictions",        # linear regression script: fit + predict
    "forest_predictions",       # random forest script: fit + predict
    "als_predictions",          # latent factors: fit + predict
    "baseline_cv",              # 5-fold CV of the bias model
    "nb_predictions",           # text classification
    "word_degrees",             # key-word degrees over whole texts
    "tfidf_top_terms",
    "recommend_similar_parts",  # content-based recommendation
    "top_cosine_vectors",
    "svd_top_cosine",           # item similarity notebook: truncated SVD on the implicit matrix
    "item_cf_predictions",      # ratings from similar items
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tessera.session import build_session
    from tessera.plans.catalog import QUERIES

    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    QUERIES["ratings_from_orders"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        # each headline query is a standalone job: drop what it persisted
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
