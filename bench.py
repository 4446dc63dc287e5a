"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to the end into a sink that discards rows. The feature table
and the model matrix that several queries share are timed on their own, as
`features_staged` and `matrix_staged`.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from finchlab.session import local_session  # noqa: E402
from registry import catalog  # noqa: E402

HEADLINE = [
    "hashtag_counts",
    "daily_counts",
    "trim_posts",
    "dedup_first",
    "exact_sample",
    "three_way_split",
    "fold_assignment",
    "combined_corpus",
    "seed_collection_capped",
    "clean_text",
    "tokens_nostop",
    "lemma_lookup",
    "lemma_join",
    "feature_table",
    "features_staged",
    "top_terms_per_class",
    "vocab_top300",
    "tfidf_words",
    "tfidf_hashtags",
    "scaled_numerics",
    "feature_long",
    "accuracy_recall_f1",
    "knn_vote",
    "knn_k_sweep",
    "seed_collection_large",
    "csv_round_trip",
    "matrix_staged",
    "dtree",
    "rforest",
    "logreg",
    "score_posts",
    "stream_ingest",
    "knn_classifier",
    "knn_approximate",
    "held_out_long",
    "first_copies_streamed",
    "best_cut_per_feature",
    "adaboost_votes",
    "rforest_untuned",
    "gbt",
    "grid_search",
]


def run(spark, name: str, sf: str) -> None:
    if name == "features_staged":
        catalog.staged_features(spark, sf)
    elif name == "matrix_staged":
        catalog._split_features(spark, sf)
    else:
        frame = catalog.QUERIES[name](spark, sf)
        frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, "daily_counts", sf)  # start the JVM's work before timing
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(spark, name, sf)
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(Path(sf).name.removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
