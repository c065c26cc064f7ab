"""Wall time of the headline queries: one warm run, then one timed run into the noop sink."""

from __future__ import annotations

import json
import os
import time

from claimspark.session import local_session
from claimspark.plans.queries import QUERIES

HEADLINE = (
    "split_label_counts",
    "dataset_written",
    "harvested_claims",
    "article_sample",
    "listing_cards",
    "archive_end",
    "stride_sample",
    "harvest_upsert",
    "duplicate_counts",
    "length_description",
    "length_density",
    "term_frequency",
    "distinctive_terms",
    "tfidf_documents",
    "nearest_vectors",
    "smote_counts",
    "page_links",
    "page_visible_text",
    "classification_report",
    "bootstrap_interval",
)
#: Timed once besides the headline queries and not part of their total.
FURTHER = ("harvest_stream", "class_weights", "model_comparison", "per_step_difference", "evaluation_document", "markup_edge_cases")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, memory=os.environ.get("BENCH_MEMORY", "16g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    further = {}
    for name in FURTHER:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        further[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    line = {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "further": further}
    print(json.dumps({**line, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
