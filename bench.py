"""Headline timings: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time

from glossmark.plans import catalogue
from glossmark.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "bio_label_counts", "span_resolve", "config_spans", "token_counts", "bio_repair", "span_schema_scores",
    "loose_overlap", "score_averages", "tag_scores", "hallucinations", "tuple_recovery_summary",
    "hallucination_rate", "diversity", "frequency_conformance", "five_number_lengths", "entity_split",
    "row_split", "reaction_table", "round_robin_pick", "json_array", "validated_entities", "consolidate",
    "mask_words", "document_losses", "html_text", "word_category",
)


def main() -> None:
    names = sys.argv[1:] or HEADLINE
    spark = local_session(CPUS, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    spark.range(1000).selectExpr("sum(id)").collect()
    timings = {}
    for name in names:
        started = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline query time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
