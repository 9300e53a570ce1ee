"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from evalweave.operators.decontam import find_contaminated  # noqa: E402
from evalweave.plans.catalog import QUERIES  # noqa: E402
from evalweave.session import local_session  # noqa: E402

HEADLINE = [
    "find_contaminated",
    "decontaminate",
    "overlap_report",
    "ngram_doc_frequency",
    "train_ngram_counts",
    "train_overlap",
    "janitor_clean",
    "curate_sft",
    "fewshot_context",
    "length_bucket_batches",
    "score_multiple_choice",
    "token_f1",
    "agg_bleu",
    "agg_chrf",
    "instruction_checks",
    "group_rollup",
    "squad_v2_scores",
    "pass_at_k",
    "rating_tag_heatmap",
    "response_cache_join",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, int(cpus) if cpus.isdigit() else 8)
    # One small job first (the benchmark table against itself), so that the first query does not pay for the
    # start of the engine.
    small = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    find_contaminated(small, small, "item_id", F.col("text"), F.col("text"), 13).count()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
