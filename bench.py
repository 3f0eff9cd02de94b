"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalog.queries import QUERIES
from groundwell import build_session

HEADLINE = (
    "token_stats", "sentence_split", "number_extract", "heading_levels", "text_sections", "chunk_pack",
    "chunk_sections", "ingest_report", "typeset_folded", "furniture_lines", "corpus_idf", "bm25_topk", "cosine_topk",
    "blend_topk", "vector_mean_by_label", "rrf_fuse", "hybrid_topk", "query_rewrite", "intent_rules",
    "confidence_gate", "corrective_merge", "number_provenance", "answer_repair", "output_gate_verdicts",
    "answer_responses", "eval_metrics", "threshold_pick", "retrieval_hit", "history_prune", "history_page",
    "rate_limit", "failure_runs", "cascade_delete", "manifest_diff", "embeddings_missing",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="20g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the engine before the clock
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:24s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
