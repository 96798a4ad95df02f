"""Seconds of the headline queries, warm, median of three, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = (
    "grade3_rubrics_for_remedy", "eligible_rubrics", "rubric_summary", "stratified_sample", "goldset_forward", "bm25_search_labels", "bm25_search_documents",
    "latency_report", "wilson_rates", "cost_model", "chunk_counts", "packed_chunks", "vector_topk_batch", "confidence_gate", "near_duplicates", "dedup_suppression",
    "alias_cascade", "quote_exact", "quote_fuzzy", "mcq_rubric_to_remedy", "mcq_keynote", "html_tag_histogram", "normalize_text", "session_scores", "load_and_resolve", "registry_build",
)


def main() -> None:
    from quillgraph.plans.catalog import QUERIES
    from quillgraph.session import session

    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(f"local[{cpus}]", "bench", **{"spark.driver.memory": "6g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINES:
        runs = []
        for i in range(4):  # the first warms up
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
            if i == 1 and runs[1] > 20:
                break
        times[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
