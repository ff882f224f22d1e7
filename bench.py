"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once, planning included, into the no-op sink so that all rows and columns are
computed. Derived input tables are built before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from catalog import queries as Q

HEADLINE = [
    "l6_segment_sections", "l11_section_confidence", "c6_dedup_sentences", "c8_compress_sections",
    "p3_assemble_prompt", "k2_extract_dois", "k8_recency", "v2_verify_dois", "v4_verify_titles",
    "s9_incremental", "r4_weighted_score", "q8_run_summary", "e1_analyze_corpus",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    for build in (Q.works, Q.preprints, Q.lookup_log, Q.links, Q.reviews, Q.results):
        build(spark, sf_dir)
    docs = Q.papers(spark, sf_dir).count()

    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        Q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "documents": docs,
        "documents_per_sec": {k: round(docs / v, 1) for k, v in times.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
