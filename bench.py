"""Time the headline queries. Prints one JSON line.

Settings: BENCH_SF_DIR (a folder of parquet tables), BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import sys
import time

from corpuspack.plans.queries import QUERIES
from corpuspack.session import local_session

HEADLINE = (
    "scan_files",
    "tree_listing_explode",
    "blob_join",
    "glob_include",
    "glob_braces",
    "prune_dirs",
    "ignore_decisions",
    "file_decisions",
    "language_tag",
    "strip_comments",
    "tokens_text",
    "dry_run",
    "excluded_walk",
    "anchor_dedup",
    "split_names",
    "chunk_assign",
    "chunk_assign_one_repo",
    "tree_lines",
    "document_fragments",
    "chunk_documents",
    "single_outputs",
    "split_outputs",
    "chunk_outputs",
    "remote_outputs",
    "run_summary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["glob_include"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
