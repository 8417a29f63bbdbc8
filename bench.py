"""Time the headline queries and print one JSON line.

Every query runs to completion into a sink that discards its rows. ``index_build`` writes the index; the searches that
follow read the stored one, as they would in use.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

HEADLINE = [
    "index_build",
    "search",
    "knn_join",
    "hybrid_retrieve",
    "chunk_documents",
    "anchored_dedup",
    "embed_chunks",
    "term_stats",
    "snippets",
    "duplicate_triage",
    "hocr_words",
    "jobs_with_documents",
    "stable_files",
    "normalize_names",
    "document_rollup",
    "naming_inputs",
    "folder_counts",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from foliary.operators.search import build_index, store_index
    from foliary.plans.catalog import QUERIES
    from foliary.plans.tables import Tables

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("foliary-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query

    def run(name: str) -> None:
        if name == "index_build":
            store_index(build_index(Tables(spark, folder).pages.repartition(int(cpus))))
        else:
            QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()

    Tables(spark, folder).page_index, Tables(spark, folder).chunk_index
    seconds = {}
    for name in names:
        started = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
