"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload.corpus import source_files  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "consensus_findings", "regex_findings_security", "regex_findings_privacy", "regex_findings_permission",
    "ast_findings_security", "all_findings", "prose_findings", "consensus_tolerance", "reasoning_enriched",
    "reasoning_merged", "findings_rollup", "repo_summary", "log_replay", "resume_pending_files", "stream_findings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the engine and its Python workers.
    QUERIES["consensus_findings"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    files = source_files(spark, sf_dir).count()
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1],
        "files": files,
        "files_per_second": round(files / times["consensus_findings"], 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
