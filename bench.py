"""Time the headline queries on local cores and print one JSON line."""

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spoolsift.plans.catalog import QUERIES  # noqa: E402

HEADLINES = (
    "search_table",
    "search_hits",
    "search_budget",
    "search_context_all",
    "pair_tool_calls",
    "normalize_claude",
    "normalize_codex",
    "session_summary_claude",
    "session_summary_codex",
    "handles",
    "tool_counts",
    "errors_by_tool",
    "session_stats",
    "prompts",
    "show_tail",
    "secret_rules",
    "secret_audit",
    "redact_lines",
    "redact_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINES
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", shared)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    shutil.rmtree(shared, ignore_errors=True)
    total = round(sum(times.values()), 3)
    print(
        json.dumps(
            {"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name}
        )
    )


if __name__ == "__main__":
    main()
