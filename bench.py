"""Wall times of the pipeline and its reports; prints one JSON line.

Environment: BENCH_SF_DIR (input tables), BENCH_CPUS (local threads), BENCH_COPIES
(logs per synthetic log, to see growth), BENCH_ROUNDS (report times are the best of
these).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from eventlens import LogFacts, reports, shared_folder  # noqa: E402
from workload.synth import copies_of, synth_lines  # noqa: E402

REPORTS = {
    "slowest_stages": reports.slowest_stages,
    "slowest_tasks": reports.slowest_tasks,
    "skew_suspects": reports.skew_suspects,
    "slowest_files": reports.slowest_files,
    "stage_task_counts": reports.stage_task_counts,
    "scan_selectivity": reports.scan_selectivity,
    "task_breakdown": reports.task_breakdown,
    "stage_summary": reports.stage_summary,
    "job_summary": reports.job_summary,
    "trace": reports.execution_trace,
    "trace_with_tasks": lambda facts: reports.execution_trace(facts, task_breakdown=True),
    "trace_one_execution": lambda facts: reports.execution_trace(facts, 0, facts.first_log),
}


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    rounds = int(os.environ.get("BENCH_ROUNDS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventlens-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    # The log files are input, not part of the measured work.
    lines = synth_lines(spark, sf_dir)
    if copies > 1:
        lines = copies_of(lines, copies)
    path = shared_folder(spark, "bench-logs")
    (
        lines.repartitionByRange("log_id", "seq")
        .sortWithinPartitions("log_id", "seq")
        .select("log_id", "value")
        .write.partitionBy("log_id")
        .text(path)
    )
    n_lines, n_bytes = spark.read.text(path).selectExpr("count(*)", "sum(length(value))").first()

    facts = LogFacts(spark, path, store=shared_folder(spark, "bench-facts"))
    times = {"decode_events": timed(lambda: facts.events)}
    facts.first_log = facts.events.agg(F.min("log_id")).first()[0]
    for name in ("tasks", "stage_submissions", "stages", "plan_tree", "stage_plan_metrics"):
        times[name] = timed(lambda: getattr(facts, name))
    times["other_facts"] = timed(facts.build)
    for name, report in REPORTS.items():
        times[name] = min(timed(lambda: run(report(facts))) for _ in range(rounds))

    print(
        json.dumps(
            {
                "metric": "log lines to facts and all reports, wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "lines": n_lines,
                "log_mb": round(n_bytes / 1e6, 1),
                "copies": copies,
            }
        )
    )


if __name__ == "__main__":
    main()
