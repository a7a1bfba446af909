"""Slowest stages, tasks and files, and skewed stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.facts import LogFacts
from eventlens.operators.median import value_figures
from eventlens.operators.topk import by_duration, top_k
from eventlens.plans.metrics import is_scan
from eventlens.reports.lookup import ended_tasks, stages_of_executions

PER_EXECUTION = ["log_id", "execution_id"]


def in_stages(df: DataFrame, stages: DataFrame | None) -> DataFrame:
    """Rows of the given stage attempts; None stands for all."""
    if stages is None:
        return df
    return df.join(stages.select(*S.STAGE_KEY), S.STAGE_KEY, "left_semi")


def stage_task_counts(facts: LogFacts, stages: DataFrame | None = None) -> DataFrame:
    """Ended tasks per stage attempt; of ``stages`` only, cut before anything is counted."""
    return in_stages(ended_tasks(facts), stages).groupBy(*S.STAGE_KEY).agg(F.count("*").alias("tasks"))


def slowest_stages(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None, top_n: int = 5
) -> DataFrame:
    """The slowest stage attempts of each execution."""
    facts = facts.of_log(log_id)
    slowest = top_k(
        stages_of_executions(facts, execution_id),
        PER_EXECUTION,
        [by_duration(), F.col("stage_order").asc()],
        top_n,
    )
    return slowest.join(stage_task_counts(facts, slowest), S.STAGE_KEY, "left").select(
        *PER_EXECUTION,
        "rank",
        "stage_id",
        "stage_attempt_id",
        "duration_ms",
        F.coalesce("tasks", F.lit(0)).alias("tasks"),
        "has_scan_parquet",
        "has_broadcasted_data",
    )


def _tasks_in_scope(facts: LogFacts, stages: DataFrame, execution_id: int | None) -> DataFrame:
    """Ended tasks; cut down early where only one execution is asked for."""
    return in_stages(ended_tasks(facts), None if execution_id is None else stages)


def slowest_tasks(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None, top_n: int = 10
) -> DataFrame:
    """The slowest tasks of each execution.

    Tasks are first cut to ``top_n`` per stage attempt, which can drop no task
    of the final list; only those meet the stages, so the large table is never
    joined.
    """
    facts = facts.of_log(log_id)
    stages = stages_of_executions(facts, execution_id).select("execution_id", *S.STAGE_KEY)
    ties = ["task_id", "task_attempt_id"]
    candidates = top_k(
        _tasks_in_scope(facts, stages, execution_id).select(
            *S.TASK_KEY, "duration_ms", "partition_id", "locality", "input_bytes", "disk_spill_bytes"
        ),
        S.STAGE_KEY,
        [by_duration(), *ties],
        top_n,
    ).drop("rank")
    return top_k(
        candidates.join(stages, S.STAGE_KEY),
        PER_EXECUTION,
        [by_duration(), "stage_id", "stage_attempt_id", *ties],
        top_n,
    ).select(
        *PER_EXECUTION,
        "rank",
        "task_id",
        "task_attempt_id",
        "stage_id",
        "stage_attempt_id",
        "duration_ms",
        "partition_id",
        "locality",
        "input_bytes",
        "disk_spill_bytes",
    )


def skew_suspects(
    facts: LogFacts,
    execution_id: int | None = None,
    log_id: str | None = None,
    ratio: float = 3.0,
    min_tasks: int = 4,
) -> DataFrame:
    """Stage attempts whose slowest task took over ``ratio`` times the upper median."""
    facts = facts.of_log(log_id)
    stages = stages_of_executions(facts, execution_id).select(
        "execution_id", "job_id", *S.STAGE_KEY
    )
    tasks = _tasks_in_scope(facts, stages, execution_id).select(
        *S.TASK_KEY, "duration_ms", "partition_id"
    )
    # Both ids in one number, whose least value a hash aggregate can hold.
    order = F.col("task_id").cast("decimal(19, 0)") * F.lit(1 << 32) + F.col("task_attempt_id")
    per_stage = value_figures(
        tasks, S.STAGE_KEY, "duration_ms", order, ["task_id", "task_attempt_id", "partition_id"]
    )
    return (
        per_stage.filter((F.col("n") >= min_tasks) & (F.col("known") >= min_tasks))
        .filter(F.col("median") >= 0)
        .filter(F.col("largest") > F.col("median") * F.lit(float(ratio)))
        .join(stages, S.STAGE_KEY)
        .select(
            *PER_EXECUTION,
            "job_id",
            "stage_id",
            "stage_attempt_id",
            F.col("n").alias("tasks"),
            F.col("median").alias("median_ms"),
            F.col("largest").alias("max_ms"),
            "task_id",
            "task_attempt_id",
            "partition_id",
        )
    )


def stage_files(facts: LogFacts, stages: DataFrame | None = None) -> DataFrame:
    """The one file a stage attempt is credited to: that of its deepest named scan."""
    return (
        in_stages(facts.stage_plan_metrics, stages).filter(
            is_scan(F.col("node_name"), facts.match) & (F.col("file_name") != "")
        )
        .groupBy(*S.STAGE_KEY)
        .agg(F.max_by("file_name", F.struct("path_key", -F.col("pos"))).alias("file_name"))
    )


def slowest_files(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None, top_n: int = 5
) -> DataFrame:
    """Sum of stage durations per scanned file; ties in order of first appearance."""
    facts = facts.of_log(log_id)
    stages = stages_of_executions(facts, execution_id)
    files = stage_files(facts, None if execution_id is None else stages)
    per_file = (
        stages.select(*S.STAGE_KEY, "execution_id", "duration_ms", "stage_order")
        .join(files, S.STAGE_KEY)
        .groupBy(*PER_EXECUTION, "file_name")
        .agg(
            F.sum(F.coalesce("duration_ms", F.lit(0))).alias("total_duration_ms"),
            F.min("stage_order").alias("first"),
        )
    )
    order = [F.col("total_duration_ms").desc(), F.col("first").asc()]
    return top_k(per_file, PER_EXECUTION, order, top_n).select(
        *PER_EXECUTION, "rank", "file_name", "total_duration_ms"
    )
