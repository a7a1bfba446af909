"""Job and stage summaries, and the trace of whole executions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.facts import LogFacts
from eventlens.operators.topk import by_duration
from eventlens.reports.lookup import ended_tasks, jobs_of_executions, only
from eventlens.reports.rankings import (
    in_stages,
    skew_suspects,
    slowest_files,
    slowest_stages,
    slowest_tasks,
    stage_task_counts,
)
from eventlens.reports.selectivity import scan_selectivity

JOB_KEY = ["log_id", "job_id"]


def skipped_stages(
    facts: LogFacts, jobs: DataFrame | None = None, stages: DataFrame | None = None
) -> DataFrame:
    """Per job, the number of declared stages that were not submitted under it."""
    jobs = facts.jobs if jobs is None else jobs
    stages = facts.stages if stages is None else stages
    declared = (
        jobs.select(*JOB_KEY, F.explode("stage_ids").alias("stage_id"))
        .filter(F.col("stage_id").isNotNull())
        .distinct()
    )
    submitted = stages.filter(F.col("job_id").isNotNull()).select(*JOB_KEY, "stage_id")
    return (
        declared.join(submitted, [*JOB_KEY, "stage_id"], "left_anti")
        .groupBy(*JOB_KEY)
        .agg(F.count("*").alias("skipped_stages"))
    )


def _job_rows(facts: LogFacts, jobs: DataFrame, stages: DataFrame, *keys: str) -> DataFrame:
    """Figures of ``jobs``, whose stage attempts are ``stages``, with further columns."""
    attempts = (
        stages.filter(F.col("job_id").isNotNull())
        .groupBy(*JOB_KEY)
        .agg(F.count("*").alias("stages"))
    )
    return (
        jobs.join(attempts, JOB_KEY, "left")
        .join(skipped_stages(facts, jobs, stages), JOB_KEY, "left")
        .select(
            "log_id",
            "execution_id",
            "job_id",
            F.coalesce("stages", F.lit(0)).alias("stages"),
            "duration_ms",
            "result",
            F.coalesce("skipped_stages", F.lit(0)).alias("skipped_stages"),
            *keys,
        )
    )


def job_summary(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None
) -> DataFrame:
    """One row per job: stage attempts, duration, result, skipped stages."""
    facts = facts.of_log(log_id)
    jobs = only(facts.jobs, execution_id=execution_id)
    stages = facts.stages
    if execution_id is not None:
        stages = stages.join(jobs.select(*JOB_KEY), JOB_KEY, "left_semi")
    return _job_rows(facts, jobs, stages)


def _stage_rows(
    facts: LogFacts, stages: DataFrame, use_post_scan: bool, scope: DataFrame | None, *keys: str
) -> DataFrame:
    """Figures of ``stages``; ``scope`` cuts tasks and plan metrics before they are summed."""
    return (
        stages.join(stage_task_counts(facts, scope), S.STAGE_KEY, "left")
        .join(scan_selectivity(facts, use_post_scan, scope), S.STAGE_KEY, "left")
        .select(
            "log_id",
            "job_id",
            "stage_id",
            "stage_attempt_id",
            F.coalesce("tasks", F.lit(0)).alias("tasks"),
            "duration_ms",
            "has_scan_parquet",
            "has_broadcasted_data",
            "scan_rows",
            "scan_time_ms",
            "file_name",
            "filter_rows",
            "filtered_out_rows",
            "filtered_pct_ref",
            "retained_pct",
            "filtered_out_pct",
            *keys,
        )
    )


def stage_summary(facts: LogFacts, use_post_scan: bool = False) -> DataFrame:
    """One row per stage attempt of a job: tasks, duration, flags, scan figures."""
    stages = facts.stages.filter(F.col("job_id").isNotNull())
    return _stage_rows(facts, stages, use_post_scan, None)


def execution_overview(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None
) -> dict[str, DataFrame]:
    """The first block of the report."""
    return {
        "slowest_stages": slowest_stages(facts, execution_id, log_id),
        "slowest_tasks": slowest_tasks(facts, execution_id, log_id),
        "skew_suspects": skew_suspects(facts, execution_id, log_id),
    }


def execution_trace(
    facts: LogFacts,
    execution_id: int | None = None,
    log_id: str | None = None,
    task_breakdown: bool = False,
    use_post_scan: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Jobs, their stage attempts and scan figures, on request also their tasks.

    Jobs without stages and stages without tasks keep a row.  Sorted by
    execution, job, attempt, submission and, with tasks, duration; ``ordered=False``
    spares the sort of a trace of many logs.
    """
    facts = facts.of_log(log_id)
    jobs = jobs_of_executions(facts, execution_id)
    stages = facts.stages.filter(F.col("job_id").isNotNull())
    scope = None
    if execution_id is not None:
        scope = stages = stages.join(jobs.select(*JOB_KEY), JOB_KEY, "left_semi")
    job_rows = _job_rows(facts, jobs, stages, "job_order")
    stage_rows = _stage_rows(facts, stages, use_post_scan, scope, "submit_seq")
    trace = job_rows.withColumnRenamed("duration_ms", "job_duration_ms").join(
        stage_rows.withColumnRenamed("duration_ms", "stage_duration_ms"), JOB_KEY, "left"
    )
    sort = ["log_id", "execution_id", "job_order", "stage_attempt_id", "submit_seq"]
    if task_breakdown:
        tasks = in_stages(ended_tasks(facts), scope).select(
            *S.TASK_KEY,
            "partition_id",
            "duration_ms",
            "locality",
            "input_records",
            "input_bytes",
            "shuffle_read_bytes",
            "disk_spill_bytes",
        )
        # Inner join plus the rows without tasks instead of a left join: Spark
        # can split a hot stage only on the side that an outer join preserves.
        without = trace.filter(F.coalesce("tasks", F.lit(0)) == 0)
        trace = tasks.join(trace, S.STAGE_KEY).unionByName(without, allowMissingColumns=True)
        sort += [by_duration(), "task_id", "task_attempt_id"]
    trace = trace.orderBy(*sort) if ordered else trace
    return trace.drop("job_order", "submit_seq")


def trace_execution(
    facts: LogFacts,
    execution_id: int | None = None,
    log_id: str | None = None,
    task_breakdown: bool = False,
) -> dict[str, DataFrame]:
    """The full report of one execution, or of all of them."""
    return {
        **execution_overview(facts, execution_id, log_id),
        "slowest_files": slowest_files(facts, execution_id, log_id),
        "trace": execution_trace(facts, execution_id, log_id, task_breakdown),
    }
