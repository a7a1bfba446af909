"""Rows of one execution, job or stage, in the order in which they are reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.facts import LogFacts
from eventlens.operators.topk import by_duration


def only(df: DataFrame, **wanted: int | None) -> DataFrame:
    """Rows with the given column values; None stands for any."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def write_executions(facts: LogFacts) -> DataFrame:
    """Executions whose description shows a write; unknown is not a write."""
    return facts.executions.filter("has_write_op").select("log_id", "execution_id")


def jobs_of_executions(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None
) -> DataFrame:
    """Jobs that belong to a SQL execution, unordered, with their sort key ``job_order``."""
    jobs = only(facts.of_log(log_id).jobs, execution_id=execution_id)
    jobs = jobs.filter(F.col("execution_id").isNotNull())
    return jobs.withColumn(
        "job_order",
        F.struct(
            F.coalesce("submission_ms", F.lit(0)).alias("submitted"), F.col("start_seq").alias("seq")
        ),
    )


def execution_jobs(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None
) -> DataFrame:
    """Jobs of an execution by submission time, those without a time first."""
    return (
        jobs_of_executions(facts, execution_id, log_id)
        .orderBy("log_id", "execution_id", "job_order")
        .drop("job_order")
    )


def job_stage_list(
    facts: LogFacts, job_id: int | None = None, log_id: str | None = None
) -> DataFrame:
    """Stage attempts of a job, by attempt and submission."""
    stages = only(facts.of_log(log_id).stages, job_id=job_id).filter(F.col("job_id").isNotNull())
    return stages.orderBy("log_id", "job_id", "stage_attempt_id", "submit_seq")


def stages_of_executions(
    facts: LogFacts, execution_id: int | None = None, log_id: str | None = None
) -> DataFrame:
    """Stage attempts that reach the reports, with their execution and ``stage_order``."""
    jobs = jobs_of_executions(facts, execution_id, log_id).select(
        "log_id", "job_id", "execution_id", "job_order"
    )
    return facts.of_log(log_id).stages.join(jobs, ["log_id", "job_id"]).withColumn(
        "stage_order", F.struct("job_order", "submit_seq")
    )


def ended_tasks(facts: LogFacts) -> DataFrame:
    return facts.tasks.filter("ended")


def stage_tasks(
    facts: LogFacts,
    stage_id: int | None = None,
    stage_attempt_id: int | None = None,
    log_id: str | None = None,
) -> DataFrame:
    """Ended tasks of stage attempts."""
    tasks = ended_tasks(facts.of_log(log_id))
    return only(tasks, stage_id=stage_id, stage_attempt_id=stage_attempt_id)


def task_breakdown(
    facts: LogFacts,
    stage_id: int | None = None,
    stage_attempt_id: int | None = None,
    log_id: str | None = None,
) -> DataFrame:
    """Tasks of stage attempts, slowest first."""
    return (
        stage_tasks(facts, stage_id, stage_attempt_id, log_id)
        .select(
            *S.TASK_KEY,
            "partition_id",
            "duration_ms",
            "locality",
            "input_records",
            "input_bytes",
            "shuffle_read_bytes",
            "disk_spill_bytes",
        )
        .orderBy(*S.STAGE_KEY, by_duration(), "task_id", "task_attempt_id")
    )
