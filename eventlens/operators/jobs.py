"""Jobs and the stages they declare."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.operators.fold import last_of
from eventlens.sources.events import route


def jobs(events: DataFrame) -> DataFrame:
    """One row per job, from its start and end events."""
    event = F.col("event")
    folded = (
        route(events, S.JOB_START, S.JOB_END)
        .groupBy("log_id", "job.job_id")
        .agg(
            last_of(
                event == S.JOB_START,
                "job.execution_id",
                "job.root_execution_id",
                "job.stage_ids",
                "job.submission_ms",
                "job.description",
                F.col("seq").alias("start_seq"),
            ).alias("s"),
            last_of(event == S.JOB_END, "job.completion_ms", "job.result").alias("e"),
        )
    )
    return folded.select(
        "log_id",
        "job_id",
        "s.execution_id",
        "s.root_execution_id",
        "s.stage_ids",
        "s.submission_ms",
        "s.description",
        "e.completion_ms",
        "e.result",
        (F.col("e.completion_ms") - F.col("s.submission_ms")).alias("duration_ms"),
        "s.start_seq",
    )


def job_stages(events: DataFrame) -> DataFrame:
    """One row per stage that a job start declares; unreadable ids are dropped."""
    return (
        route(events, S.JOB_START)
        .select(
            "log_id",
            "job.job_id",
            F.explode("job.stage_ids").alias("stage_id"),
            F.col("seq").alias("job_seq"),
        )
        .filter(F.col("stage_id").isNotNull())
    )
