"""Stage attempts: submission, completion, owning job, RDDs and accumulators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.functions import strip
from eventlens.operators.asof import latest_before
from eventlens.operators.fold import last_of, last_per_id
from eventlens.operators.jobs import job_stages
from eventlens.sources.events import route


def scope_name(scope: Column) -> Column:
    """Text after the last colon of a scope, without quotes and braces."""
    tail = F.substring_index(F.coalesce(scope, F.lit("")), ":", -1)
    return strip(F.translate(tail, '"}', ""))


def _scope_names(rdd_info: Column) -> Column:
    names = F.transform(rdd_info, lambda r: scope_name(r["Scope"]))
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def submissions(events: DataFrame) -> DataFrame:
    """The last submission of each stage attempt."""
    rdd_info = F.coalesce(
        F.col("stage.rdd_info"),
        F.array().cast("array<struct<`RDD ID`:bigint,Name:string,Scope:string>>"),
    )
    return (
        route(events, S.STAGE_SUBMITTED)
        .groupBy("log_id", "stage.stage_id", "stage.stage_attempt_id")
        .agg(
            F.max_by(
                F.struct(
                    "seq",
                    "stage.stage_name",
                    "stage.num_tasks_planned",
                    "stage.submission_ms",
                    _scope_names(rdd_info).alias("scope_names"),
                    F.transform(rdd_info, lambda r: r["RDD ID"]).alias("rdd_ids"),
                    F.transform(rdd_info, lambda r: r["Name"]).alias("rdd_names"),
                ),
                "seq",
            ).alias("s")
        )
        .select("log_id", "stage_id", "stage_attempt_id", "s.*")
    )


def stage_job_asof(events: DataFrame) -> DataFrame:
    """Submitted stage attempts with the last job start before them that declares them.

    Submissions that no earlier job declares are dropped.  Taking the last
    submission first is safe: any job start before an earlier submission is
    before the last one too.
    """
    declared = job_stages(events).filter(F.col("job_id").isNotNull())
    return latest_before(
        submissions(events),
        declared.withColumnRenamed("job_seq", "seq"),
        on=["log_id", "stage_id"],
        value="job_id",
    ).filter(F.col("job_id").isNotNull())


def stages(events: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """One row per stage attempt.

    ``mapped`` may pass in an already computed :func:`stage_job_asof`.
    """
    mapped = stage_job_asof(events) if mapped is None else mapped
    completed = (
        route(events, S.STAGE_COMPLETED)
        .groupBy("log_id", "stage.stage_id", "stage.stage_attempt_id")
        .agg(last_of(F.lit(True), "stage.submission_ms", "stage.completion_ms").alias("c"))
    )

    def any_scope(text: str) -> Column:
        return F.exists("scope_names", lambda s: s.contains(text))

    # Both sides are unique per key.  Stage ids may be null in broken events; the
    # null-safe join keeps them.
    s, c = mapped.alias("s"), completed.alias("c0")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c0.{k}")) for k in S.STAGE_KEY]
    joined = s.join(c, same[0] & same[1] & same[2], "full").select(
        *[F.coalesce(f"s.{k}", f"c0.{k}").alias(k) for k in S.STAGE_KEY],
        *[f"s.{n}" for n in mapped.columns if n not in S.STAGE_KEY],
        "c",
    )
    return joined.select(
        *S.STAGE_KEY,
        "stage_name",
        "num_tasks_planned",
        F.coalesce("submission_ms", "c.submission_ms").alias("submission_ms"),
        "c.completion_ms",
        (F.col("c.completion_ms") - F.col("c.submission_ms")).alias("duration_ms"),
        "scope_names",
        "rdd_ids",
        F.when(
            F.col("rdd_names").isNotNull(),
            F.size(F.filter("rdd_names", lambda n: n == "FileScanRDD")),
        ).alias("num_files_scanned"),
        any_scope("Scan parquet").alias("has_scan_parquet"),
        any_scope("BroadcastExchange").alias("has_broadcasted_data"),
        any_scope("WholeStageCodegen").alias("has_whole_stage_codegen"),
        "job_id",
        F.col("seq").alias("submit_seq"),
    )


def stage_rdd_types(mapped: DataFrame) -> DataFrame:
    """Number of RDDs per stage attempt and RDD name, from :func:`stage_job_asof`."""
    return (
        mapped.select(*S.STAGE_KEY, F.explode("rdd_names").alias("rdd_name"))
        .groupBy(*S.STAGE_KEY, "rdd_name")
        .agg(F.count("*").alias("n"))
    )


def stage_accumulables(events: DataFrame) -> DataFrame:
    """Accumulator values of completed stage attempts; the last one per id wins."""
    return (
        route(events, S.STAGE_COMPLETED)
        .groupBy("log_id", "stage.stage_id", "stage.stage_attempt_id")
        .agg(last_of(F.lit(True), "stage.accumulables").alias("c"))
        .select(*S.STAGE_KEY, F.inline(last_per_id(F.col("c.accumulables"))))
    )
