"""Lines to typed events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.functions import int_or_zero, to_int
from eventlens.sources.lines import skip_blank

_EVENT_FIRST = '{"Event":"'
_NAME_ONLY = "`Event` STRING"
#: What ``event`` is in :func:`decode_lines` for lines of other kinds, and for bad ones.
OTHER, BAD = "_other", "_bad"


def _may_be(value: Column, kinds: Sequence[str]) -> Column:
    """False only for lines that name another event kind right at the start.

    Spark writes the ``Event`` key first, so the name can be read without
    decoding the line.  Lines that start in any other way are decoded in full.
    """
    name = F.substring_index(F.substring(value, len(_EVENT_FIRST) + 1, 200), '"', 1)
    return ~value.startswith(_EVENT_FIRST) | name.isin(*kinds)


def _decode(lines: DataFrame, fields: str = S.LINE_SCHEMA) -> DataFrame:
    decoded = F.from_json(
        "value",
        f"{fields}, `{S.CORRUPT}` STRING",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.CORRUPT},
    )
    # Decoding through a one-element explode: filters on decoded fields stay
    # above it.  On a plain column they would be pushed below the projection and
    # decode the line again for every condition.
    # The corrupt column is also set where one field has an unexpected type and
    # the rest of the line is fine; only lines without an event name are bad.
    return (
        skip_blank(lines)
        .select("log_id", "seq", "value", F.explode(F.array(decoded)).alias("j"))
        .withColumn("is_bad", F.col("j.Event").isNull() & F.col(f"j.{S.CORRUPT}").isNotNull())
    )


def bad_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not JSON objects."""
    return _decode(lines, _NAME_ONLY).filter("is_bad").select("log_id", "seq", "value")


def parse_events(
    lines: DataFrame, kinds: Sequence[str] | None = S.KINDS, strict: bool = False
) -> DataFrame:
    """Typed events of the wanted kinds; ``kinds=None`` keeps every event.

    Bad lines are left out (see :func:`bad_lines`); with ``strict`` they raise.
    One narrow transformation of the lines: no shuffle.
    """
    if kinds is not None and not strict:
        lines = lines.filter(_may_be(F.col("value"), kinds))
    decoded = _decode(lines)
    if strict:
        fail = F.raise_error(
            F.concat(F.lit("malformed event line in log "), F.coalesce("log_id", F.lit("?")))
        )
        decoded = decoded.filter(F.when(F.col("is_bad"), fail.cast("boolean")).otherwise(F.lit(True)))
    else:
        decoded = decoded.filter(~F.col("is_bad"))

    event = F.col("j.Event")
    if kinds is not None:
        decoded = decoded.filter(event.isin(*kinds))
    return decoded.select("log_id", "seq", event.alias("event"), *_typed())


def decode_lines(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Every line that is not blank, decoded once: events, other lines and bad lines.

    Events of the ten kinds have their typed columns, as from :func:`parse_events`.
    Other lines have ``event`` :data:`OTHER`, and ``name`` is their event's name;
    bad lines have ``event`` :data:`BAD`, and ``value`` is the line.  Written by ``event``,
    each of them is a partition of its own.  With ``strict`` a bad line raises.
    """
    decoded = _decode(lines)
    name = F.col("j.Event")
    known = F.coalesce(name.isin(*S.KINDS), F.lit(False))
    bad = F.lit(BAD)
    if strict:
        bad = F.raise_error(
            F.concat(F.lit("malformed event line in log "), F.coalesce("log_id", F.lit("?")))
        ).cast("string")
    return decoded.select(
        "log_id",
        "seq",
        F.when(F.col("is_bad"), bad).when(known, name).otherwise(F.lit(OTHER)).alias("event"),
        F.when(~known, name).alias("name"),
        F.when(F.col("is_bad"), F.col("value")).alias("value"),
        *_typed(),
    )


def events_of(decoded: DataFrame) -> DataFrame:
    """The typed events in what :func:`decode_lines` made."""
    return decoded.filter(~F.col("event").isin(OTHER, BAD)).drop("name", "value")


def counts_of(decoded: DataFrame) -> DataFrame:
    """:func:`event_counts` of what :func:`decode_lines` made."""
    name = F.when(F.col("event") == OTHER, F.col("name")).otherwise(F.col("event"))
    return (
        decoded.filter(F.col("event") != BAD)
        .groupBy("log_id", name.alias("event")).agg(F.count("*").alias("n"))
    )


def bad_of(decoded: DataFrame) -> DataFrame:
    """:func:`bad_lines` of what :func:`decode_lines` made."""
    return decoded.filter(F.col("event") == BAD).select("log_id", "seq", "value")


def _typed() -> list[Column]:
    event = F.col("j.Event")
    return [
        F.col("j.executionId").alias("execution_id"),
        F.col("j.rootExecutionId").alias("root_execution_id"),
        F.col("j.description").alias("description"),
        F.col("j.time").alias("time_ms"),
        # Of the many plan updates of an execution only the final ones count;
        # dropping the others here keeps their text out of every later step.
        F.when(
            (event == S.SQL_START)
            | (F.get_json_object("j.sparkPlanInfo", "$.simpleString") == S.FINAL_PLAN),
            F.col("j.sparkPlanInfo"),
        ).alias("plan_json"),
        F.col("j.accumUpdates").alias("accum_updates"),
        F.when(event.isin(S.JOB_START, S.JOB_END), _job()).alias("job"),
        F.when(event.isin(S.STAGE_SUBMITTED, S.STAGE_COMPLETED), _stage()).alias("stage"),
        F.when(event.isin(S.TASK_START, S.TASK_END), _task()).alias("task"),
    ]


def _job() -> Column:
    def prop(name: str) -> Column:
        return F.col("j.Properties").getField(name)

    return F.struct(
        to_int(F.col("j.`Job ID`")).alias("job_id"),
        to_int(prop("spark.sql.execution.id")).alias("execution_id"),
        to_int(prop("spark.sql.execution.root.id")).alias("root_execution_id"),
        F.left(F.coalesce(prop("spark.job.description"), F.lit("")), F.lit(200)).alias("description"),
        F.transform(
            F.coalesce(F.col("j.`Stage IDs`"), F.array().cast("array<string>")), to_int
        ).alias("stage_ids"),
        F.col("j.`Submission Time`").alias("submission_ms"),
        F.col("j.`Completion Time`").alias("completion_ms"),
        F.col("j.`Job Result`.Result").alias("result"),
    )


def _stage() -> Column:
    def info(name: str) -> Column:
        return F.col(f"j.`Stage Info`.`{name}`")

    return F.struct(
        to_int(info("Stage ID")).alias("stage_id"),
        to_int(info("Stage Attempt ID")).alias("stage_attempt_id"),
        info("Stage Name").alias("stage_name"),
        info("Number of Tasks").alias("num_tasks_planned"),
        info("Submission Time").alias("submission_ms"),
        info("Completion Time").alias("completion_ms"),
        F.when(F.col("j.Event") == S.STAGE_SUBMITTED, info("RDD Info")).alias("rdd_info"),
        F.transform(
            F.filter(info("Accumulables"), lambda a: to_int(a["ID"]).isNotNull()),
            lambda a: F.struct(to_int(a["ID"]).alias("acc_id"), a["Value"].alias("value")),
        ).alias("accumulables"),
    )


def _task() -> Column:
    def info(name: str) -> Column:
        return F.col(f"j.`Task Info`.`{name}`")

    def metric(path: str) -> Column:
        parts = ".".join(f"`{p}`" for p in path.split("/"))
        return int_or_zero(F.col(f"j.`Task Metrics`.{parts}"))

    return F.struct(
        to_int(F.col("j.`Stage ID`")).alias("stage_id"),
        to_int(F.col("j.`Stage Attempt ID`")).alias("stage_attempt_id"),
        to_int(info("Task ID")).alias("task_id"),
        to_int(info("Attempt")).alias("task_attempt_id"),
        to_int(info("Partition ID")).alias("partition_id"),
        info("Executor ID").alias("executor_id"),
        info("Host").alias("host"),
        info("Locality").alias("locality"),
        F.coalesce(info("Speculative"), F.lit(False)).alias("speculative"),
        info("Launch Time").alias("launch_ms"),
        info("Finish Time").alias("finish_ms"),
        F.col("j.`Task Type`").alias("task_type"),
        F.col("j.`Task End Reason`.Reason").alias("task_end_reason"),
        metric("Executor Run Time").alias("exec_run_ms"),
        metric("Executor CPU Time").alias("exec_cpu_ns"),
        metric("Executor Deserialize Time").alias("deserialize_ms"),
        metric("JVM GC Time").alias("gc_ms"),
        metric("Memory Bytes Spilled").alias("mem_spill_bytes"),
        metric("Disk Bytes Spilled").alias("disk_spill_bytes"),
        metric("Input Metrics/Bytes Read").alias("input_bytes"),
        metric("Input Metrics/Records Read").alias("input_records"),
        (
            metric("Shuffle Read Metrics/Remote Bytes Read")
            + metric("Shuffle Read Metrics/Local Bytes Read")
        ).alias("shuffle_read_bytes"),
        metric("Shuffle Read Metrics/Total Records Read").alias("shuffle_read_records"),
        metric("Shuffle Read Metrics/Fetch Wait Time").alias("shuffle_fetch_wait_ms"),
        metric("Shuffle Write Metrics/Shuffle Bytes Written").alias("shuffle_write_bytes"),
        metric("Shuffle Write Metrics/Shuffle Records Written").alias("shuffle_write_records"),
        metric("Shuffle Write Metrics/Shuffle Write Time").alias("shuffle_write_time_ns"),
        F.transform(
            F.filter(
                info("Accumulables"),
                lambda a: (a["Metadata"] == "sql") & to_int(a["ID"]).isNotNull(),
            ),
            lambda a: F.struct(to_int(a["ID"]).alias("acc_id"), a["Value"].alias("value")),
        ).alias("sql_accums"),
    )


def route(events: DataFrame, *kinds: str) -> DataFrame:
    """Events of the given kinds; full names, nothing else matches."""
    return events.filter(F.col("event").isin(*kinds))


def event_counts(lines: DataFrame) -> DataFrame:
    """Lines per event name, from a decoding of just that key."""
    named = _decode(lines, _NAME_ONLY).filter(~F.col("is_bad"))
    return named.groupBy("log_id", F.col("j.Event").alias("event")).agg(F.count("*").alias("n"))
