"""Task attempts and their SQL accumulators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.operators.fold import last_of, last_per_id
from eventlens.sources.events import route

START_COLS = ["partition_id", "executor_id", "host", "locality", "speculative", "launch_ms"]
METRIC_COLS = [
    "exec_run_ms",
    "exec_cpu_ns",
    "deserialize_ms",
    "gc_ms",
    "mem_spill_bytes",
    "disk_spill_bytes",
    "input_bytes",
    "input_records",
    "shuffle_read_bytes",
    "shuffle_read_records",
    "shuffle_fetch_wait_ms",
    "shuffle_write_bytes",
    "shuffle_write_records",
    "shuffle_write_time_ns",
]
END_COLS = ["finish_ms", "task_type", "task_end_reason", *METRIC_COLS]


def _task_events(events: DataFrame, *kinds: str) -> DataFrame:
    # Events that miss a part of the key are dropped.
    has_key = F.lit(True)
    for part in S.TASK_KEY[1:]:
        has_key = has_key & F.col(f"task.{part}").isNotNull()
    return route(events, *kinds).filter(has_key)


def _by_task(df: DataFrame):
    return df.groupBy("log_id", *[F.col(f"task.{part}") for part in S.TASK_KEY[1:]])


def tasks_with_accums(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per task attempt, from its start and end events, with ``sql_accums``.

    One shuffle of the start and end rows, ranged by (log, stage, task, attempt): no single
    stage or log makes it uneven, and as files the rows of a log lie together, so a
    report on one log reads few of them.  Task keys hardly repeat within an input split;
    rows are exchanged before the fold, which spares a sort on the map side.
    ``partitions`` of None leaves their number to the session.
    """
    event = F.col("event")
    rows = _task_events(events, S.TASK_START, S.TASK_END)
    keys = ["log_id", *[F.col(f"task.{part}") for part in S.TASK_KEY[1:]]]
    rows = rows.repartitionByRange(*([partitions] if partitions else []), *keys)
    folded = _by_task(rows).agg(
        last_of(event == S.TASK_START, *[f"task.{c}" for c in START_COLS]).alias("s"),
        last_of(
            event == S.TASK_END,
            F.col("task.launch_ms").alias("end_launch_ms"),
            *[f"task.{c}" for c in END_COLS],
        ).alias("e"),
        last_of(
            (event == S.TASK_END) & (F.size("task.sql_accums") > 0), "task.sql_accums"
        ).alias("a"),
    )
    launched = F.coalesce(F.nullif(F.col("s.launch_ms"), F.lit(0)), F.col("e.end_launch_ms"))
    return folded.select(
        *S.TASK_KEY,
        *[f"s.{c}" for c in START_COLS],
        "e.finish_ms",
        (F.col("e.finish_ms") - launched).alias("duration_ms"),
        *[f"e.{c}" for c in END_COLS if c != "finish_ms"],
        F.col("e").isNotNull().alias("ended"),
        F.col("a.sql_accums").alias("sql_accums"),
    )


def tasks(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per task attempt; see :func:`tasks_with_accums`."""
    return tasks_with_accums(events, partitions).drop("sql_accums")


def accums_of(rows: DataFrame) -> DataFrame:
    """SQL accumulator values per task attempt, from rows with ``sql_accums``.

    The last value per id wins.  No shuffle.
    """
    return rows.filter("sql_accums is not null").select(
        *S.TASK_KEY, F.inline(last_per_id(F.col("sql_accums")))
    ).drop("pos")


def task_sql_accums(events: DataFrame) -> DataFrame:
    """SQL accumulator values per task attempt."""
    return accums_of(tasks_with_accums(events))
