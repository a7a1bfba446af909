"""SQL executions and their driver-side accumulator values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.functions import utc_text
from eventlens.operators.fold import last_of
from eventlens.sources.events import route


def statement_id(description: Column) -> Column:
    """Text between the first "statement " and the next colon."""
    start = F.instr(description, "statement ")
    rest = F.substring(description, start + F.lit(len("statement ")), F.length(description))
    return F.when(start > 0, F.substring_index(rest, ":", 1))


def write_flag(description: Column) -> Column:
    return F.coalesce(description.contains("write.mode"), F.lit(False))


def executions(events: DataFrame) -> DataFrame:
    """One row per SQL execution, from its start and end events."""
    event = F.col("event")
    folded = (
        route(events, S.SQL_START, S.SQL_END)
        .groupBy("log_id", "execution_id")
        .agg(
            last_of(event == S.SQL_START, "root_execution_id", "description", "time_ms").alias("s"),
            last_of(event == S.SQL_END, "time_ms").alias("e"),
        )
    )
    start_ms, end_ms, description = F.col("s.time_ms"), F.col("e.time_ms"), F.col("s.description")
    return folded.select(
        "log_id",
        "execution_id",
        "s.root_execution_id",
        statement_id(description).alias("statement_id"),
        description,
        (start_ms / F.lit(1000.0)).alias("epoch_start_time"),
        utc_text(start_ms).alias("start_time"),
        F.when(F.col("s").isNotNull(), write_flag(description)).alias("has_write_op"),
        (end_ms / F.lit(1000.0)).alias("epoch_end_time"),
        utc_text(end_ms).alias("end_time"),
        start_ms.alias("start_ms"),
        end_ms.alias("end_ms"),
    )


def driver_accums(events: DataFrame) -> DataFrame:
    """Last value per (execution, accumulator) of the driver's updates."""
    pairs = route(events, S.SQL_ACCUMS).select(
        "log_id", "execution_id", "seq", F.posexplode("accum_updates").alias("pos", "pair")
    )
    return (
        pairs.select(
            "log_id",
            "execution_id",
            F.get("pair", F.lit(0)).alias("acc_id"),
            F.get("pair", F.lit(1)).alias("value"),
            F.struct("seq", "pos").alias("at"),
        )
        .groupBy("log_id", "execution_id", "acc_id")
        .agg(F.max_by("value", "at").alias("value"))
    )
