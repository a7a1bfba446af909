"""One query per operator, over event logs made from the given tables.

Each callable takes ``(spark, sf_dir)``.  The log lines are built from all rows
of region, nation, customer and orders; decoding and fact tables are shared by
the queries of a session through a store in the shared folder, as a user would
run many reports over one set of logs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import LogFacts, configure, shared_folder
from eventlens import functions as fn
from eventlens import reports as R
from eventlens import schema as S
from eventlens.plans.metrics import order_by_path
from eventlens.sources import parse_events, read_events, route, skip_blank
from workload.synth import synth_lines

Query = Callable[[SparkSession, str], DataFrame]

_lines: dict[tuple[str, str], DataFrame] = {}
_facts: dict[tuple, LogFacts] = {}
_files: dict[tuple[str, str, str], str] = {}

#: Lines that a task sorts to write logs, some 50 MB of text.
LINES_PER_TASK = 100_000


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    return spark.sparkContext.applicationId, sf_dir


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log lines, written once per session."""
    key = _key(spark, sf_dir)
    if key not in _lines:
        path = shared_folder(configure(spark), "lines")
        synth_lines(spark, sf_dir).write.parquet(path)
        _lines[key] = spark.read.parquet(path)
    return _lines[key]


def facts_of(spark: SparkSession, sf_dir: str, **options) -> LogFacts:
    """The facts of the logs; each set of options has a store of its own."""
    key = (*_key(spark, sf_dir), *sorted(options.items()))
    if key not in _facts:
        store = shared_folder(spark, "facts")
        _facts[key] = LogFacts(spark, lines_of(spark, sf_dir), store=store, **options)
    return _facts[key]


def log_files(spark: SparkSession, sf_dir: str, codec: str = "none") -> str:
    """The logs as text files, one folder per log, lines in log order."""
    key = (*_key(spark, sf_dir), codec)
    if key not in _files:
        path = shared_folder(spark, "logs")
        _write_logs(lines_of(spark, sf_dir), path, codec)
        _files[key] = path
    return _files[key]


def _write_logs(
    lines: DataFrame, path: str, codec: str = "gzip", folders: Sequence[str] = ()
) -> None:
    """Adds the lines to the logs of a folder, or to those of each of its ``folders``.

    The tasks grow in number with the lines, not in size: left to itself, Spark puts 64 MB
    of compressed lines in one, whose sort then spills.  Lines for several folders are
    copied behind the shuffle.
    """
    tasks = max(1, ceil(lines.count() * max(1, len(folders)) / LINES_PER_TASK))
    dealt, by = lines.repartitionByRange(tasks, "log_id", "seq"), ["log_id"]
    if folders:
        dealt = dealt.withColumn("folder", F.explode(F.array(*map(F.lit, folders))))
        by = ["folder", "log_id"]
    (
        dealt.sortWithinPartitions(*by, "seq")
        .select(*by, "value")
        .write.mode("append").partitionBy(*by)
        .text(path, compression=codec)
    )


def _log_name(df: DataFrame) -> DataFrame:
    return df.withColumn("log_id", F.regexp_replace("log_id", "^log_id=", ""))


def _flat(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays of a table as joined text, so that its rows can be hashed."""
    return df.withColumns(
        {a: F.array_join(F.transform(a, lambda x: x.cast("string")), "|") for a in arrays}
    )


# --- sources


def q_read_events(spark, sf_dir):
    lines = read_events(spark, log_files(spark, sf_dir, "gzip"))
    return _log_name(lines).groupBy("log_id").agg(F.count("*").alias("n"))


def q_read_events_same_name(spark, sf_dir):
    """The logs twice, in two folders with equal names below."""
    path = shared_folder(spark, "same-names")
    _write_logs(lines_of(spark, sf_dir), path, folders=("first", "second"))
    lines = read_events(spark, path)
    return (
        lines.withColumn("log_id", F.regexp_replace("log_id", "folder=|log_id=", ""))
        .groupBy("log_id").agg(F.count("*").alias("n"))
    )


def q_read_events_order(spark, sf_dir):
    files = log_files(spark, sf_dir, "gzip")
    facts = LogFacts(spark, files, store=shared_folder(spark, "ordered"))
    return _log_name(facts.stage_submissions).select(*S.STAGE_KEY, "job_id")


def q_skip_blank(spark, sf_dir):
    lines = skip_blank(facts_of(spark, sf_dir).lines)
    return lines.groupBy("log_id").agg(F.count("*").alias("n"))


def q_parse_events(spark, sf_dir):
    events = parse_events(facts_of(spark, sf_dir).lines, [S.TASK_END])
    return events.select(
        "log_id", "seq", "task.stage_id", "task.task_id", "task.launch_ms", "task.finish_ms"
    )


def q_parse_events_all_kinds(spark, sf_dir):
    """Events of all ten kinds, and the sum of the ids that each kind is keyed by."""
    events = parse_events(facts_of(spark, sf_dir).lines)
    ids = F.coalesce("task.task_id", "stage.stage_id", "job.job_id", "execution_id")
    return events.groupBy("log_id", "event").agg(F.count("*").alias("n"), F.sum(ids).alias("ids"))


def q_plan_nodes_initial(spark, sf_dir):
    nodes = facts_of(spark, sf_dir, initial_plans=True).plan_nodes
    return nodes.groupBy("log_id", "execution_id").agg(F.count("*").alias("n"))


def q_scan_selectivity_prefix(spark, sf_dir):
    return R.scan_selectivity(facts_of(spark, sf_dir, match="prefix"))


def q_trace_one_execution(spark, sf_dir):
    return R.execution_trace(facts_of(spark, sf_dir), 0, "synth-0")


def q_route_events(spark, sf_dir):
    return facts_of(spark, sf_dir).event_counts


def q_bad_lines(spark, sf_dir):
    """Lines that are no JSON, of logs in which every 97th task start was cut off."""
    cut = F.col("seq").between(50 * 10**9, 60 * 10**9 - 1) & (F.col("seq") % 97 == 13)
    lines = lines_of(spark, sf_dir)
    damaged = lines.withColumn("value", F.when(cut, F.left("value", F.lit(40))).otherwise(F.col("value")))
    return LogFacts(spark, damaged, store=shared_folder(spark, "damaged")).bad_lines


def q_read_events_added(spark, sf_dir):
    """Events per log of a folder that gained logs after its store was made."""
    folder, store = shared_folder(spark, "history"), shared_folder(spark, "grown")
    lines = lines_of(spark, sf_dir)
    late = F.substring_index("log_id", "-", -1).cast("int") % 2 == 1
    counts = None
    for some in (~late, late):
        _write_logs(lines.filter(some), folder)
        counts = LogFacts(spark, folder, store=store).event_counts
    return _log_name(counts)


# --- executions and jobs


def q_executions(spark, sf_dir):
    return facts_of(spark, sf_dir).executions


def q_statement_id(spark, sf_dir):
    return facts_of(spark, sf_dir).executions.select("log_id", "execution_id", "statement_id")


def q_write_flag(spark, sf_dir):
    return facts_of(spark, sf_dir).executions.select("log_id", "execution_id", "has_write_op")


def q_epoch_utc(spark, sf_dir):
    return facts_of(spark, sf_dir).tasks.select(
        "log_id",
        "task_id",
        (F.col("launch_ms") / F.lit(1000.0)).alias("launch_s"),
        fn.utc_text(F.col("launch_ms")).alias("launch_text"),
    )


def q_driver_accums(spark, sf_dir):
    return facts_of(spark, sf_dir).driver_accums


def q_jobs(spark, sf_dir):
    return _flat(facts_of(spark, sf_dir).jobs, "stage_ids")


def q_job_stages(spark, sf_dir):
    return facts_of(spark, sf_dir).job_stages


# --- stages


def q_stages(spark, sf_dir):
    return _flat(facts_of(spark, sf_dir).stages, "scope_names", "rdd_ids")


def q_stage_job_asof(spark, sf_dir):
    return facts_of(spark, sf_dir).stage_submissions.select(
        *S.STAGE_KEY, F.col("seq").alias("submit_seq"), "job_id"
    )


def q_stage_rdd_types(spark, sf_dir):
    return facts_of(spark, sf_dir).stage_rdd_types


def q_stage_scopes(spark, sf_dir):
    return facts_of(spark, sf_dir).stages.select(
        *S.STAGE_KEY, F.explode("scope_names").alias("scope_name")
    )


def q_stage_flags(spark, sf_dir):
    return facts_of(spark, sf_dir).stages.select(
        *S.STAGE_KEY, "has_scan_parquet", "has_broadcasted_data", "has_whole_stage_codegen"
    )


def q_stage_accumulables(spark, sf_dir):
    return facts_of(spark, sf_dir).stage_accumulables.select(*S.STAGE_KEY, "acc_id", "value")


# --- plans


def q_plan_nodes(spark, sf_dir):
    return facts_of(spark, sf_dir).plan_nodes.select(
        "log_id",
        "execution_id",
        "node_path",
        "node_name",
        "simple_string",
        F.col("metadata")["Location"].alias("location"),
        "file_name",
        "schema_name",
    )


def q_final_plan(spark, sf_dir):
    plans = route(facts_of(spark, sf_dir).events, S.SQL_PLAN).filter("plan_json IS NOT NULL")
    return plans.select("log_id", "execution_id", "seq")


def q_scan_location(spark, sf_dir):
    nodes = facts_of(spark, sf_dir).plan_nodes.filter("file_name <> ''")
    return nodes.select("log_id", "execution_id", "node_path", "schema_name", "file_name")


def q_plan_metrics(spark, sf_dir):
    return facts_of(spark, sf_dir).plan_metrics


# --- tasks


def q_tasks(spark, sf_dir):
    return facts_of(spark, sf_dir).tasks.select(
        *S.TASK_KEY,
        "partition_id",
        "executor_id",
        "host",
        "locality",
        "speculative",
        "launch_ms",
        "finish_ms",
        "task_type",
        "task_end_reason",
        "duration_ms",
        "ended",
    )


def q_task_metrics(spark, sf_dir):
    from eventlens.operators.tasks import METRIC_COLS

    return facts_of(spark, sf_dir).tasks.filter("ended").select(*S.TASK_KEY, *METRIC_COLS)


def q_task_sql_accums(spark, sf_dir):
    return facts_of(spark, sf_dir).task_sql_accums


# --- joins and look-ups


def q_stage_plan_metrics(spark, sf_dir):
    return facts_of(spark, sf_dir).stage_plan_metrics.select(
        *S.STAGE_KEY, "acc_id", "value", "node_name", "node_path", "metric_name", "file_name",
        "schema_name",
    )


def q_post_scan_filter(spark, sf_dir):
    marked = facts_of(spark, sf_dir).stage_plan_metrics.filter("filter_role IS NOT NULL")
    return marked.select(*S.STAGE_KEY, "acc_id", "node_path", "filter_role")


def q_is_ancestor(spark, sf_dir):
    nodes = facts_of(spark, sf_dir).plan_nodes
    return nodes.select(
        "log_id",
        "execution_id",
        "node_path",
        fn.is_ancestor(F.lit("0.1"), F.col("node_path")).alias("below_0_1"),
    )


def q_execution_jobs(spark, sf_dir):
    return R.execution_jobs(facts_of(spark, sf_dir)).select(
        "log_id", "execution_id", "job_id", "submission_ms"
    )


def q_job_stage_list(spark, sf_dir):
    return R.job_stage_list(facts_of(spark, sf_dir)).select("job_id", *S.STAGE_KEY, "submit_seq")


def q_stage_tasks(spark, sf_dir):
    return R.stage_tasks(facts_of(spark, sf_dir)).select(*S.TASK_KEY, "duration_ms")


def q_skipped_stages(spark, sf_dir):
    return R.skipped_stages(facts_of(spark, sf_dir))


def q_write_executions(spark, sf_dir):
    return R.write_executions(facts_of(spark, sf_dir))


# --- reports


def q_slowest_stages(spark, sf_dir):
    return R.slowest_stages(facts_of(spark, sf_dir))


def q_slowest_tasks(spark, sf_dir):
    return R.slowest_tasks(facts_of(spark, sf_dir))


def q_skew_suspects(spark, sf_dir):
    return R.skew_suspects(facts_of(spark, sf_dir))


def q_slowest_files(spark, sf_dir):
    return R.slowest_files(facts_of(spark, sf_dir))


def q_stage_task_counts(spark, sf_dir):
    return R.stage_task_counts(facts_of(spark, sf_dir))


def q_scan_selectivity(spark, sf_dir):
    return R.scan_selectivity(facts_of(spark, sf_dir))


def q_scan_selectivity_post_scan(spark, sf_dir):
    return R.scan_selectivity(facts_of(spark, sf_dir), use_post_scan=True)


def q_task_breakdown(spark, sf_dir):
    return R.task_breakdown(facts_of(spark, sf_dir))


def q_stage_summary(spark, sf_dir):
    return R.stage_summary(facts_of(spark, sf_dir))


def q_job_summary(spark, sf_dir):
    return R.job_summary(facts_of(spark, sf_dir))


def q_execution_overview(spark, sf_dir):
    parts = R.execution_overview(facts_of(spark, sf_dir))
    key = ["log_id", "execution_id", "stage_id", "stage_attempt_id"]
    picked = [
        parts["slowest_stages"].select(
            F.lit("slowest_stages").alias("block"), *key, "rank",
            F.lit(None).cast("bigint").alias("task_id"), "duration_ms",
        ),
        parts["slowest_tasks"].select(F.lit("slowest_tasks"), *key, "rank", "task_id", "duration_ms"),
        parts["skew_suspects"].select(
            F.lit("skew_suspects"), *key, F.lit(None).cast("int"), "task_id", "max_ms"
        ),
    ]
    return reduce(DataFrame.union, picked)


def q_trace_execution(spark, sf_dir):
    return R.trace_execution(facts_of(spark, sf_dir))["trace"]


def q_trace_execution_tasks(spark, sf_dir):
    trace = R.execution_trace(facts_of(spark, sf_dir), task_breakdown=True)
    return trace.select(
        "log_id", "execution_id", "job_id", "stage_id", "stage_attempt_id", "stage_duration_ms",
        "task_id", "task_attempt_id", "duration_ms", "locality", "input_records", "input_bytes",
        "shuffle_read_bytes", "disk_spill_bytes",
    )


# --- scalar functions, on columns of the tables above


def q_to_int(spark, sf_dir):
    tasks = facts_of(spark, sf_dir).tasks
    return tasks.select(
        "log_id",
        "task_id",
        fn.to_int(F.concat(F.lit(" "), F.col("executor_id"), F.lit(" "))).alias("padded"),
        fn.to_int(F.concat("executor_id", F.lit(".5"))).alias("fraction_text"),
        fn.to_int((F.col("input_bytes") / 1000).cast("double")).alias("fraction"),
        fn.to_int(F.col("locality")).alias("word"),
    )


def q_int_or_zero(spark, sf_dir):
    tasks = facts_of(spark, sf_dir).tasks
    return tasks.select(
        "log_id",
        "task_id",
        fn.int_or_zero(F.col("executor_id")).alias("number"),
        fn.int_or_zero(F.col("locality")).alias("word"),
        fn.int_or_zero(F.col("finish_ms")).alias("missing"),
    )


def q_duration_seconds(spark, sf_dir):
    tasks = facts_of(spark, sf_dir).tasks
    return tasks.select(
        "log_id",
        "task_id",
        fn.duration_seconds(F.col("duration_ms")).alias("seconds"),
        fn.duration_seconds(F.col("exec_cpu_ns"), "ns").alias("cpu_seconds"),
        fn.duration_seconds(F.col("duration_ms"), "h").alias("unknown_unit"),
    )


def q_duration_text(spark, sf_dir):
    tasks = facts_of(spark, sf_dir).tasks
    return tasks.select(
        "log_id",
        "task_id",
        fn.duration_text(F.col("duration_ms") / F.lit(10.0)).alias("tenths"),
        fn.duration_text(F.col("launch_ms") / F.lit(10.0)).alias("large"),
    )


def q_fmt_seconds(spark, sf_dir):
    tasks = facts_of(spark, sf_dir).tasks
    return tasks.select(
        "log_id",
        "task_id",
        fn.fmt_seconds(F.col("duration_ms")).alias("duration"),
        fn.fmt_seconds(F.col("exec_cpu_ns") * 100, "ns").alias("cpu"),
    )


def q_kb_text(spark, sf_dir):
    tasks = facts_of(spark, sf_dir).tasks
    return tasks.select(
        "log_id",
        "task_id",
        fn.kb_text(F.col("input_bytes")).alias("input_kb"),
        fn.kb_text(F.col("input_bytes") * 1000).alias("large_kb"),
    )


def q_metric_value_text(spark, sf_dir):
    rows = facts_of(spark, sf_dir).stage_plan_metrics
    return rows.select(
        *S.STAGE_KEY,
        "acc_id",
        fn.metric_value_text(F.col("metric_name"), F.col("value")).alias("text"),
    )


def q_path_key(spark, sf_dir):
    nodes = facts_of(spark, sf_dir).plan_nodes
    key = fn.path_key(F.col("node_path"))
    return nodes.select(
        "log_id",
        "execution_id",
        "node_path",
        F.size(key).alias("depth"),
        F.element_at(key, -1).alias("last_part"),
        F.array_join(key.cast("array<string>"), "/").alias("key_text"),
    )


def q_order_by_path(spark, sf_dir):
    rows = facts_of(spark, sf_dir).plan_metrics
    return order_by_path(rows).select("log_id", "execution_id", "acc_id", "node_path", "position")


def q_thousands_text(spark, sf_dir):
    tasks = facts_of(spark, sf_dir).tasks
    return tasks.select(
        "log_id",
        "task_id",
        fn.thousands_text(F.col("input_bytes")).alias("bytes_text"),
        fn.thousands_text(F.col("task_id")).alias("id_text"),
    )


def all_queries() -> dict[str, Query]:
    return {
        name.removeprefix("q_"): query
        for name, query in globals().items()
        if name.startswith("q_")
    }
