"""Accumulator values of stages, tied to plan operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.functions import is_ancestor, path_key, strip, to_int

ROW_COUNT = "number of output rows"
SCAN = "Scan parquet"


def is_scan(node_name: Column, match: str = "exact") -> Column:
    """Parquet scans; ``match='prefix'`` also takes scans of named tables."""
    name = F.coalesce(strip(node_name), F.lit(""))
    if match == "prefix":
        return (name == SCAN) | name.startswith(SCAN + " ")
    if match != "exact":
        raise ValueError(f"match must be 'exact' or 'prefix', not {match!r}")
    return name == SCAN


def is_filter(node_name: Column) -> Column:
    return F.coalesce(strip(node_name), F.lit("")) == "Filter"


def is_metric(metric_name: Column, name: str) -> Column:
    return F.coalesce(strip(metric_name), F.lit("")) == name


def order_by_path(df: DataFrame, ascending: bool = True) -> DataFrame:
    """Adds ``position``: the place of each metric of an execution in the order of paths.

    Paths are ordered within (log, execution), equal ones by accumulator, so nothing is
    sorted across executions.
    """
    key = path_key(F.col("node_path"))
    order = Window.partitionBy("log_id", "execution_id").orderBy(
        key.asc() if ascending else key.desc(), "acc_id"
    )
    return df.withColumn("position", F.row_number().over(order))


def resolve_stage_metrics(stage_accumulables: DataFrame, plan_metrics: DataFrame) -> DataFrame:
    """Stage accumulators that belong to a plan operator.

    A plain equi join: plan_metrics is unique per key, so the output is no
    larger than the input; Spark broadcasts it only where its measured size
    allows, and splits hot accumulators at run time otherwise.
    """
    return (
        stage_accumulables.filter(F.col("acc_id").isNotNull())
        .join(plan_metrics.drop("metric_type", "execution_id"), ["log_id", "acc_id"])
        .withColumn("path_key", path_key(F.col("node_path")))
    )


def stage_plan_metrics(resolved: DataFrame, match: str = "exact") -> DataFrame:
    """:func:`resolve_stage_metrics` with the post-scan filters marked.

    The post-scan filter of a stage is the nearest one above its deepest scan.  Both are
    found among the stage's own metrics, in one window pass over them.
    """
    stage = Window.partitionBy(*S.STAGE_KEY)
    # On equal paths the metric listed first wins.
    at = F.struct("path_key", (-F.col("pos")).alias("pos"))
    counted = is_metric(F.col("metric_name"), ROW_COUNT)
    scans = counted & is_scan(F.col("node_name"), match)
    above = is_ancestor(F.col("node_path"), F.col("scan_path"))
    filters = counted & is_filter(F.col("node_name")) & above
    return (
        resolved.withColumn("scan_path", F.max_by("node_path", F.when(scans, at)).over(stage))
        .withColumn("nearest", F.max_by("acc_id", F.when(filters, at)).over(stage))
        .select(
            *S.STAGE_KEY,
            "acc_id",
            "value",
            "node_name",
            "node_path",
            "metric_name",
            "file_name",
            "schema_name",
            F.when(F.col("acc_id") == F.col("nearest"), "post_scan").alias("filter_role"),
            "path_key",
            "pos",
        )
    )


def stage_scans(metrics: DataFrame, match: str = "exact") -> DataFrame:
    """One row per stage attempt with a scan or a filter: what the topmost ones counted.

    ``filter_rows`` is that of the topmost filter, ``post_scan_rows`` that of the marked one.
    """

    def topmost(what: Column, when: Column) -> Column:
        # Topmost path; of equal paths the last listed.
        at = F.struct("path_key", (-F.col("pos")).alias("pos"))
        return F.min_by(F.struct(what.alias("v")), F.when(when, at))["v"]

    scan = is_scan(F.col("node_name"), match)
    rows = is_metric(F.col("metric_name"), ROW_COUNT)
    filters = is_filter(F.col("node_name")) & rows
    value = to_int(F.col("value"))
    return (
        metrics.filter(scan | filters)
        .groupBy(*S.STAGE_KEY)
        .agg(
            topmost(value, scan & rows).alias("scan_rows"),
            topmost(value, scan & is_metric(F.col("metric_name"), "scan time")).alias("scan_time_ms"),
            topmost(F.col("file_name"), scan).alias("file_name"),
            topmost(value, filters).alias("filter_rows"),
            topmost(value, filters & F.col("filter_role").eqNullSafe("post_scan")).alias("post_scan_rows"),
        )
    )
