"""Plan trees to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.functions import path_key, to_int
from eventlens.session import configure
from eventlens.sources.events import route

# Levels of the tree decoded in one pass.  A recursion step handles that many
# levels at once; plans are usually done in two or three steps, and the text of a
# subtree is decoded again only every LEVELS levels.  (The analyzer needs about
# seven of its 100 iterations per level of nested lambdas.)
LEVELS = 10

_FIELDS = (
    "nodeName: STRING, simpleString: STRING, metadata: MAP<STRING, STRING>, "
    "metrics: ARRAY<STRUCT<name: STRING, accumulatorId: STRING, metricType: STRING>>"
)
_NO_NODE = (
    "CAST(NULL AS STRING) AS node_name, CAST(NULL AS STRING) AS simple_string, "
    "CAST(NULL AS MAP<STRING, STRING>) AS metadata, "
    "CAST(NULL AS ARRAY<STRUCT<name: STRING, accumulatorId: STRING, metricType: STRING>>) AS metrics"
)


def _tree_type(levels: int) -> str:
    """Type of a node whose children below ``levels`` levels stay JSON text."""
    child = "STRING" if levels == 1 else _tree_type(levels - 1)
    return f"STRUCT<{_FIELDS}, children: ARRAY<{child}>>"


def _nodes(node: str, path: str, levels: int) -> str:
    """SQL for the nodes of a decoded tree in preorder, as an array of structs.

    Entries with ``rest`` are roots of deeper subtrees that are still text.
    """
    own = (
        f"array(named_struct('path', {path}, 'rest', CAST(NULL AS STRING), "
        f"'node_name', {node}.nodeName, 'simple_string', {node}.simpleString, "
        f"'metadata', {node}.metadata, 'metrics', {node}.metrics))"
    )
    child, i = f"c{levels}", f"i{levels}"
    child_path = f"concat({path}, '.', {i})"
    if levels == 1:
        below = (
            f"transform(coalesce({node}.children, array()), ({child}, {i}) -> "
            f"struct({child_path} AS path, {child} AS rest, {_NO_NODE}))"
        )
    else:
        below = (
            f"flatten(transform(coalesce({node}.children, array()), ({child}, {i}) -> "
            f"{_nodes(child, child_path, levels - 1)}))"
        )
    return f"concat({own}, {below})"


def flatten_plans(events: DataFrame, initial_plans: bool = False) -> DataFrame:
    """Nodes of all final plans, one row per plan event and node.

    Path "0" is the root, child i of p is "p.i".  ``initial_plans`` also takes
    the plans logged at the start of executions, which covers plans without an
    adaptive root; later plans of the same execution win over them.
    """
    spark = configure(events.sparkSession)
    kinds = [S.SQL_PLAN, S.SQL_START] if initial_plans else [S.SQL_PLAN]
    plans = (
        route(events, *kinds)
        .filter(F.col("plan_json").isNotNull())
        .select("log_id", "execution_id", "seq", "plan_json")
    )
    decode = f"'{_tree_type(LEVELS)}'"
    return spark.sql(
        f"""
        WITH RECURSIVE blocks(log_id, execution_id, seq, nodes) AS (
          SELECT log_id, execution_id, seq, {_nodes('tree', "path", LEVELS)}
          FROM (SELECT *, '0' AS path, explode(array(from_json(plan_json, {decode}))) AS tree
                FROM {{plans}})
          UNION ALL
          SELECT log_id, execution_id, seq, {_nodes('tree', "path", LEVELS)}
          FROM (SELECT log_id, execution_id, seq, sub.path,
                       explode(array(from_json(sub.rest, {decode}))) AS tree
                FROM blocks LATERAL VIEW explode(filter(nodes, n -> n.rest IS NOT NULL)) AS sub)
        )
        SELECT log_id, execution_id, seq, node.path AS node_path, node.node_name,
               node.simple_string, coalesce(node.metadata, map()) AS metadata, node.metrics
        FROM blocks LATERAL VIEW explode(filter(nodes, n -> n.rest IS NULL)) AS node
        """,
        plans=plans,
    )


def scan_location(location: Column) -> tuple[Column, Column]:
    """File name and schema name: the last two parts of a scanned location."""
    parts = F.split(F.coalesce(location, F.lit("")), "/")
    known = F.size(parts) >= 2
    file_name = F.when(known, F.replace(F.element_at(parts, -1), F.lit("]"), F.lit("")))
    schema_name = F.when(known, F.element_at(parts, -2))
    return F.coalesce(file_name, F.lit("")), F.coalesce(schema_name, F.lit(""))


def plan_nodes(tree: DataFrame) -> DataFrame:
    """Last node seen per execution and path, from :func:`flatten_plans`."""
    file_name, schema_name = scan_location(F.col("metadata")["Location"])
    return (
        tree.groupBy("log_id", "execution_id", "node_path")
        .agg(F.max_by(F.struct("node_name", "simple_string", "metadata"), "seq").alias("n"))
        .select("log_id", "execution_id", "node_path", "n.*")
        .withColumns({"file_name": file_name, "schema_name": schema_name})
    )


def plan_metrics(tree: DataFrame) -> DataFrame:
    """Operator and metric behind each accumulator; the last one visited wins."""
    file_name, schema_name = scan_location(F.col("metadata")["Location"])
    return (
        tree.select(
            "log_id",
            "execution_id",
            "seq",
            "node_path",
            "node_name",
            file_name.alias("file_name"),
            schema_name.alias("schema_name"),
            F.posexplode("metrics").alias("pos", "metric"),
        )
        .withColumn("acc_id", to_int(F.col("metric.accumulatorId")))
        .filter(F.col("acc_id").isNotNull())
        .groupBy("log_id", "acc_id")
        .agg(
            F.max_by(
                F.struct(
                    "execution_id",
                    "node_name",
                    "node_path",
                    F.col("metric.name").alias("metric_name"),
                    F.col("metric.metricType").alias("metric_type"),
                    "file_name",
                    "schema_name",
                ),
                F.struct("seq", path_key(F.col("node_path")), "pos"),
            ).alias("m")
        )
        .select("log_id", "acc_id", "m.*")
    )
