"""Event logs made from relational tables, for tests and measurements.

Region is an execution, nation a job, customer a stage, order a task.  Every
thousand customers make one application log, so the number of logs grows with
the tables and no line grows without bound.  The rules are in FIXTURES.md.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens import schema as S

BASE_MS = 1_700_000_000_000
CUSTOMERS_PER_LOG = 1000
_BILLION = 1_000_000_000


def _log(custkey: str) -> Column:
    return F.concat(
        F.lit("synth-"), F.floor(F.col(custkey) / CUSTOMERS_PER_LOG).cast("string")
    ).alias("log_id")


def _line(df: DataFrame, seq: Column, event: str, **fields: Column) -> DataFrame:
    return df.select(
        "log_id",
        seq.cast("bigint").alias("seq"),
        F.to_json(
            F.struct(F.lit(event).alias("Event"), *[v.alias(k) for k, v in fields.items()])
        ).alias("value"),
    )


def _struct(**fields: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in fields.items()])


def synth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_id, seq, value)`` lines built from region, nation, customer and orders."""

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    n, c, o = F.col("n"), F.col("c"), F.col("o")
    nation = table("nation").select(F.col("n_nationkey").alias("n"), "n_name", "n_regionkey")
    customer = table("customer").select(
        _log("c_custkey"), F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n"),
        "c_name", "c_acctbal", "c_mktsegment",
    )
    order = table("orders").select(
        _log("o_custkey"), F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c"),
        "o_orderstatus", "o_totalprice", "o_orderpriority",
    )

    # --- jobs: own customers, and every fifth customer of the nation before
    declared = customer.select("log_id", "n", "c").union(
        customer.filter("c % 5 = 0 AND n < 24").select("log_id", n + 1, "c")
    )
    jobs = (
        declared.groupBy("log_id", "n")
        .agg(F.array_sort(F.collect_list("c")).alias("stage_ids"))
        .join(nation, "n")
    )
    executions = (
        jobs.groupBy("log_id", F.col("n_regionkey").alias("r"))
        .agg(F.array_sort(F.collect_list("n")).alias("nations"))
        .join(table("region").withColumnRenamed("r_regionkey", "r"), "r")
    )
    r = F.col("r")
    exec_prefix = F.when(r == 4, F.lit("run s4: ")).otherwise(F.concat(F.lit("run statement s"), r, F.lit(": ")))
    write = F.when(r % 2 == 0, F.lit(" write.mode=overwrite")).otherwise(F.lit(""))

    lines = [
        _line(
            executions, r - 1000, S.SQL_START,
            executionId=r,
            rootExecutionId=r,
            description=F.concat(exec_prefix, F.col("r_name"), write),
            time=F.lit(BASE_MS) + r * 3_600_000,
        ),
        _line(
            executions, r - 500, S.SQL_PLAN,
            executionId=r,
            sparkPlanInfo=_struct(
                nodeName=F.lit("AdaptiveSparkPlan"),
                simpleString=F.lit("AdaptiveSparkPlan isFinalPlan=false"),
                metrics=F.array(),
                children=F.transform(
                    "nations",
                    lambda k: _struct(
                        nodeName=F.lit("Exchange"),
                        metrics=F.array(_metric("number of output rows", k * 10 + 1)),
                    ),
                ),
            ),
        ),
        _line(
            jobs, n.cast("bigint") * _BILLION, S.JOB_START,
            **{
                "Job ID": n,
                "Submission Time": F.lit(BASE_MS) + n * 60_000,
                "Stage IDs": F.col("stage_ids"),
                "Properties": _struct(
                    **{
                        "spark.sql.execution.id": F.col("n_regionkey").cast("string"),
                        "spark.sql.execution.root.id": F.col("n_regionkey").cast("string"),
                        "spark.job.description": F.col("n_name"),
                    }
                ),
            },
        ),
        _line(
            jobs.filter(n != 24), F.lit(400 * _BILLION) + n, S.JOB_END,
            **{
                "Job ID": n,
                "Completion Time": F.lit(BASE_MS) + n * 60_000 + 500 + n * 137,
                "Job Result": _struct(
                    Result=F.when(n % 5 == 0, F.lit("JobFailed")).otherwise(F.lit("JobSucceeded"))
                ),
            },
        ),
        _line(
            executions.filter(r != 3), F.lit(1000 * _BILLION) + r, S.SQL_END,
            executionId=r,
            time=F.lit(BASE_MS) + r * 3_600_000 + (r + 1) * 1000,
        ),
        _line(
            executions, F.lit(100 * _BILLION) + r, S.SQL_PLAN,
            executionId=r,
            sparkPlanInfo=_struct(
                nodeName=F.lit("AdaptiveSparkPlan"),
                simpleString=F.lit(S.FINAL_PLAN),
                metrics=F.array(),
                children=F.transform("nations", lambda k: _branch(k, F.col("r_name"))),
            ),
        ),
    ]
    for at, value in ((200 * _BILLION, 1), (300 * _BILLION, 2)):
        lines.append(
            _line(
                executions, F.lit(at) + r, S.SQL_ACCUMS,
                executionId=r,
                accumUpdates=F.array(F.array(r.cast("bigint") * 10 + 4, F.lit(value).cast("bigint"))),
            )
        )

    # --- stages: some never submitted, some submitted after the next job start
    counted = customer.join(
        order.groupBy("log_id", "c").agg(F.count("*").alias("n_orders")), ["log_id", "c"], "left"
    )
    submitted = counted.filter("c % 7 <> 3").withColumn(
        "submit_seq",
        F.when((c % 10 == 0) & (n < 24), n + 1).otherwise(n).cast("bigint") * _BILLION + 1_000_000 + c,
    )
    segment = F.col("c_mktsegment")
    no_scope = F.lit(None).cast("string")

    def rdd(pos: int, name: str, scope: Column) -> Column:
        return _struct(**{"RDD ID": c * 10 + pos, "Name": F.lit(name), "Scope": scope})

    def scope(name: str) -> Column:
        return F.lit(f'{{"id":"7","name":"{name}"}}')

    codegen = rdd(0, "MapPartitionsRDD", scope("WholeStageCodegen (1)"))
    shuffled = rdd(1, "ShuffledRowRDD", scope("Exchange"))
    rdds = (
        F.when(
            segment.isin("BUILDING", "MACHINERY"),
            F.array(codegen, rdd(1, "FileScanRDD", scope("Scan parquet "))),
        )
        .when(
            segment == "HOUSEHOLD",
            F.array(codegen, shuffled, rdd(2, "MapPartitionsRDD", scope("BroadcastExchange"))),
        )
        .when(segment == "AUTOMOBILE", F.array(codegen, shuffled, rdd(2, "ParallelCollectionRDD", no_scope)))
        .otherwise(F.array(codegen, shuffled))
    )
    submission_ms = F.lit(BASE_MS) + c * 1000
    for attempt, rows in ((0, submitted), (1, submitted.filter("c % 50 = 1"))):
        lines.append(
            _line(
                rows, F.col("submit_seq") + attempt * 2_000_000, S.STAGE_SUBMITTED,
                **{
                    "Stage Info": _struct(
                        **{
                            "Stage ID": c,
                            "Stage Attempt ID": F.lit(attempt),
                            "Stage Name": F.col("c_name"),
                            "Number of Tasks": F.coalesce("n_orders", F.lit(0)),
                            "Submission Time": submission_ms,
                            "RDD Info": rdds,
                        }
                    )
                },
            )
        )

    def acc(acc_id: Column, value: Column) -> Column:
        return _struct(ID=acc_id, Value=value.cast("bigint"))

    inner_rows = F.floor((c + 1000) * (c % 100) / 100)
    lines.append(
        _line(
            submitted, F.lit(70 * _BILLION) + c, S.STAGE_COMPLETED,
            **{
                "Stage Info": _struct(
                    **{
                        "Stage ID": c,
                        "Stage Attempt ID": F.lit(0),
                        "Submission Time": submission_ms,
                        "Completion Time": submission_ms + F.floor((F.col("c_acctbal") + 1000) * 3),
                        "Accumulables": F.array(
                            acc(n * 10 + 1, c + 1000),
                            acc(n * 10 + 2, c % 5000),
                            acc(n * 10 + 3, inner_rows),
                            acc(n * 10 + 5, F.floor(inner_rows / 2)),
                            acc(F.lit(999999), c),
                        ),
                    }
                )
            },
        )
    )

    # --- tasks
    launch_ms = F.lit(BASE_MS) + o * 10
    ids = {"Stage ID": c, "Stage Attempt ID": F.lit(0)}
    info = {
        "Task ID": o,
        "Attempt": F.lit(0),
        "Partition ID": o % 200,
        "Executor ID": (o % 16).cast("string"),
        "Host": F.concat(F.lit("host-"), o % 4),
        "Locality": F.col("o_orderpriority"),
        "Speculative": o % 50 == 0,
        "Launch Time": launch_ms,
    }
    lines.append(_line(order, F.lit(50 * _BILLION) + o, S.TASK_START, **ids, **{"Task Info": _struct(**info)}))
    ended = order.filter("o_orderstatus <> 'P'").join(customer.select("log_id", "c", "n"), ["log_id", "c"])
    price = F.col("o_totalprice")
    lines.append(
        _line(
            ended, F.lit(60 * _BILLION) + o, S.TASK_END,
            **ids,
            **{
                "Task Type": F.lit("ResultTask"),
                "Task End Reason": _struct(Reason=F.lit("Success")),
                "Task Info": _struct(
                    **info,
                    **{
                        "Finish Time": launch_ms + F.floor(price / 10),
                        "Accumulables": F.array(
                            _struct(ID=n * 10 + 1, Update=F.lit(1), Value=o, Metadata=F.lit("sql")),
                            _struct(ID=F.lit(7), Update=F.lit(1), Value=o, Metadata=F.lit("other")),
                        ),
                    },
                ),
                "Task Metrics": _struct(
                    **{
                        "Executor Run Time": F.floor(price / 11),
                        "Executor CPU Time": F.floor(price * 1000),
                        "Executor Deserialize Time": o % 7,
                        "JVM GC Time": o % 5,
                        "Memory Bytes Spilled": 2048 * (o % 3),
                        "Disk Bytes Spilled": 1024 * (o % 3),
                        "Input Metrics": _struct(
                            **{"Bytes Read": F.floor(price * 100), "Records Read": o % 1000}
                        ),
                        "Shuffle Read Metrics": _struct(
                            **{
                                "Remote Bytes Read": o % 11,
                                "Local Bytes Read": o % 13,
                                "Total Records Read": o % 17,
                                "Fetch Wait Time": o % 19,
                            }
                        ),
                        "Shuffle Write Metrics": _struct(
                            **{
                                "Shuffle Bytes Written": o % 23,
                                "Shuffle Records Written": o % 29,
                                "Shuffle Write Time": o * 1000,
                            }
                        ),
                    }
                ),
            },
        )
    )

    # --- noise: a blank line and an unknown event per execution
    lines.append(executions.select("log_id", (r - 100).cast("bigint"), F.lit("  ")))
    lines.append(_line(executions, r - 200, "SparkListenerBlockManagerAdded", Timestamp=r))
    return reduce(DataFrame.union, lines)


def _metric(name: str, acc_id: Column) -> Column:
    return _struct(name=F.lit(name), accumulatorId=acc_id, metricType=F.lit("sum"))


def _branch(k: Column, region_name: Column) -> Column:
    """Filter > Project > Filter > ColumnarToRow > Scan of one nation."""
    location = F.concat(
        F.lit("InMemoryFileIndex(1 paths)[file:/lake/"), region_name, F.lit("/part_"), k % 7, F.lit("]")
    )
    rows = "number of output rows"
    scan = _struct(
        nodeName=F.lit("Scan parquet "),
        simpleString=F.lit("FileScan parquet"),
        metadata=_struct(Location=location, Format=F.lit("Parquet")),
        metrics=F.array(_metric(rows, k * 10 + 1), _metric("scan time", k * 10 + 2)),
    )
    node = _struct(nodeName=F.lit("ColumnarToRow"), simpleString=F.lit("ColumnarToRow"), children=F.array(scan))
    for name, acc in (("Filter", 3), ("Project", None), ("Filter", 5)):
        node = _struct(
            nodeName=F.lit(name),
            simpleString=F.lit(name),
            metrics=F.array(_metric(rows, k * 10 + acc)) if acc else F.lit(None).cast("array<string>"),
            children=F.array(node),
        )
    return node


def copies_of(lines: DataFrame, n: int) -> DataFrame:
    """``n`` logs for each log, to see how run time grows."""
    return lines.select(
        "log_id", "seq", "value", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")
    ).select(F.concat_ws("-", "log_id", "copy").alias("log_id"), "seq", "value")
