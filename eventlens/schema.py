"""Names and types of the listener events this library reads."""

from __future__ import annotations

# Event names as Spark writes them.
SQL_START = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionStart"
SQL_END = "org.apache.spark.sql.execution.ui.SparkListenerSQLExecutionEnd"
SQL_PLAN = "org.apache.spark.sql.execution.ui.SparkListenerSQLAdaptiveExecutionUpdate"
SQL_ACCUMS = "org.apache.spark.sql.execution.ui.SparkListenerDriverAccumUpdates"
JOB_START = "SparkListenerJobStart"
JOB_END = "SparkListenerJobEnd"
STAGE_SUBMITTED = "SparkListenerStageSubmitted"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_START = "SparkListenerTaskStart"
TASK_END = "SparkListenerTaskEnd"

KINDS = (
    SQL_START,
    SQL_END,
    SQL_PLAN,
    SQL_ACCUMS,
    JOB_START,
    JOB_END,
    STAGE_SUBMITTED,
    STAGE_COMPLETED,
    TASK_START,
    TASK_END,
)

# Fixed value: the root line of a finished adaptive plan.
FINAL_PLAN = "AdaptiveSparkPlan isFinalPlan=true"

CORRUPT = "_corrupt"

# One union schema for all kinds.  Identifiers are read as text and cast with
# try_cast afterwards, so one bad id cannot null out the array or struct around
# it.  Keys that are not listed are skipped by the JSON reader without being
# materialised (Properties alone often holds hundreds of them).
LINE_SCHEMA = """
  `Event` STRING,
  `executionId` BIGINT,
  `rootExecutionId` BIGINT,
  `description` STRING,
  `time` BIGINT,
  `sparkPlanInfo` STRING,
  `accumUpdates` ARRAY<ARRAY<BIGINT>>,
  `Job ID` STRING,
  `Stage IDs` ARRAY<STRING>,
  `Submission Time` BIGINT,
  `Completion Time` BIGINT,
  `Properties` STRUCT<
    `spark.sql.execution.id`: STRING,
    `spark.sql.execution.root.id`: STRING,
    `spark.job.description`: STRING>,
  `Job Result` STRUCT<`Result`: STRING>,
  `Stage Info` STRUCT<
    `Stage ID`: STRING,
    `Stage Attempt ID`: STRING,
    `Stage Name`: STRING,
    `Number of Tasks`: BIGINT,
    `Submission Time`: BIGINT,
    `Completion Time`: BIGINT,
    `RDD Info`: ARRAY<STRUCT<`RDD ID`: BIGINT, `Name`: STRING, `Scope`: STRING>>,
    `Accumulables`: ARRAY<STRUCT<`ID`: STRING, `Value`: STRING>>>,
  `Stage ID` STRING,
  `Stage Attempt ID` STRING,
  `Task Type` STRING,
  `Task End Reason` STRUCT<`Reason`: STRING>,
  `Task Info` STRUCT<
    `Task ID`: STRING,
    `Attempt`: STRING,
    `Partition ID`: STRING,
    `Executor ID`: STRING,
    `Host`: STRING,
    `Locality`: STRING,
    `Speculative`: BOOLEAN,
    `Launch Time`: BIGINT,
    `Finish Time`: BIGINT,
    `Accumulables`: ARRAY<STRUCT<`ID`: STRING, `Value`: STRING, `Metadata`: STRING>>>,
  `Task Metrics` STRUCT<
    `Executor Run Time`: BIGINT,
    `Executor CPU Time`: BIGINT,
    `Executor Deserialize Time`: BIGINT,
    `JVM GC Time`: BIGINT,
    `Memory Bytes Spilled`: BIGINT,
    `Disk Bytes Spilled`: BIGINT,
    `Input Metrics`: STRUCT<`Bytes Read`: BIGINT, `Records Read`: BIGINT>,
    `Shuffle Read Metrics`: STRUCT<
      `Remote Bytes Read`: BIGINT,
      `Local Bytes Read`: BIGINT,
      `Total Records Read`: BIGINT,
      `Fetch Wait Time`: BIGINT>,
    `Shuffle Write Metrics`: STRUCT<
      `Shuffle Bytes Written`: BIGINT,
      `Shuffle Records Written`: BIGINT,
      `Shuffle Write Time`: BIGINT>>
"""

# Key columns shared by the tables.
STAGE_KEY = ["log_id", "stage_id", "stage_attempt_id"]
TASK_KEY = [*STAGE_KEY, "task_id", "task_attempt_id"]
