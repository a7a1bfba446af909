"""The expected results as SQL over the plain tables, written for DuckDB.

Shares no code with the library: the answers follow from the rules by which
the logs are made, without any event in between.
"""

from __future__ import annotations

import textwrap

# Each entry may use those before it.
_PARTS = {
    "cust": """
        SELECT 'synth-' || CAST(c_custkey // 1000 AS VARCHAR) AS log_id, c_custkey AS c,
               CAST(c_nationkey AS BIGINT) AS n, c_name, c_acctbal, c_mktsegment
        FROM customer""",
    "ord": """
        SELECT 'synth-' || CAST(o_custkey // 1000 AS VARCHAR) AS log_id, o_orderkey AS o,
               o_custkey AS c, o_orderstatus AS status, o_totalprice AS price,
               o_orderpriority AS priority, o_orderstatus <> 'P' AS ended,
               1700000000000 + o_orderkey * 10 AS launch_ms
        FROM orders""",
    "decl": """
        SELECT log_id, n AS job_id, c AS stage_id, n * 1000000000 AS job_seq FROM cust
        UNION ALL
        SELECT log_id, n + 1, c, (n + 1) * 1000000000 FROM cust WHERE c % 5 = 0 AND n < 24""",
    "job": """
        SELECT d.log_id, d.job_id, CAST(n_regionkey AS BIGINT) AS execution_id, n_name,
               1700000000000 + d.job_id * 60000 AS submission_ms,
               CASE WHEN d.job_id <> 24 THEN 500 + 137 * d.job_id END AS duration_ms,
               CASE WHEN d.job_id = 24 THEN NULL WHEN d.job_id % 5 = 0 THEN 'JobFailed'
                    ELSE 'JobSucceeded' END AS result
        FROM (SELECT DISTINCT log_id, job_id FROM decl) d
        JOIN nation ON n_nationkey = d.job_id""",
    "exe": """
        SELECT DISTINCT j.log_id, j.execution_id, r_name
        FROM job j JOIN region ON r_regionkey = j.execution_id""",
    "sub0": """
        SELECT log_id, c AS stage_id,
               (CASE WHEN c % 10 = 0 AND n < 24 THEN n + 1 ELSE n END) * 1000000000
                 + 1000000 + c AS seq
        FROM cust WHERE c % 7 <> 3""",
    "sub": """
        SELECT log_id, stage_id, 0::BIGINT AS stage_attempt_id, seq FROM sub0
        UNION ALL
        SELECT log_id, stage_id, 1, seq + 2000000 FROM sub0 WHERE stage_id % 50 = 1""",
    "mapped": """
        SELECT s.*, d.job_id FROM sub s ASOF JOIN decl d
        ON s.log_id = d.log_id AND s.stage_id = d.stage_id AND s.seq > d.job_seq""",
    "stg": """
        SELECT m.log_id, m.stage_id, m.stage_attempt_id, m.job_id, m.seq AS submit_seq,
               j.execution_id, c_name, c_mktsegment AS segment,
               1700000000000 + m.stage_id * 1000 AS submission_ms,
               CASE WHEN m.stage_attempt_id = 0
                    THEN CAST(floor((c_acctbal + 1000) * 3) AS BIGINT) END AS duration_ms,
               c_mktsegment IN ('BUILDING', 'MACHINERY') AS has_scan_parquet,
               c_mktsegment = 'HOUSEHOLD' AS has_broadcasted_data
        FROM mapped m
        JOIN cust ON cust.c = m.stage_id
        JOIN job j ON j.log_id = m.log_id AND j.job_id = m.job_id""",
    "tsk": """
        SELECT log_id, c AS stage_id, 0::BIGINT AS stage_attempt_id, o AS task_id,
               0::BIGINT AS task_attempt_id, o % 200 AS partition_id, launch_ms, ended,
               priority AS locality,
               CASE WHEN ended THEN CAST(floor(price / 10) AS BIGINT) END AS duration_ms,
               CASE WHEN ended THEN CAST(floor(price * 100) AS BIGINT) END AS input_bytes,
               CASE WHEN ended THEN o % 1000 END AS input_records,
               CASE WHEN ended THEN 1024 * (o % 3) END AS disk_spill_bytes,
               CASE WHEN ended THEN o % 11 + o % 13 END AS shuffle_read_bytes,
               price
        FROM ord""",
    "done": "SELECT * FROM tsk WHERE ended",
    "cnt": """
        SELECT log_id, stage_id, stage_attempt_id, count(*) AS tasks FROM done GROUP BY ALL""",
    "acc": """
        SELECT log_id, c AS stage_id, 0::BIGINT AS stage_attempt_id, u.k AS acc_id, u.v AS value
        FROM (SELECT *, CAST(floor((1000 + c) * (c % 100) / 100) AS BIGINT) AS inner_rows
              FROM cust WHERE c % 7 <> 3),
        LATERAL (SELECT n * 10 + 1 AS k, 1000 + c AS v
                 UNION ALL SELECT n * 10 + 2, c % 5000
                 UNION ALL SELECT n * 10 + 3, inner_rows
                 UNION ALL SELECT n * 10 + 5, inner_rows // 2
                 UNION ALL SELECT 999999, c) u""",
    "branch": """
        SELECT e.log_id, e.execution_id, j.job_id AS n, r_name,
               '0.' || CAST(row_number() OVER (PARTITION BY j.log_id, j.execution_id
                                               ORDER BY j.job_id) - 1 AS VARCHAR) AS top
        FROM exe e JOIN job j ON j.log_id = e.log_id AND j.execution_id = e.execution_id""",
    "nodes": """
        SELECT log_id, execution_id, '0' AS node_path, 'AdaptiveSparkPlan' AS node_name,
               'AdaptiveSparkPlan isFinalPlan=true' AS simple_string, NULL AS location,
               '' AS file_name, '' AS schema_name FROM exe
        UNION ALL
        SELECT log_id, execution_id, top || t.below, t.name, t.name, NULL, '', '' FROM branch,
          (VALUES ('', 'Filter'), ('.0', 'Project'), ('.0.0', 'Filter'),
                  ('.0.0.0', 'ColumnarToRow')) t(below, name)
        UNION ALL
        SELECT log_id, execution_id, top || '.0.0.0.0', 'Scan parquet ', 'FileScan parquet',
               'InMemoryFileIndex(1 paths)[file:/lake/' || r_name || '/part_' || CAST(n % 7 AS VARCHAR)
                 || ']',
               'part_' || CAST(n % 7 AS VARCHAR), r_name FROM branch""",
    "pm": """
        SELECT log_id, n * 10 + t.k AS acc_id, execution_id, t.node AS node_name,
               top || t.below AS node_path, t.metric AS metric_name, 'sum' AS metric_type,
               CASE WHEN t.k <= 2 THEN 'part_' || CAST(n % 7 AS VARCHAR) ELSE '' END AS file_name,
               CASE WHEN t.k <= 2 THEN r_name ELSE '' END AS schema_name
        FROM branch, (VALUES (1, 'Scan parquet ', '.0.0.0.0', 'number of output rows'),
                             (2, 'Scan parquet ', '.0.0.0.0', 'scan time'),
                             (3, 'Filter', '.0.0', 'number of output rows'),
                             (5, 'Filter', '', 'number of output rows')) t(k, node, below, metric)""",
    "spm": """
        SELECT a.log_id, a.stage_id, a.stage_attempt_id, a.acc_id, a.value, p.node_name,
               p.node_path, p.metric_name, p.file_name, p.schema_name
        FROM acc a JOIN pm p ON p.log_id = a.log_id AND p.acc_id = a.acc_id""",
    "sel0": """
        SELECT log_id, stage_id, stage_attempt_id,
               max(CASE WHEN acc_id % 10 = 1 THEN value END) AS scan_rows,
               max(CASE WHEN acc_id % 10 = 2 THEN value END) AS scan_time_ms,
               max(CASE WHEN acc_id % 10 = 1 THEN file_name END) AS file_name,
               max(CASE WHEN acc_id % 10 = 5 THEN value END) AS outer_rows,
               max(CASE WHEN acc_id % 10 = 3 THEN value END) AS inner_rows
        FROM spm GROUP BY ALL""",
    "sel": """
        SELECT log_id, stage_id, stage_attempt_id, scan_rows, scan_time_ms, file_name,
               outer_rows AS filter_rows, scan_rows - outer_rows AS filtered_out_rows,
               CASE WHEN scan_rows - outer_rows > 0
                    THEN 100 - (scan_rows - outer_rows)::DOUBLE / scan_rows * 100
                    ELSE 0 END AS filtered_pct_ref,
               outer_rows::DOUBLE / scan_rows * 100 AS retained_pct,
               (scan_rows - outer_rows)::DOUBLE / scan_rows * 100 AS filtered_out_pct
        FROM sel0""",
    "skip": """
        SELECT d.log_id, d.job_id, count(*) AS skipped_stages FROM decl d
        WHERE NOT EXISTS (SELECT 1 FROM mapped m WHERE m.log_id = d.log_id
                          AND m.job_id = d.job_id AND m.stage_id = d.stage_id)
        GROUP BY ALL""",
    "js": """
        SELECT j.log_id, j.execution_id, j.job_id, coalesce(a.stages, 0) AS stages,
               j.duration_ms, j.result, coalesce(k.skipped_stages, 0) AS skipped_stages
        FROM job j
        LEFT JOIN (SELECT log_id, job_id, count(*) AS stages FROM mapped GROUP BY ALL) a
          ON a.log_id = j.log_id AND a.job_id = j.job_id
        LEFT JOIN skip k ON k.log_id = j.log_id AND k.job_id = j.job_id""",
    "ss": """
        SELECT s.log_id, s.job_id, s.stage_id, s.stage_attempt_id, coalesce(cnt.tasks, 0) AS tasks,
               s.duration_ms, s.has_scan_parquet, s.has_broadcasted_data,
               sel.* EXCLUDE (log_id, stage_id, stage_attempt_id)
        FROM stg s
        LEFT JOIN cnt ON cnt.log_id = s.log_id AND cnt.stage_id = s.stage_id
                      AND cnt.stage_attempt_id = s.stage_attempt_id
        LEFT JOIN sel ON sel.log_id = s.log_id AND sel.stage_id = s.stage_id
                      AND sel.stage_attempt_id = s.stage_attempt_id""",
    "top_stages": """
        SELECT s.log_id, s.execution_id, s.rank, s.stage_id, s.stage_attempt_id, s.duration_ms,
               coalesce(cnt.tasks, 0) AS tasks, s.has_scan_parquet, s.has_broadcasted_data
        FROM (SELECT *, CAST(row_number() OVER (
                PARTITION BY log_id, execution_id
                ORDER BY coalesce(nullif(duration_ms, 0), -1) DESC, job_id, submit_seq)
                AS INTEGER) AS rank FROM stg) s
        LEFT JOIN cnt ON cnt.log_id = s.log_id AND cnt.stage_id = s.stage_id
                      AND cnt.stage_attempt_id = s.stage_attempt_id
        WHERE s.rank <= 5""",
    "top_tasks": """
        SELECT * FROM (
          SELECT t.log_id, s.execution_id,
                 CAST(row_number() OVER (
                   PARTITION BY t.log_id, s.execution_id
                   ORDER BY coalesce(nullif(t.duration_ms, 0), -1) DESC, t.stage_id,
                            t.stage_attempt_id, t.task_id, t.task_attempt_id) AS INTEGER) AS rank,
                 t.task_id, t.task_attempt_id, t.stage_id, t.stage_attempt_id, t.duration_ms,
                 t.partition_id, t.locality, t.input_bytes, t.disk_spill_bytes
          FROM done t JOIN stg s ON s.log_id = t.log_id AND s.stage_id = t.stage_id
                                 AND s.stage_attempt_id = t.stage_attempt_id)
        WHERE rank <= 10""",
    "skew": """
        SELECT s.log_id, s.execution_id, s.job_id, s.stage_id, s.stage_attempt_id, g.tasks,
               g.median_ms, g.max_ms, t.task_id, t.task_attempt_id, t.partition_id
        FROM (SELECT log_id, stage_id, stage_attempt_id, count(*) AS tasks,
                     list_sort(list(duration_ms))[count(*) // 2 + 1] AS median_ms,
                     max(duration_ms) AS max_ms
              FROM done GROUP BY ALL) g
        JOIN stg s ON s.log_id = g.log_id AND s.stage_id = g.stage_id
                   AND s.stage_attempt_id = g.stage_attempt_id
        JOIN (SELECT *, row_number() OVER (
                PARTITION BY log_id, stage_id, stage_attempt_id
                ORDER BY duration_ms DESC, task_id) AS place FROM done) t
          ON t.log_id = g.log_id AND t.stage_id = g.stage_id
         AND t.stage_attempt_id = g.stage_attempt_id AND t.place = 1
        WHERE g.tasks >= 4 AND g.median_ms >= 0 AND g.max_ms > 3.0 * g.median_ms""",
    "files": """
        SELECT log_id, execution_id, rank, file_name, total_duration_ms FROM (
          SELECT *, CAST(row_number() OVER (
                   PARTITION BY log_id, execution_id
                   ORDER BY total_duration_ms DESC, first_job, first_seq) AS INTEGER) AS rank
          FROM (SELECT s.log_id, s.execution_id, sel0.file_name,
                       CAST(sum(s.duration_ms) AS BIGINT) AS total_duration_ms,
                       min(s.job_id) AS first_job, arg_min(s.submit_seq, (s.job_id, s.submit_seq))
                         AS first_seq
                FROM stg s JOIN sel0 ON sel0.log_id = s.log_id AND sel0.stage_id = s.stage_id
                                     AND sel0.stage_attempt_id = s.stage_attempt_id
                GROUP BY s.log_id, s.execution_id, sel0.file_name))
        WHERE rank <= 5""",
    "scopes": """
        SELECT s.log_id, s.stage_id, s.stage_attempt_id, u.scope_name, u.rdd_name, u.pos
        FROM stg s JOIN (VALUES
          ('BUILDING', 0, 'MapPartitionsRDD', 'WholeStageCodegen (1)'),
          ('BUILDING', 1, 'FileScanRDD', 'Scan parquet'),
          ('MACHINERY', 0, 'MapPartitionsRDD', 'WholeStageCodegen (1)'),
          ('MACHINERY', 1, 'FileScanRDD', 'Scan parquet'),
          ('HOUSEHOLD', 0, 'MapPartitionsRDD', 'WholeStageCodegen (1)'),
          ('HOUSEHOLD', 1, 'ShuffledRowRDD', 'Exchange'),
          ('HOUSEHOLD', 2, 'MapPartitionsRDD', 'BroadcastExchange'),
          ('AUTOMOBILE', 0, 'MapPartitionsRDD', 'WholeStageCodegen (1)'),
          ('AUTOMOBILE', 1, 'ShuffledRowRDD', 'Exchange'),
          ('AUTOMOBILE', 2, 'ParallelCollectionRDD', NULL),
          ('OTHER', 0, 'MapPartitionsRDD', 'WholeStageCodegen (1)'),
          ('OTHER', 1, 'ShuffledRowRDD', 'Exchange')) u(segment, pos, rdd_name, scope_name)
          ON u.segment = CASE WHEN s.segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD', 'AUTOMOBILE')
                              THEN s.segment ELSE 'OTHER' END""",
}


def _sql(query: str) -> str:
    """The query with all parts as common table expressions; unused ones cost nothing."""
    parts = ",\n".join(f"{name} AS ({textwrap.dedent(sql)})" for name, sql in _PARTS.items())
    return f"WITH {parts}\n{textwrap.dedent(query)}"


def _seconds(ms: str) -> str:
    return f"floor(({ms} + 50) / 100) / 10"


def _text(seconds: str, digits: int = 1) -> str:
    number = f"CAST(CAST({seconds} AS DECIMAL(24,{digits})) AS VARCHAR)"
    if digits == 2:
        number = f"CASE WHEN {number} LIKE '%.%0' THEN left({number}, -1) ELSE {number} END"
    return f"CASE WHEN {seconds} IS NULL THEN 'n/a' WHEN {seconds} < 1 THEN '<1 s' ELSE {number} || ' s' END"


def _kb(n_bytes: str) -> str:
    kb = f"round_even({n_bytes} / 1024.0::DOUBLE, 1)"
    return f"coalesce(CAST(CAST({kb} AS DECIMAL(24,1)) AS VARCHAR), 'n/a')"


_SPACED = "coalesce(replace(format('{{:,}}', {0}), ',', ' '), 'n/a')"
_CPU = "CASE WHEN ended THEN CAST(floor(price * 1000) AS BIGINT) END"
_CPU_S = f"floor(({_CPU} * 100 + 5000000) / 10000000) / 100"
_TASK_KEY = "log_id, stage_id, stage_attempt_id, task_id, task_attempt_id"

_QUERIES = {
    "read_events": """
        SELECT log_id, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT log_id, 2 * count(*) AS n FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 5 * count(*) FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM exe WHERE execution_id <> 3 GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM job GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM job WHERE job_id <> 24 GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM sub GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM sub0 GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM tsk GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM done GROUP BY ALL) GROUP BY log_id""",
    "read_events_same_name": """
        SELECT part || '/' || log_id AS log_id, n FROM (
          SELECT log_id, CAST(sum(n) AS BIGINT) AS n FROM (
            SELECT log_id, 7 * count(*) AS n FROM exe GROUP BY ALL
            UNION ALL SELECT log_id, count(*) FROM exe WHERE execution_id <> 3 GROUP BY ALL
            UNION ALL SELECT log_id, count(*) FROM job GROUP BY ALL
            UNION ALL SELECT log_id, count(*) FROM job WHERE job_id <> 24 GROUP BY ALL
            UNION ALL SELECT log_id, count(*) FROM sub GROUP BY ALL
            UNION ALL SELECT log_id, count(*) FROM sub0 GROUP BY ALL
            UNION ALL SELECT log_id, count(*) FROM tsk GROUP BY ALL
            UNION ALL SELECT log_id, count(*) FROM done GROUP BY ALL) GROUP BY log_id),
        (VALUES ('first'), ('second')) v(part)""",
    "read_events_order": "SELECT log_id, stage_id, stage_attempt_id, job_id FROM mapped",
    "skip_blank": """
        SELECT log_id, CAST(sum(n) AS BIGINT) AS n FROM (
          SELECT log_id, 6 * count(*) AS n FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM exe WHERE execution_id <> 3 GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM job GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM job WHERE job_id <> 24 GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM sub GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM sub0 GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM tsk GROUP BY ALL
          UNION ALL SELECT log_id, count(*) FROM done GROUP BY ALL) GROUP BY log_id""",
    "parse_events": """
        SELECT log_id, 60000000000 + task_id AS seq, stage_id, task_id, launch_ms,
               launch_ms + duration_ms AS finish_ms FROM done""",
    "parse_events_all_kinds": """
        SELECT log_id, CASE WHEN event LIKE 'SparkListenerSQL%' OR event LIKE '%DriverAccum%'
                            THEN 'org.apache.spark.sql.execution.ui.' ELSE '' END || event AS event,
               CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS ids
        FROM (
          SELECT log_id, 'SparkListenerSQLExecutionStart' AS event, execution_id AS id FROM exe
          UNION ALL SELECT log_id, 'SparkListenerSQLAdaptiveExecutionUpdate', execution_id
                    FROM exe, range(2)
          UNION ALL SELECT log_id, 'SparkListenerDriverAccumUpdates', execution_id FROM exe, range(2)
          UNION ALL SELECT log_id, 'SparkListenerSQLExecutionEnd', execution_id FROM exe
                    WHERE execution_id <> 3
          UNION ALL SELECT log_id, 'SparkListenerJobStart', job_id FROM job
          UNION ALL SELECT log_id, 'SparkListenerJobEnd', job_id FROM job WHERE job_id <> 24
          UNION ALL SELECT log_id, 'SparkListenerStageSubmitted', stage_id FROM sub
          UNION ALL SELECT log_id, 'SparkListenerStageCompleted', stage_id FROM sub0
          UNION ALL SELECT log_id, 'SparkListenerTaskStart', task_id FROM tsk
          UNION ALL SELECT log_id, 'SparkListenerTaskEnd', task_id FROM done) GROUP BY ALL""",
    "route_events": """
        SELECT log_id, CASE WHEN event LIKE 'SparkListenerSQL%' OR event LIKE '%DriverAccum%'
                            THEN 'org.apache.spark.sql.execution.ui.' ELSE '' END || event AS event, n
        FROM (
          SELECT log_id, 'SparkListenerSQLExecutionStart' AS event, count(*) AS n FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerSQLAdaptiveExecutionUpdate', 2 * count(*)
                    FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerDriverAccumUpdates', 2 * count(*) FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerBlockManagerAdded', count(*) FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerSQLExecutionEnd', count(*) FROM exe
                    WHERE execution_id <> 3 GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerJobStart', count(*) FROM job GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerJobEnd', count(*) FROM job WHERE job_id <> 24
                    GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerStageSubmitted', count(*) FROM sub GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerStageCompleted', count(*) FROM sub0 GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerTaskStart', count(*) FROM tsk GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerTaskEnd', count(*) FROM done GROUP BY ALL)""",
    "read_events_added": """
        SELECT log_id, CASE WHEN event LIKE 'SparkListenerSQL%' OR event LIKE '%DriverAccum%'
                            THEN 'org.apache.spark.sql.execution.ui.' ELSE '' END || event AS event, n
        FROM (
          SELECT log_id, 'SparkListenerSQLExecutionStart' AS event, count(*) AS n FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerSQLAdaptiveExecutionUpdate', 2 * count(*)
                    FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerDriverAccumUpdates', 2 * count(*) FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerBlockManagerAdded', count(*) FROM exe GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerSQLExecutionEnd', count(*) FROM exe
                    WHERE execution_id <> 3 GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerJobStart', count(*) FROM job GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerJobEnd', count(*) FROM job WHERE job_id <> 24
                    GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerStageSubmitted', count(*) FROM sub GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerStageCompleted', count(*) FROM sub0 GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerTaskStart', count(*) FROM tsk GROUP BY ALL
          UNION ALL SELECT log_id, 'SparkListenerTaskEnd', count(*) FROM done GROUP BY ALL)""",
    "bad_lines": """
        SELECT log_id, 50000000000 + task_id AS seq,
               '{"Event":"SparkListenerTaskStart","Stage' AS value
        FROM tsk WHERE (50000000000 + task_id) % 97 = 13""",
    "executions": """
        SELECT *, start_ms / 1000.0::DOUBLE AS epoch_start_time,
               strftime(make_timestamp(start_ms * 1000), '%d-%m-%Y %H:%M:%S') AS start_time,
               end_ms / 1000.0::DOUBLE AS epoch_end_time,
               strftime(make_timestamp(end_ms * 1000), '%d-%m-%Y %H:%M:%S') AS end_time
        FROM (SELECT log_id, execution_id, execution_id AS root_execution_id,
                     CASE WHEN execution_id <> 4 THEN 's' || CAST(execution_id AS VARCHAR) END
                       AS statement_id,
                     CASE WHEN execution_id = 4 THEN 'run s4: '
                          ELSE 'run statement s' || CAST(execution_id AS VARCHAR) || ': ' END
                       || r_name || CASE WHEN execution_id % 2 = 0 THEN ' write.mode=overwrite'
                                         ELSE '' END AS description,
                     execution_id % 2 = 0 AS has_write_op,
                     1700000000000 + execution_id * 3600000 AS start_ms,
                     CASE WHEN execution_id <> 3 THEN 1700000000000 + execution_id * 3600000
                          + 1000 * (execution_id + 1) END AS end_ms
              FROM exe)""",
    "statement_id": """
        SELECT log_id, execution_id, CASE WHEN execution_id <> 4
               THEN 's' || CAST(execution_id AS VARCHAR) END AS statement_id FROM exe""",
    "write_flag": "SELECT log_id, execution_id, execution_id % 2 = 0 AS has_write_op FROM exe",
    "epoch_utc": """
        SELECT log_id, task_id, launch_ms / 1000.0::DOUBLE AS launch_s,
               strftime(make_timestamp(launch_ms * 1000), '%d-%m-%Y %H:%M:%S') AS launch_text
        FROM tsk""",
    "driver_accums": """
        SELECT log_id, execution_id, execution_id * 10 + 4 AS acc_id, 2::BIGINT AS value FROM exe""",
    "jobs": """
        SELECT j.log_id, j.job_id, j.execution_id, j.execution_id AS root_execution_id, d.stage_ids,
               j.submission_ms, j.n_name AS description,
               j.submission_ms + j.duration_ms AS completion_ms, j.result, j.duration_ms,
               j.job_id * 1000000000 AS start_seq
        FROM job j JOIN (SELECT log_id, job_id,
                                string_agg(CAST(stage_id AS VARCHAR), '|' ORDER BY stage_id) AS stage_ids
                         FROM decl GROUP BY ALL) d
          ON d.log_id = j.log_id AND d.job_id = j.job_id""",
    "job_stages": "SELECT log_id, job_id, stage_id, job_seq FROM decl",
    "stages": """
        SELECT s.log_id, s.stage_id, s.stage_attempt_id, s.c_name AS stage_name,
               CASE WHEN s.stage_attempt_id = 0 OR s.stage_attempt_id = 1
                    THEN coalesce(o.n, 0) END AS num_tasks_planned,
               s.submission_ms, s.submission_ms + s.duration_ms AS completion_ms, s.duration_ms,
               g.scope_names, g.rdd_ids,
               CAST(g.num_files_scanned AS INTEGER) AS num_files_scanned,
               s.has_scan_parquet, s.has_broadcasted_data, true AS has_whole_stage_codegen,
               s.job_id, s.submit_seq
        FROM stg s
        LEFT JOIN (SELECT c, count(*) AS n FROM ord GROUP BY c) o ON o.c = s.stage_id
        JOIN (SELECT log_id, stage_id, stage_attempt_id,
                     string_agg(DISTINCT scope_name, '|' ORDER BY scope_name) AS scope_names,
                     string_agg(CAST(stage_id * 10 + pos AS VARCHAR), '|' ORDER BY pos) AS rdd_ids,
                     count(*) FILTER (rdd_name = 'FileScanRDD') AS num_files_scanned
              FROM scopes GROUP BY ALL) g
          ON g.log_id = s.log_id AND g.stage_id = s.stage_id
         AND g.stage_attempt_id = s.stage_attempt_id""",
    "stage_job_asof": """
        SELECT log_id, stage_id, stage_attempt_id, seq AS submit_seq, job_id FROM mapped""",
    "stage_rdd_types": """
        SELECT log_id, stage_id, stage_attempt_id, rdd_name, count(*) AS n FROM scopes GROUP BY ALL""",
    "stage_scopes": """
        SELECT DISTINCT log_id, stage_id, stage_attempt_id, scope_name FROM scopes
        WHERE scope_name IS NOT NULL""",
    "stage_flags": """
        SELECT log_id, stage_id, stage_attempt_id, has_scan_parquet, has_broadcasted_data,
               true AS has_whole_stage_codegen FROM stg""",
    "stage_accumulables": """
        SELECT log_id, stage_id, stage_attempt_id, acc_id, CAST(value AS VARCHAR) AS value FROM acc""",
    "plan_nodes": "SELECT * FROM nodes",
    "plan_nodes_initial": """
        SELECT log_id, execution_id, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY ALL""",
    "final_plan": "SELECT log_id, execution_id, 100000000000 + execution_id AS seq FROM exe",
    "scan_location": """
        SELECT log_id, execution_id, node_path, schema_name, file_name FROM nodes
        WHERE file_name <> ''""",
    "plan_metrics": "SELECT * FROM pm",
    "tasks": f"""
        SELECT {_TASK_KEY}, partition_id, CAST(task_id % 16 AS VARCHAR) AS executor_id,
               'host-' || CAST(task_id % 4 AS VARCHAR) AS host, locality,
               task_id % 50 = 0 AS speculative, launch_ms, launch_ms + duration_ms AS finish_ms,
               CASE WHEN ended THEN 'ResultTask' END AS task_type,
               CASE WHEN ended THEN 'Success' END AS task_end_reason, duration_ms, ended
        FROM tsk""",
    "task_metrics": f"""
        SELECT {_TASK_KEY}, CAST(floor(price / 11) AS BIGINT) AS exec_run_ms,
               CAST(floor(price * 1000) AS BIGINT) AS exec_cpu_ns, task_id % 7 AS deserialize_ms,
               task_id % 5 AS gc_ms, 2048 * (task_id % 3) AS mem_spill_bytes, disk_spill_bytes,
               input_bytes, input_records, shuffle_read_bytes, task_id % 17 AS shuffle_read_records,
               task_id % 19 AS shuffle_fetch_wait_ms, task_id % 23 AS shuffle_write_bytes,
               task_id % 29 AS shuffle_write_records, task_id * 1000 AS shuffle_write_time_ns
        FROM done""",
    "task_sql_accums": """
        SELECT d.log_id, d.stage_id, d.stage_attempt_id, d.task_id, d.task_attempt_id,
               cust.n * 10 + 1 AS acc_id, CAST(d.task_id AS VARCHAR) AS value
        FROM done d JOIN cust ON cust.c = d.stage_id""",
    "stage_plan_metrics": "SELECT * REPLACE (CAST(value AS VARCHAR) AS value) FROM spm",
    "post_scan_filter": """
        SELECT log_id, stage_id, stage_attempt_id, acc_id, node_path, 'post_scan' AS filter_role
        FROM spm WHERE acc_id % 10 = 3""",
    "is_ancestor": """
        SELECT log_id, execution_id, node_path,
               node_path = '0.1' OR node_path LIKE '0.1.%' AS below_0_1 FROM nodes""",
    "execution_jobs": "SELECT log_id, execution_id, job_id, submission_ms FROM job",
    "job_stage_list": """
        SELECT job_id, log_id, stage_id, stage_attempt_id, seq AS submit_seq FROM mapped""",
    "stage_tasks": f"SELECT {_TASK_KEY}, duration_ms FROM done",
    "skipped_stages": "SELECT log_id, job_id, skipped_stages FROM skip",
    "write_executions": "SELECT log_id, execution_id FROM exe WHERE execution_id % 2 = 0",
    "slowest_stages": "SELECT * FROM top_stages",
    "slowest_tasks": "SELECT * FROM top_tasks",
    "skew_suspects": "SELECT * FROM skew",
    "slowest_files": "SELECT * FROM files",
    "stage_task_counts": "SELECT * FROM cnt",
    "scan_selectivity": "SELECT * FROM sel",
    "scan_selectivity_prefix": "SELECT * FROM sel",
    "scan_selectivity_post_scan": """
        SELECT log_id, stage_id, stage_attempt_id, scan_rows, scan_time_ms, file_name,
               inner_rows AS filter_rows, scan_rows - inner_rows AS filtered_out_rows,
               CASE WHEN scan_rows - inner_rows > 0
                    THEN 100 - (scan_rows - inner_rows)::DOUBLE / scan_rows * 100
                    ELSE 0 END AS filtered_pct_ref,
               inner_rows::DOUBLE / scan_rows * 100 AS retained_pct,
               (scan_rows - inner_rows)::DOUBLE / scan_rows * 100 AS filtered_out_pct
        FROM sel0""",
    "task_breakdown": f"""
        SELECT {_TASK_KEY}, partition_id, duration_ms, locality, input_records, input_bytes,
               shuffle_read_bytes, disk_spill_bytes FROM done""",
    "stage_summary": "SELECT * FROM ss",
    "job_summary": "SELECT * FROM js",
    "execution_overview": """
        SELECT 'slowest_stages' AS block, log_id, execution_id, stage_id, stage_attempt_id, rank,
               NULL::BIGINT AS task_id, duration_ms FROM top_stages
        UNION ALL
        SELECT 'slowest_tasks', log_id, execution_id, stage_id, stage_attempt_id, rank, task_id,
               duration_ms FROM top_tasks
        UNION ALL
        SELECT 'skew_suspects', log_id, execution_id, stage_id, stage_attempt_id, NULL, task_id,
               max_ms FROM skew""",
    "trace_execution": """
        SELECT js.log_id, js.job_id, js.execution_id, js.stages, js.duration_ms AS job_duration_ms,
               js.result, js.skipped_stages, ss.stage_id, ss.stage_attempt_id, ss.tasks,
               ss.duration_ms AS stage_duration_ms,
               ss.* EXCLUDE (log_id, job_id, stage_id, stage_attempt_id, tasks, duration_ms)
        FROM js LEFT JOIN ss ON ss.log_id = js.log_id AND ss.job_id = js.job_id""",

    "trace_one_execution": """
        SELECT js.log_id, js.job_id, js.execution_id, js.stages, js.duration_ms AS job_duration_ms,
               js.result, js.skipped_stages, ss.stage_id, ss.stage_attempt_id, ss.tasks,
               ss.duration_ms AS stage_duration_ms,
               ss.* EXCLUDE (log_id, job_id, stage_id, stage_attempt_id, tasks, duration_ms)
        FROM js LEFT JOIN ss ON ss.log_id = js.log_id AND ss.job_id = js.job_id
        WHERE js.log_id = 'synth-0' AND js.execution_id = 0""",    "trace_execution_tasks": """
        SELECT j.log_id, j.execution_id, j.job_id, s.stage_id, s.stage_attempt_id,
               s.duration_ms AS stage_duration_ms, d.task_id, d.task_attempt_id, d.duration_ms,
               d.locality, d.input_records, d.input_bytes, d.shuffle_read_bytes, d.disk_spill_bytes
        FROM job j
        LEFT JOIN stg s ON s.log_id = j.log_id AND s.job_id = j.job_id
        LEFT JOIN done d ON d.log_id = s.log_id AND d.stage_id = s.stage_id
                         AND d.stage_attempt_id = s.stage_attempt_id""",
    "to_int": """
        SELECT log_id, task_id, task_id % 16 AS padded, NULL::BIGINT AS fraction_text,
               input_bytes // 1000 AS fraction, NULL::BIGINT AS word FROM tsk""",
    "int_or_zero": """
        SELECT log_id, task_id, task_id % 16 AS number, 0::BIGINT AS word,
               coalesce(launch_ms + duration_ms, 0) AS missing FROM tsk""",
    "duration_seconds": f"""
        SELECT log_id, task_id, {_seconds('duration_ms')} AS seconds,
               floor(({_CPU} + 5000000) / 10000000) / 100 AS cpu_seconds,
               NULL::DOUBLE AS unknown_unit FROM tsk""",
    "duration_text": f"""
        SELECT log_id, task_id, {_text('(duration_ms / 10.0::DOUBLE)')} AS tenths,
               {_text('(launch_ms / 10.0::DOUBLE)')} AS large FROM tsk""",
    "fmt_seconds": f"""
        SELECT log_id, task_id, {_text(f"({_seconds('duration_ms')})")} AS duration,
               {_text(f'({_CPU_S})', 2)} AS cpu FROM tsk""",
    "kb_text": f"""
        SELECT log_id, task_id, {_kb('input_bytes')} AS input_kb,
               {_kb('(input_bytes * 1000)')} AS large_kb FROM tsk""",
    "metric_value_text": f"""
        SELECT log_id, stage_id, stage_attempt_id, acc_id,
               CASE WHEN metric_name = 'scan time' THEN {_text(f"({_seconds('value')})")}
                    ELSE CAST(value AS VARCHAR) END AS text FROM spm""",
    "path_key": """
        SELECT log_id, execution_id, node_path,
               CAST(len(string_split(node_path, '.')) AS INTEGER) AS depth,
               CAST(string_split(node_path, '.')[-1] AS INTEGER) AS last_part,
               replace(node_path, '.', '/') AS key_text FROM nodes""",
    "order_by_path": """
        SELECT log_id, execution_id, acc_id, node_path,
               row_number() OVER (PARTITION BY log_id, execution_id
                 ORDER BY CAST(string_split(node_path, '.') AS INT[]), acc_id) AS position
        FROM pm""",
    "thousands_text": f"""
        SELECT log_id, task_id, {_SPACED.format('input_bytes')} AS bytes_text,
               {_SPACED.format('task_id')} AS id_text FROM tsk""",
}


def all_oracles() -> dict[str, str]:
    return {name: _sql(query) for name, query in _QUERIES.items()}
