"""Edge cases on hand-written logs, with the expected rows by hand."""

import json

import pytest
from conftest import rows
from events import *  # noqa: F403

from eventlens import reports as R


def test_lines(facts_of):
    facts = facts_of(["", "  \t", "not json", '{"Event": "Other"}', '{"x": 1}', exec_start(1), '{"Event":"SparkListenerTask'])
    assert rows(facts.bad_lines, "value") == [("not json",), ('{"Event":"SparkListenerTask',)]
    assert facts.events.count() == 1
    assert rows(facts.event_counts, "event", "n") == [
        ("Other", 1), (SQL + "SparkListenerSQLExecutionStart", 1), (None, 1),
    ]


def test_event_key_not_first(facts_of):
    line = json.dumps(dict(reversed(exec_start(3).items())), indent=None)
    assert not line.startswith('{"Event"')
    assert rows(facts_of([line]).executions, "execution_id") == [(3,)]


def test_only_full_event_names_match(facts_of):
    e = {**exec_start(1), "Event": "SparkListenerSQLExecutionStart"}
    assert facts_of([e]).executions.count() == 0


def test_strict_raises(facts_of):
    facts = facts_of([exec_start(1), "oops"], strict=True)
    with pytest.raises(Exception, match="malformed event line in log app"):
        facts.executions.collect()
    assert facts_of([exec_start(1), ""], strict=True).executions.count() == 1


def test_executions(facts_of):
    facts = facts_of([
        exec_start(1, "run statement ab: c: d write.mode=x"),
        exec_start(2, None),
        exec_start(3, "statement whole rest", time=None),
        exec_end(4),
        exec_start(5, "first"), exec_start(5, "statement two:"), exec_end(5, 1_700_000_002_500),
    ])
    assert rows(facts.executions, "execution_id", "statement_id", "has_write_op", "start_time", "epoch_end_time") == [
        (1, "ab", True, "14-11-2023 22:13:20", None),
        (2, None, False, "14-11-2023 22:13:20", None),
        (3, "whole rest", False, None, None),
        (4, None, None, None, 1_700_000_001.0),
        (5, "two", False, "14-11-2023 22:13:20", 1_700_000_002.5),
    ]
    assert rows(R.write_executions(facts), "execution_id") == [(1,)]


def test_last_start_wins_with_its_nulls(facts_of):
    second = exec_start(1, "second")
    del second["rootExecutionId"]
    facts = facts_of([exec_start(1, "first"), second])
    assert rows(facts.executions, "description", "root_execution_id") == [("second", None)]


def test_jobs(facts_of):
    facts = facts_of([
        job_start(1, [1, "x", "3"], execution=7, **{"spark.job.description": "d" * 300}),
        job_end(1, 1500),
        job_end(2),
        job_start(3, [], execution=None, submitted=None), job_end(3),
        {**job_start(4, [9]), "Properties": {"spark.sql.execution.id": "no"}},
        {"Event": "SparkListenerJobEnd", "Job ID": 4, "Completion Time": 9},
    ])
    assert rows(facts.jobs, "job_id", "execution_id", "duration_ms", "result") == [
        (1, 7, 500, "JobSucceeded"),
        (2, None, None, "JobSucceeded"),
        (3, None, None, "JobSucceeded"),
        (4, None, -991, None),
    ]
    assert rows(facts.job_stages, "job_id", "stage_id") == [(1, 1), (1, 3), (4, 9)]
    assert [len(d) for (d,) in rows(facts.jobs.filter("job_id = 1"), "description")] == [200]
    assert rows(R.execution_jobs(facts), "job_id") == [(1,)]


def test_job_end_before_start(facts_of):
    facts = facts_of([job_end(1, 1500), job_start(1, [])])
    assert rows(facts.jobs, "duration_ms") == [(500,)]


def test_stage_to_job(facts_of):
    facts = facts_of([
        submitted(1),                      # before any job: ignored
        job_start(1, [1, 2, 3]), submitted(1, attempt=1),
        submitted(2),
        job_start(2, [2, 3]), submitted(3),
        completed(3), completed(8), completed(1, 0),
    ])
    assert rows(facts.stages, "stage_id", "stage_attempt_id", "job_id", "duration_ms", "stage_name") == [
        (1, 0, None, 2000, None),
        (1, 1, 1, None, "stage 1"),
        (2, 0, 1, None, "stage 2"),
        (3, 0, 2, 2000, "stage 3"),
        (8, 0, None, 2000, None),
    ]
    assert rows(R.skipped_stages(facts), "job_id", "skipped_stages") == [(1, 1), (2, 1)]
    assert rows(R.job_summary(facts), "job_id", "stages", "skipped_stages") == [(1, 2, 1), (2, 1, 1)]
    assert rows(R.stage_summary(facts), "stage_id") == [(1,), (2,), (3,)]


def test_stage_times(facts_of):
    facts = facts_of([
        job_start(1, [1, 2]), submitted(1, time=None), submitted(2, time=700),
        completed(1, start=900, end=1000), completed(2, start=None, end=1000),
    ])
    assert rows(facts.stages, "stage_id", "submission_ms", "completion_ms", "duration_ms") == [
        (1, 900, 1000, 100), (2, 700, 1000, None),
    ]


def test_scopes_and_rdds(facts_of):
    rdds = [
        {"RDD ID": 5, "Name": "FileScanRDD", "Scope": '{"id":"1","name":"Scan parquet "}'},
        {"RDD ID": 4, "Name": "FileScanRDD", "Scope": '{"id":"2","name":"a: b"}'},
        {"RDD ID": 3, "Name": "Other", "Scope": ""},
        {"RDD ID": 2, "Name": "Other"},
        {"RDD ID": 1, "Name": None, "Scope": '{"id":"3","name":"Scan parquet "}'},
    ]
    facts = facts_of([job_start(1, [1]), submitted(1, rdds=rdds)])
    (row,) = facts.stages.collect()
    assert row.scope_names == ["Scan parquet", "b"]
    assert row.rdd_ids == [5, 4, 3, 2, 1]
    assert (row.num_files_scanned, row.has_scan_parquet, row.has_broadcasted_data) == (2, True, False)
    assert rows(facts.stage_rdd_types, "rdd_name", "n") == [("FileScanRDD", 2), ("Other", 2), (None, 1)]


def test_stage_accumulables(facts_of):
    acc = [{"ID": 1, "Value": 5}, {"ID": "2", "Value": "6"}, {"Value": 7}, {"ID": "x", "Value": 1},
           {"ID": 1, "Value": [1, 2]}, {"ID": 3}]
    facts = facts_of([completed(1, accumulables=acc)])
    assert rows(facts.stage_accumulables, "acc_id", "value") == [(1, "[1,2]"), (2, "6"), (3, None)]


def test_tasks(facts_of):
    facts = facts_of([
        task_start(1, Speculative=True, Host="h"), task_end(1, finish=1700),
        task_start(2),                                   # never ends
        task_end(3, launch=1200, finish=2000),           # no start
        task_start(4, launch=0), task_end(4, launch=500, finish=800),
        task_end(5, finish=None),
        {**task_start(6), "Stage ID": None},
        task_end(7, launch=100, finish=900), task_start(7, launch=300),
    ])
    assert rows(facts.tasks, "task_id", "launch_ms", "duration_ms", "speculative", "ended") == [
        (1, 1000, 700, True, True),
        (2, 1000, None, False, False),
        (3, None, 800, None, True),
        (4, 0, 300, False, True),
        (5, None, None, None, True),
        (7, 300, 600, False, True),
    ]


def test_task_metrics(facts_of):
    metrics = {
        "Executor Run Time": 11, "JVM GC Time": "bad", "Input Metrics": {"Bytes Read": 7},
        "Shuffle Read Metrics": {"Remote Bytes Read": 2, "Local Bytes Read": 3},
    }
    facts = facts_of([task_end(1, metrics=metrics), task_end(2)])
    assert rows(
        facts.tasks, "task_id", "exec_run_ms", "gc_ms", "input_bytes", "input_records", "shuffle_read_bytes"
    ) == [(1, 11, 0, 7, 0, 5), (2, 0, 0, 0, 0, 0)]


def test_task_sql_accums(facts_of):
    acc = [
        {"ID": 1, "Update": 1, "Value": 10, "Metadata": "sql"}, {"ID": 2, "Value": 5},
        {"ID": 1, "Update": 1, "Value": 11, "Metadata": "sql"}, {"ID": 3, "Value": "7", "Metadata": "sql"},
    ]
    facts = facts_of([task_end(1, accumulables=acc), task_end(1), task_end(2)])
    assert rows(facts.task_sql_accums, "task_id", "acc_id", "value") == [(1, 1, "11"), (1, 3, "7")]


def test_driver_accums(facts_of):
    def update(i, pairs):
        return {"Event": SQL + "SparkListenerDriverAccumUpdates", "executionId": i, "accumUpdates": pairs}

    facts = facts_of([update(1, [[5, 1], [6, 2], [5, 3]]), update(1, [[6, 9]]), update(None, [[7, 1]]), update(2, [])])
    assert rows(facts.driver_accums, "execution_id", "acc_id", "value") == [(1, 5, 3), (1, 6, 9), (None, 7, 1)]


def test_only_final_adaptive_plans(facts_of):
    scan = node("Scan parquet ", metrics=[(ROWS, 1)])
    events = [
        exec_start(1, sparkPlanInfo=node("Project", scan)),
        final_plan(1, scan, simple="AdaptiveSparkPlan isFinalPlan=false"),
    ]
    assert facts_of(events).plan_nodes.count() == 0
    opened = facts_of(events, initial_plans=True)
    assert rows(opened.plan_nodes, "node_path", "node_name") == [("0", "Project"), ("0.0", "Scan parquet ")]
    assert rows(opened.plan_metrics, "acc_id", "node_path") == [(1, "0.0")]


@pytest.mark.parametrize(
    "location, file_name, schema_name",
    [
        ("InMemoryFileIndex(1 paths)[file:/lake/s/t]", "t", "s"),
        ("s/t", "t", "s"),
        ("t", "", ""),
        (None, "", ""),
        ("Index[file:/a/b, file:/a/c]", "c", "a"),
    ],
)
def test_scan_location(facts_of, location, file_name, schema_name):
    facts = facts_of([final_plan(1, node("Scan parquet ", location=location))])
    assert rows(facts.plan_nodes.filter("node_path = '0.0'"), "file_name", "schema_name") == [(file_name, schema_name)]


def test_plan_150_levels_deep(facts_of):
    tree = node("Scan parquet ", metrics=[(ROWS, 150)], location="a/b")
    for depth in range(149):
        tree = node(f"N{depth}", tree, node("Leaf", metrics=[("m", 1000 + depth)]))
    facts = facts_of([final_plan(1, tree)])
    assert facts.plan_nodes.count() == 1 + 150 + 149
    (scan,) = facts.plan_metrics.filter("acc_id = 150").collect()
    assert scan.node_path == ".".join(["0"] * 151)
    assert scan.file_name == "b"


def test_later_plans_of_an_execution(facts_of):
    facts = facts_of([
        final_plan(1, node("A", node("B", metrics=[("m", 1)]))),
        final_plan(1, node("C", metrics=[("m", 1), ("n", 1), ("bad", "x")])),
        final_plan(2, node("D")),
    ])
    # Paths missing from the second plan keep the first one's node.
    assert rows(facts.plan_nodes, "execution_id", "node_path", "node_name") == [
        (1, "0", "AdaptiveSparkPlan"), (1, "0.0", "C"), (1, "0.0.0", "B"),
        (2, "0", "AdaptiveSparkPlan"), (2, "0.0", "D"),
    ]
    assert rows(facts.plan_metrics, "acc_id", "node_name", "metric_name") == [(1, "C", "n")]


def test_accumulator_on_two_nodes(facts_of):
    facts = facts_of([final_plan(1, node("A", node("B", metrics=[("m", 1)])), node("C", metrics=[("m", 1)]))])
    assert rows(facts.plan_metrics, "acc_id", "node_name", "node_path") == [(1, "C", "0.1")]


def scan_stage(plan, values, **options):
    acc = [{"ID": k, "Value": v} for k, v in values.items()]
    return [exec_start(0), job_start(0, [1]), submitted(1), completed(1, accumulables=acc), final_plan(0, plan)]


def test_selectivity(facts_of):
    scan = node("Scan parquet ", metrics=[(ROWS, 1), ("scan time", 2)], location="s/t")
    plan = node("Filter", node("Filter", scan, metrics=[(ROWS, 3)]), metrics=[(ROWS, 4)])
    facts = facts_of(scan_stage(plan, {1: 200, 2: "30", 3: 80, 4: 50, 99: 1}))
    (r,) = R.scan_selectivity(facts).collect()
    assert (r.scan_rows, r.scan_time_ms, r.file_name, r.filter_rows) == (200, 30, "t", 50)
    assert (r.filtered_out_rows, r.filtered_pct_ref, r.retained_pct, r.filtered_out_pct) == (150, 25.0, 25.0, 75.0)
    (r,) = R.scan_selectivity(facts, use_post_scan=True).collect()
    assert (r.filter_rows, r.filtered_out_pct) == (80, 60.0)
    assert rows(facts.stage_plan_metrics.filter("filter_role = 'post_scan'"), "acc_id") == [(3,)]


def test_selectivity_nothing_filtered(facts_of):
    plan = node("Filter", node("Scan parquet ", metrics=[(ROWS, 1)]), metrics=[(ROWS, 3)])
    (r,) = R.scan_selectivity(facts_of(scan_stage(plan, {1: 0, 3: 0}))).collect()
    assert (r.filtered_out_rows, r.filtered_pct_ref, r.retained_pct, r.filtered_out_pct) == (0, 0.0, None, None)


def test_selectivity_needs_a_scan_figure(facts_of):
    plan = node("Filter", node("Scan parquet ", metrics=[("files read", 1)]), metrics=[(ROWS, 3)])
    assert R.scan_selectivity(facts_of(scan_stage(plan, {1: 5, 3: 1}))).count() == 0
    plan = node("Scan parquet ", metrics=[("scan time", 1)])
    (r,) = R.scan_selectivity(facts_of(scan_stage(plan, {1: 5}))).collect()
    assert (r.scan_rows, r.scan_time_ms, r.filter_rows, r.filtered_pct_ref) == (None, 5, None, None)


def test_two_scans_and_filters_on_other_branches(facts_of):
    left = node("Filter", node("Scan parquet ", metrics=[(ROWS, 1)], location="s/left"), metrics=[(ROWS, 2)])
    right = node("Filter", node("Scan parquet ", metrics=[(ROWS, 3)], location="s/right"), metrics=[(ROWS, 4)])
    facts = facts_of(scan_stage(node("Join", left, right), {1: 10, 2: 4, 3: 20, 4: 5}))
    # The deepest scan gets the file and the mark, the topmost path the figures.
    assert rows(facts.stage_plan_metrics.filter("filter_role IS NOT NULL"), "acc_id") == [(4,)]
    assert rows(R.slowest_files(facts), "file_name", "total_duration_ms") == [("right", 2000)]
    (r,) = R.scan_selectivity(facts).collect()
    assert (r.scan_rows, r.filter_rows, r.file_name) == (10, 4, "left")


def test_named_table_scans(facts_of):
    plan = node("Scan parquet db.t", metrics=[(ROWS, 1)], location="s/t")
    events = scan_stage(plan, {1: 10})
    assert R.scan_selectivity(facts_of(events)).count() == 0
    assert rows(R.scan_selectivity(facts_of(events, match="prefix")), "scan_rows") == [(10,)]
    assert rows(R.slowest_files(facts_of(events, match="prefix")), "file_name") == [("t",)]


@pytest.mark.parametrize(
    "durations, want",
    [
        ([1, 2, 3, 4], []),                               # upper median 3
        ([1, 2, 3, 10], [(4, 3, 10, 3)]),
        ([1, 2, 10, 30], []),                             # lower median would flag it
        ([1, 1, 3], []),                                  # too few
        ([0, 0, 0, 1], [(4, 0, 1, 3)]),
        ([0, 0, 0, 0], []),
        ([5, 5, 5, 16, 16], [(5, 5, 16, 3)]),             # first of the slowest
        ([5, 5, 5, 15], []),                              # not above the ratio
        ([5, 5, 16, None], []),
        ([-9, -9, -9, 4], []),                            # negative median
    ],
)
def test_skew(facts_of, durations, want):
    assert rows(R.skew_suspects(facts_of(skew_log(durations))), "tasks", "median_ms", "max_ms", "task_id") == want


def test_skew_options(facts_of):
    facts = facts_of(skew_log([10, 10, 19]))
    assert rows(R.skew_suspects(facts, ratio=1.5, min_tasks=3), "max_ms") == [(19,)]
    assert R.skew_suspects(facts, ratio=1.5, min_tasks=4).count() == 0


def test_rankings(facts_of):
    events = [exec_start(0)]
    # The second job was submitted first, so its stages come first among equals.
    events += [job_start(1, [1, 2, 3], submitted=2000), job_start(2, [4, 5], submitted=1000)]
    for stage, end in ((1, 1000), (2, None), (3, 1500), (4, 1500), (5, 9000)):
        events += [submitted(stage), completed(stage, end=end)]
    facts = facts_of(events)
    top = R.slowest_stages(facts, top_n=4).orderBy("rank")
    assert [(r.stage_id, r.duration_ms) for r in top.collect()] == [(5, 8000), (4, 500), (3, 500), (1, 0)]
    # Zero counts as -1 and so equals a missing duration.
    assert [r.stage_id for r in R.slowest_stages(facts).orderBy("rank").collect()] == [5, 4, 3, 1, 2]
    assert [r.job_id for r in R.execution_jobs(facts, 0).collect()] == [2, 1]


def test_slowest_tasks_ties_and_limit(facts_of):
    facts = facts_of(skew_log([5, 7, 7, 0, 3], stage=2))
    top = R.slowest_tasks(facts, top_n=3).orderBy("rank")
    assert [(r.task_id, r.duration_ms) for r in top.collect()] == [(1, 7), (2, 7), (0, 5)]
    assert R.slowest_tasks(facts, execution_id=0).count() == 5
    assert R.slowest_tasks(facts, execution_id=1).count() == 0


def test_trace_keeps_jobs_without_stages(facts_of):
    events = skew_log([5, 7]) + [job_start(9, [50], submitted=2000), submitted(60)]
    facts = facts_of(events)
    report = R.trace_execution(facts, 0, task_breakdown=True)
    assert set(report) == {"slowest_stages", "slowest_tasks", "skew_suspects", "slowest_files", "trace"}
    assert [(r.job_id, r.stage_id, r.task_id, r.duration_ms) for r in report["trace"].collect()] == [
        (0, 0, 1, 7), (0, 0, 0, 5), (9, None, None, None),
    ]
    assert rows(R.trace_execution(facts, 0)["trace"], "job_id", "tasks", "skipped_stages") == [(0, 2, 0), (9, None, 1)]


def test_jobs_outside_sql_are_not_reported(facts_of):
    facts = facts_of([job_start(1, [1], execution=None), submitted(1), completed(1)])
    assert R.slowest_stages(facts).count() == 0
    assert R.execution_trace(facts).count() == 0
    assert R.job_summary(facts).count() == 1


def test_duplicate_lines_do_not_count_twice(facts_of):
    events = skew_log([1, 2, 3, 10])
    facts = facts_of([e for e in events for _ in range(3)])
    assert rows(R.skew_suspects(facts), "tasks", "max_ms") == [(4, 10)]
    assert rows(R.job_summary(facts), "job_id", "stages") == [(0, 1)]
