"""Logs that Spark itself writes: one plain file, and rolled with compression."""

import json
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from conftest import SF_DIR, rows

from eventlens import LogFacts
from eventlens import reports as R
from eventlens.schema import FINAL_PLAN, SQL_PLAN, TASK_END


@pytest.fixture(scope="module", params=["plain", "rolled"])
def log(request, spark, tmp_path_factory):
    base = tmp_path_factory.mktemp(request.param)
    (base / "logs").mkdir()
    script = Path(__file__).with_name("write_real_logs.py")
    args = [str(base / "logs"), SF_DIR, str(base), request.param]
    subprocess.run([sys.executable, str(script), *args], check=True, timeout=300, capture_output=True)
    return base / "logs", LogFacts(spark, str(base / "logs"))


def test_event_counts(log):
    folder, facts = log
    got = {r.event: r.n for r in facts.event_counts.collect()}
    assert got[TASK_END] > 4
    (plain,) = [p for p in folder.iterdir()] if len(list(folder.iterdir())) == 1 else [None]
    if plain is not None and plain.is_file():
        names = Counter(json.loads(line)["Event"] for line in plain.read_text().splitlines())
        assert got == dict(names)
    assert facts.bad_lines.count() == 0


def test_tasks(log):
    _, facts = log
    counts = {r.event: r.n for r in facts.event_counts.collect()}
    tasks = facts.tasks
    assert tasks.filter("ended").count() == counts[TASK_END]
    assert tasks.filter("duration_ms < 0 OR duration_ms IS NULL").count() == 0
    assert facts.task_sql_accums.count() > 0


def test_stages_belong_to_jobs(log):
    _, facts = log
    assert facts.stages.filter("job_id IS NULL").count() == 0
    assert rows(facts.jobs.select("result").distinct()) == [("JobSucceeded",)]
    assert facts.executions.filter("end_ms >= start_ms").count() == 2


def test_scan_rows(log, spark):
    _, facts = log
    lineitem = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    kept = lineitem.filter("l_quantity > 10").count()
    selectivity = R.scan_selectivity(facts)
    figures = rows(selectivity.filter("file_name = 'lineitem.parquet'"), "scan_rows", "filter_rows")
    assert figures == [(lineitem.count(), kept)]
    # The plain write has no adaptive plan, so it has no figures of its own.
    assert facts.plan_nodes.select("execution_id").distinct().count() == 1


def test_initial_plans_cover_the_write(log, spark):
    folder, _ = log
    facts = LogFacts(spark, str(folder), initial_plans=True)
    assert facts.plan_nodes.select("execution_id").distinct().count() == 2


def test_plan_tree_matches_a_plain_walk(log):
    """Paths and accumulators of the final plans, by a direct walk over the JSON."""
    folder, facts = log
    files = [p for p in folder.iterdir() if p.is_file()]
    if not files:
        pytest.skip("compressed")
    nodes, metrics = {}, {}

    def visit(node, path):
        nodes[path] = node["nodeName"]
        for m in node["metrics"]:
            metrics[m["accumulatorId"]] = (path, m["name"])
        for i, child in enumerate(node["children"]):
            visit(child, f"{path}.{i}")

    for line in files[0].read_text().splitlines():
        event = json.loads(line)
        if event["Event"] == SQL_PLAN and event["sparkPlanInfo"]["simpleString"] == FINAL_PLAN:
            visit(event["sparkPlanInfo"], "0")
    assert rows(facts.plan_nodes, "node_path", "node_name") == sorted(nodes.items(), key=repr)
    got = {r.acc_id: (r.node_path, r.metric_name) for r in facts.plan_metrics.collect()}
    assert got == metrics
    assert max(p.count(".") for p in nodes) > 12


def test_full_report(log):
    _, facts = log
    (execution,) = {r.execution_id for r in facts.plan_nodes.select("execution_id").collect()}
    report = R.trace_execution(facts, execution, task_breakdown=True)
    assert report["slowest_stages"].count() > 1
    assert report["slowest_files"].filter("file_name = 'lineitem.parquet'").count() == 1
    assert report["trace"].count() >= report["slowest_tasks"].count() > 1
