"""What the physical plans must and must not contain."""

import pytest
from conftest import SF_DIR

from workload.queries import all_queries as queries
from pyspark.sql import functions as F

from eventlens import LogFacts
from eventlens import reports as R
from workload.synth import copies_of, synth_lines
from workload.queries import log_files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_pairs_no_python(spark, name):
    text = plan(queries()[name](spark, SF_DIR))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in text


def test_lines_are_decoded_once(spark):
    facts = LogFacts(spark, log_files(spark, SF_DIR))
    text = plan(facts.tasks)
    assert text.count("from_json") == 1
    assert text.count("Exchange") == 1


def test_rankings_cut_before_the_shuffle(spark):
    facts = LogFacts(spark, log_files(spark, SF_DIR))
    assert "WindowGroupLimit" in plan(R.slowest_stages(facts))
    assert plan(R.slowest_tasks(facts)).count("row_number(), 10, Partial") == 2


def test_only_needed_task_columns_are_read(spark):
    from workload.queries import facts_of

    text = plan(R.stage_task_counts(facts_of(spark, SF_DIR)))
    assert "ReadSchema: struct<log_id:string,stage_id:bigint,stage_attempt_id:bigint,ended:boolean>" in text


def test_skew_reads_tasks_once(spark):
    from workload.queries import facts_of

    df = R.skew_suspects(facts_of(spark, SF_DIR))
    text = plan(df)
    scans = [line for line in text.splitlines() if "FileScan" in line and "task_id#" in line]
    assert len(scans) == 1
    assert "SortAggregate" not in text


def test_the_session_keeps_its_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    facts = LogFacts(spark, log_files(spark, SF_DIR), partitions=3)
    assert facts.tasks.rdd.getNumPartitions() == 3
    facts.unpersist()
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_without_a_store_lines_are_decoded_once(spark):
    facts = LogFacts(spark, log_files(spark, SF_DIR))
    text = plan(R.execution_trace(facts, task_breakdown=True))
    # Every scan of text stands below a persisted table.
    below = None
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if below is not None and depth <= below:
            below = None
        if "InMemoryRelation" in line and below is None:
            below = depth
        assert "FileScan text" not in line or below is not None
    assert "InMemoryRelation" in plan(facts.events)
    facts.unpersist()


def test_one_execution_cuts_tasks_first(spark):
    from workload.queries import facts_of

    text = plan(R.execution_trace(facts_of(spark, SF_DIR), 0, "synth-0", task_breakdown=True))
    assert text.count("LeftSemi") >= 3


def test_a_log_is_in_few_task_files(spark, tmp_path):
    store = str(tmp_path / "store")
    lines = copies_of(synth_lines(spark, SF_DIR), 8)
    facts = LogFacts(spark, lines, store=store, partitions=8)
    first = facts.tasks.agg(F.min("log_id")).first()[0]
    files = facts.tasks.select("log_id", F.input_file_name().alias("f")).distinct()
    assert files.filter(F.col("log_id") == first).count() <= 3
    assert files.select("f").distinct().count() == 8


def test_one_log_limits_every_scan(spark, capsys):
    from workload.queries import facts_of

    R.execution_trace(facts_of(spark, SF_DIR), 0, "synth-0", task_breakdown=True).explain("formatted")
    pushed = [line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters")]
    assert len(pushed) > 8
    assert all("EqualTo(log_id,synth-0)" in line for line in pushed)


def test_filters_are_marked_without_a_second_read(spark):
    from workload.queries import facts_of

    from eventlens.plans import metrics as M

    facts = facts_of(spark, SF_DIR)
    resolved = M.resolve_stage_metrics(facts.stage_accumulables, facts.plan_metrics)
    assert plan(M.stage_plan_metrics(resolved)).split("== Initial Plan ==")[-1].count("FileScan") == 2


def test_scans_of_stages_are_read_as_stored(spark):
    from workload.queries import facts_of

    text = plan(R.scan_selectivity(facts_of(spark, SF_DIR)))
    assert "Aggregate" not in text and "Exchange" not in text
