"""Facts do not depend on how lines are split, shuffled or stored."""

import pytest
from conftest import SF_DIR, rows
from pyspark.sql import functions as F

from eventlens import LogFacts, read_events, shared_folder
from eventlens import reports as R
from workload.synth import copies_of, synth_lines
from workload.queries import log_files

SHOWN = ["executions", "jobs", "stages", "stage_accumulables", "plan_metrics", "driver_accums"]


def snapshot(facts):
    out = {name: rows(getattr(facts, name).drop("metadata", "start_seq", "submit_seq", "log_id")) for name in SHOWN}
    out["skew"] = rows(R.skew_suspects(facts).drop("log_id"))
    out["trace"] = rows(R.execution_trace(facts).drop("log_id"))
    return out


@pytest.fixture(scope="module")
def lines(spark):
    return synth_lines(spark, SF_DIR).persist()


@pytest.fixture(scope="module")
def expected(spark, lines):
    return snapshot(LogFacts(spark, lines, store=shared_folder(spark, "t")))


def test_shuffled_lines_without_store(spark, lines, expected):
    mixed = lines.orderBy(F.xxhash64("value")).repartition(7)
    assert snapshot(LogFacts(spark, mixed)) == expected


def test_small_file_splits(spark, expected):
    path = log_files(spark, SF_DIR)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        facts = LogFacts(spark, path, store=shared_folder(spark, "t"))
        assert facts.lines.rdd.getNumPartitions() > 10
        assert snapshot(facts) == expected
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_split_positions_follow_line_order(spark, tmp_path):
    for log in ("a", "b"):
        (tmp_path / log).write_text("".join(f'{{"n":{i}}}\n' for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = read_events(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
        ordered = got.orderBy("log_id", "seq").select("log_name", "value").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r) for r in ordered] == [(log, f'{{"n":{i}}}') for log in ("a", "b") for i in range(4000)]


def test_rolled_files(spark, tmp_path):
    folder = tmp_path / "eventlog_v2_app-1"
    folder.mkdir()
    for n in (10, 2, 1):
        (folder / f"events_{n}_app-1").write_text(f"line {n}.0\nline {n}.1\n")
    (folder / "appstatus_app-1").write_text("")
    (tmp_path / "app-2").write_text("x\n")
    got = read_events(spark, str(tmp_path)).orderBy("log_id", "seq").collect()
    assert [(r.log_id, r.value) for r in got] == [("app-2", "x")] + [
        ("eventlog_v2_app-1", f"line {n}.{i}") for n in (1, 2, 10) for i in (0, 1)
    ]


def test_copies_are_separate_logs(spark, lines, expected):
    facts = LogFacts(spark, copies_of(lines, 3), store=shared_folder(spark, "t"))
    assert rows(R.skew_suspects(facts).drop("log_id")) == sorted(expected["skew"] * 3, key=repr)
    assert rows(facts.jobs.drop("log_id", "start_seq")) == sorted(expected["jobs"] * 3, key=repr)


def test_one_execution_equals_its_part_of_all(spark, lines):
    facts = LogFacts(spark, lines, store=shared_folder(spark, "t"))
    for report in (R.slowest_stages, R.slowest_tasks, R.skew_suspects, R.slowest_files):
        every = report(facts).filter("execution_id = 2 AND log_id = 'synth-0'")
        assert rows(report(facts, execution_id=2, log_id="synth-0")) == rows(every)
    every = R.execution_trace(facts, task_breakdown=True).filter("execution_id = 2")
    assert rows(R.execution_trace(facts, 2, task_breakdown=True)) == rows(every)


def test_store_is_reused_and_resumed(spark, lines, expected):
    store = shared_folder(spark, "t")
    LogFacts(spark, lines, store=store).jobs  # noqa: B018  writes events and jobs
    again = LogFacts(spark, lines, store=store)
    assert snapshot(again) == expected
    opened = LogFacts(spark, None, store=store)
    assert rows(opened.jobs.drop("log_id", "start_seq")) == expected["jobs"]
    with pytest.raises(ValueError, match="source or a store"):
        LogFacts(spark, None)


def test_tables_of_one_log(spark, lines):
    facts = LogFacts(spark, copies_of(lines, 2))
    one = facts.of_log("synth-0-1")
    assert rows(one.jobs.select("log_id").distinct()) == [("synth-0-1",)]
    assert one.of_log(None) is one
    assert one.of_log("synth-0-0").jobs.count() == 0
    assert rows(R.slowest_stages(one)) == rows(R.slowest_stages(facts).filter("log_id = 'synth-0-1'"))
