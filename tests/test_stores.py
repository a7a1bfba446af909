"""Logs with equal names, stores that know what they were made from, unreadable files."""

import json

import pytest
from conftest import rows

from eventlens import LogFacts, read_events
from eventlens import schema as S


def write(path, events):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((e if isinstance(e, str) else json.dumps(e)) + "\n" for e in events))


def task_end(task_id):
    return {
        "Event": S.TASK_END, "Stage ID": 1, "Stage Attempt ID": 0,
        "Task Info": {"Task ID": task_id, "Attempt": 0, "Launch Time": 1, "Finish Time": 5},
    }


def test_equal_names_in_two_folders(spark, tmp_path):
    write(tmp_path / "a/app-1", [task_end(1), task_end(2)])
    write(tmp_path / "b/app-1", [task_end(1), task_end(2)])
    write(tmp_path / "c/eventlog_v2_app-1/events_1_app-1", [task_end(1)])
    write(tmp_path / "d/eventlog_v2_app-1/events_1_app-1", [task_end(1)])
    facts = LogFacts(spark, str(tmp_path))
    assert rows(facts.tasks, "log_id", "task_id") == [
        ("a/app-1", 1), ("a/app-1", 2), ("b/app-1", 1), ("b/app-1", 2),
        ("c/eventlog_v2_app-1", 1), ("d/eventlog_v2_app-1", 1),
    ]
    lines = read_events(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert lines.select("log_id").distinct().count() == 2
    assert rows(lines.select("log_name").distinct()) == [("app-1",)]
    one = read_events(spark, str(tmp_path / "a/app-1"))
    assert rows(one.select("log_id").distinct()) == [("app-1",)]


def test_a_store_knows_its_source(spark, tmp_path):
    write(tmp_path / "one/app", [task_end(1)])
    write(tmp_path / "two/app", [task_end(7)])
    store = str(tmp_path / "store")
    assert rows(LogFacts(spark, str(tmp_path / "one"), store=store).tasks, "task_id") == [(1,)]
    assert rows(LogFacts(spark, str(tmp_path / "one"), store=store).tasks, "task_id") == [(1,)]
    assert rows(LogFacts(spark, None, store=store).tasks, "task_id") == [(1,)]
    with pytest.raises(ValueError, match="was made from"):
        LogFacts(spark, str(tmp_path / "two"), store=store)
    with pytest.raises(ValueError, match="no store"):
        LogFacts(spark, None, store=str(tmp_path / "nothing"))


def test_counts_and_bad_lines_of_a_reopened_store(spark, tmp_path):
    write(tmp_path / "logs/app", [task_end(1), "{broken"])
    store = str(tmp_path / "store")
    made = LogFacts(spark, str(tmp_path / "logs"), store=store)
    made.event_counts, made.bad_lines
    again = LogFacts(spark, None, store=store)
    assert rows(again.event_counts, "event", "n") == [(S.TASK_END, 1)]
    assert rows(again.bad_lines, "value") == [("{broken",)]
    with pytest.raises(ValueError, match="malformed"):
        LogFacts(spark, None, store=store, strict=True)


def test_unreadable_codecs_raise(spark, tmp_path):
    write(tmp_path / "app.lzf", [task_end(1)])
    with pytest.raises(Exception, match="cannot read the codec"):
        LogFacts(spark, str(tmp_path)).tasks.collect()


def count_decoded(spark, monkeypatch):
    """Lines that are decoded from now on."""
    from eventlens import facts as module

    seen, whole = [], module.decode_lines

    def counted(lines, strict=False):
        seen.append(rows(lines, "log_id", "value"))
        return whole(lines, strict)

    monkeypatch.setattr(module, "decode_lines", counted)
    return seen


def every_table(facts):
    return {n: rows(getattr(facts, n)) for n in (*facts.TABLES, "event_counts", "bad_lines")}


def test_added_logs_are_decoded_alone(spark, tmp_path, monkeypatch):
    """A folder that gains logs, a rolled file of a known log, and lines of a known file."""
    logs, store = tmp_path / "logs", str(tmp_path / "store")
    write(logs / "a", [task_end(1), task_end(2), "{broken"])
    write(logs / "eventlog_v2_r/events_1_r", [task_end(1)])
    assert LogFacts(spark, str(logs), store=store).build().tasks.count() == 3

    seen = count_decoded(spark, monkeypatch)
    assert LogFacts(spark, str(logs), store=store).build().tasks.count() == 3
    assert seen == []
    write(logs / "b", [task_end(7)])
    grown = LogFacts(spark, str(logs), store=store).build()
    assert [r[0] for part in seen for r in part] == ["b"]
    assert rows(grown.tasks, "log_id", "task_id") == [("a", 1), ("a", 2), ("b", 7), ("eventlog_v2_r", 1)]

    seen.clear()
    write(logs / "eventlog_v2_r/events_2_r", [task_end(5)])
    write(logs / "a", [task_end(1), task_end(2), "{broken", task_end(3), "[bad"])
    grown = LogFacts(spark, str(logs), store=store)
    got = every_table(grown)
    assert {r[0] for part in seen for r in part} == {"a", "eventlog_v2_r"}
    monkeypatch.undo()
    assert got == every_table(LogFacts(spark, str(logs), store=str(tmp_path / "fresh")))
    assert got == every_table(LogFacts(spark, None, store=store))
    assert len(got["tasks"]) == 6 and len(got["bad_lines"]) == 2

    (logs / "b").unlink()
    with pytest.raises(ValueError, match="are missing"):
        LogFacts(spark, str(logs), store=store)


def test_logs_without_known_events(spark, tmp_path):
    other = json.dumps({"Event": "SparkListenerOther"})
    empty = spark.createDataFrame([], "log_id string, seq bigint, value string")
    for i, source in enumerate((empty, spark.createDataFrame([("a", 0, other)], empty.schema))):
        facts = LogFacts(spark, source, store=str(tmp_path / f"store{i}")).build()
        assert all(getattr(facts, name).count() == 0 for name in facts.TABLES)
        assert facts.event_counts.count() == i and facts.events.count() == 0
    write(tmp_path / "logs/app", [])
    assert LogFacts(spark, str(tmp_path / "logs"), store=str(tmp_path / "s")).build().tasks.count() == 0


def test_another_dataframe_is_refused(spark, tmp_path):
    schema, store = "log_id string, seq bigint, value string", str(tmp_path / "store")
    first = spark.createDataFrame([("a", 0, json.dumps(task_end(1)))], schema)
    LogFacts(spark, first, store=store).tasks  # noqa: B018
    assert rows(LogFacts(spark, first, store=store).tasks, "task_id") == [(1,)]
    other = spark.createDataFrame([("a", 0, json.dumps(task_end(2)))], schema)
    with pytest.raises(ValueError, match="other rows"):
        LogFacts(spark, other, store=store)
    write(tmp_path / "logs/app", [task_end(1)])
    with pytest.raises(ValueError, match="was made from"):
        LogFacts(spark, str(tmp_path / "logs"), store=store)


def bare_text_scans(df):
    """Scans of text that do not stand below a persisted table."""
    found, below = 0, None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        if below is not None and depth <= below:
            below = None
        if "InMemoryRelation" in line and below is None:
            below = depth
        found += "FileScan text" in line and below is None
    return found


def test_release_of_one_keeps_the_other(spark, tmp_path):
    from eventlens.reports.summary import execution_trace

    write(tmp_path / "logs/app", [task_end(1), "{broken"])
    one, other = (LogFacts(spark, str(tmp_path / "logs")) for _ in range(2))
    for facts in (one, other):
        assert facts.build().tasks.count() == 1
    one.unpersist()
    assert bare_text_scans(execution_trace(other, task_breakdown=True)) == 0
    third = LogFacts(spark, str(tmp_path / "logs"))
    assert bare_text_scans(execution_trace(third, task_breakdown=True)) == 0
    assert bare_text_scans(third.event_counts) == bare_text_scans(third.bad_lines) == 0
    assert rows(third.bad_lines, "value") == [("{broken",)]
    other.unpersist(), third.unpersist()


def test_counts_and_bad_lines_scan_no_text_beside_a_store(spark, tmp_path):
    write(tmp_path / "logs/app", [task_end(1), "{broken"])
    facts = LogFacts(spark, str(tmp_path / "logs"), store=str(tmp_path / "store"))
    for df in (facts.events, facts.event_counts, facts.bad_lines):
        assert "FileScan text" not in df._jdf.queryExecution().executedPlan().toString()


def test_tables_made_at_the_same_time(spark, tmp_path, monkeypatch):
    from workload.queries import log_files
    from conftest import SF_DIR

    from eventlens.session import Store

    written, whole = [], Store._note

    def noted(self, name, part, **said):
        written.append((name, part))
        whole(self, name, part, **said)

    monkeypatch.setattr(Store, "_note", noted)
    logs = log_files(spark, SF_DIR)
    made = LogFacts(spark, logs, store=str(tmp_path / "store")).build()
    assert len(written) == len(set(written)) >= 12
    plain = LogFacts(spark, logs)
    for name in LogFacts.TABLES:
        ours, theirs = getattr(made, name), getattr(plain, name)
        assert ours.columns == theirs.columns, name
        assert ours.count() == theirs.count(), name
    assert rows(made.stage_scans.drop("file_name")) == rows(plain.stage_scans.drop("file_name"))
    plain.unpersist()


def test_an_error_while_tables_are_made_is_raised(spark, tmp_path, monkeypatch):
    write(tmp_path / "logs/app", [task_end(1)])
    facts = LogFacts(spark, str(tmp_path / "logs"), store=str(tmp_path / "store"))
    from eventlens.operators import jobs as jb

    def broken(events):
        raise RuntimeError("no jobs today")

    with monkeypatch.context() as m:
        m.setattr(jb, "jobs", broken)
        with pytest.raises(RuntimeError, match="no jobs today"):
            facts.build()
    # The next call makes what is missing.
    assert facts.build().jobs.count() == 0
    assert rows(facts.tasks, "task_id") == [(1,)]


def test_tables_that_another_object_made_since_are_found(spark, tmp_path):
    write(tmp_path / "logs/app", [task_end(1)])
    store = str(tmp_path / "store")
    one = LogFacts(spark, str(tmp_path / "logs"), store=store)
    one.events
    other = LogFacts(spark, None, store=store)
    one.tasks
    assert other.store.made("tasks", 0) is not None
    assert other.store.made("jobs", 0) is None
    assert rows(other.tasks, "task_id") == [(1,)]
