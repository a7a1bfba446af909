"""What tasks hold and write does not grow with the logs."""

from pathlib import Path
from types import SimpleNamespace

from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from eventlens import read_events, shared_folder
from eventlens.session import OPEN_FILES, Store
from eventlens.schema import KINDS
from workload import queries as Q

OPEN = "spark.sql.maxConcurrentOutputFileWriters"


def test_tables_in_folders_are_not_sorted(spark, monkeypatch):
    seen, write = {}, DataFrameWriter.parquet
    before = spark.conf.get(OPEN)

    def noted(self, path, *args, **kwargs):
        seen[path.split("/")[-2]] = spark.conf.get(OPEN)
        return write(self, path, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", noted)
    store = Store(spark, shared_folder(spark, "t"))
    # More folders than open files: the others are sorted, and none is lost.
    rows = spark.range(1000).select("id", (F.col("id") % 40).cast("string").alias("event"))
    split = store.make("split", 0, lambda: rows, ("event",))
    whole = store.make("whole", 0, lambda: rows)
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, whole.collect())) == sorted(map(tuple, rows.collect()))
    assert seen == {"split": str(OPEN_FILES), "whole": before}
    assert spark.conf.get(OPEN) == before
    assert len(KINDS) + 2 <= OPEN_FILES


def lines(spark):
    """Lines of three logs in mixed order, one log longer than a task's share."""
    log = F.when(F.col("id") < 700, "a").when(F.col("id") < 800, "b").otherwise("c")
    text = F.concat(F.lit('{"n":'), "id", F.lit("}"))
    df = spark.range(1000).select(log.alias("log_id"), F.col("id").alias("seq"), text.alias("value"))
    return df.orderBy(F.xxhash64("seq"))


def test_logs_are_compressed_and_sorted_in_small_tasks(spark, monkeypatch):
    monkeypatch.setattr(Q, "lines_of", lambda spark, sf_dir: lines(spark))
    monkeypatch.setattr(Q, "LINES_PER_TASK", 100)
    monkeypatch.setattr(Q, "_files", {})
    read, none = [], "log_id string, stage_id long, stage_attempt_id long, job_id long"
    facts = SimpleNamespace(stage_submissions=spark.createDataFrame([], none))
    monkeypatch.setattr(Q, "LogFacts", lambda spark, path, **options: read.append((path, options)) or facts)
    Q.q_read_events_order(spark, "tables")
    path, options = read[0]
    assert options["store"]
    files = [f.name for f in Path(path.removeprefix("file:")).rglob("part-*")]
    assert len(files) >= 10 and all(f.endswith(".txt.gz") for f in files)
    got = read_events(spark, path).orderBy("log_id", "seq").select("log_name", "value").collect()
    want = lines(spark).orderBy("log_id", "seq").select(F.concat(F.lit("log_id="), "log_id"), "value").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_logs_of_equal_names_are_compressed(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(Q, "lines_of", lambda spark, sf_dir: lines(spark))
    monkeypatch.setattr(Q, "LINES_PER_TASK", 100)
    monkeypatch.setattr(Q, "read_events", lambda spark, path: paths.append(path) or read_events(spark, path))
    counts = {r[0]: r[1] for r in Q.q_read_events_same_name(spark, "tables").collect()}
    assert counts == {f"{part}/{log}": n for part in ("first", "second") for log, n in (("a", 700), ("b", 100), ("c", 200))}
    files = [f.name for f in Path(paths[0].removeprefix("file:")).rglob("part-*")]
    assert len(files) >= 20 and all(f.endswith(".txt.gz") for f in files)


def test_logs_for_two_folders_are_shuffled_once(spark, monkeypatch):
    dealt, paths, deal = [], [], type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, *a: dealt.append(a) or deal(self, *a))
    monkeypatch.setattr(Q, "lines_of", lambda spark, sf_dir: lines(spark))
    monkeypatch.setattr(Q, "LINES_PER_TASK", 100)
    monkeypatch.setattr(Q, "read_events", lambda spark, path: paths.append(path) or read_events(spark, path))
    Q.q_read_events_same_name(spark, "tables").collect()
    # Both copies of the lines count as lines of a task.
    assert [a[0] for a in dealt] == [20]
    got = read_events(spark, paths[0]).orderBy("log_id", "seq").select("log_id", "value").collect()
    want = lines(spark).orderBy("log_id", "seq").select(F.concat(F.lit("log_id="), "log_id"), "value").collect()
    assert [tuple(r) for r in got] == [(f"folder={part}/{log}", v) for part in ("first", "second") for log, v in want]
