"""Session settings, the shared folder for intermediate tables, and stores of tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from threading import RLock

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

_FILES = "path string, size long, modified timestamp, log_id string"

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Plans may be nested to any depth and number of nodes.
    "spark.sql.cteRecursionLevelLimit": "-1",
    "spark.sql.cteRecursionRowLimit": "-1",
    # Keep recursion steps on the executors: a plan can be many megabytes.
    "spark.sql.cteRecursionAnchorRowsLimitToConvertToLocalRelation": "0",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


#: Files that a task keeps open while it writes a table in folders; further folders are sorted.
OPEN_FILES = 16
_OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
_writing = RLock()


@contextmanager
def _unsorted_folders(spark: SparkSession) -> Iterator[None]:
    """Tables in folders are written with one open file a folder and task.

    Spark would sort all rows of a task by folder first, which takes memory for every one of
    them.  The setting is put back: writes whose rows have an order must keep it.
    """
    with _writing:
        before = spark.conf.get(_OPEN_FILES)
        spark.conf.set(_OPEN_FILES, OPEN_FILES)
        try:
            yield
        finally:
            spark.conf.set(_OPEN_FILES, before)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables that all machines of the cluster reach.

    Below ``spark.checkpoint.dir`` or the checkpoint folder of the context; where
    neither is set, below the warehouse, which is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and hasattr(spark.sparkContext, "getCheckpointDir"):
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """A folder of Parquet tables that were made from one source, in parts.

    The first part has the files that the store was made from; files that a history
    folder gains later make a further part, of all files of the logs they belong to.
    A table ``t`` lies below ``t/part=n``.  Where a log is in several parts, its rows in the
    last one count.

    ``files`` lists the files of each part, ``notes`` holds a text for the source and
    one for each part of a table.  That one is written after the last file of the table, so a table counts
    as made without markers of a committer, a broken run can be resumed, and
    a table is read by its noted schema, with no look into its files.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._notes: dict[tuple[str, int], dict] = {}
        self._replaced: DataFrame | None = None

    def _load(self, folder: str = "notes") -> None:
        reader = self.spark.read.option("wholetext", True).option("recursiveFileLookup", True)
        try:
            texts = reader.text(f"{self.path}/{folder}").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return
        for (text,) in texts:
            note = json.loads(text)
            self._notes[note["name"], note["part"]] = note

    def _note(self, name: str, part: int, **said) -> None:
        note = {"name": name, "part": part, **said}
        text = self.spark.range(0, 1, 1, 1).select(F.lit(json.dumps(note)).alias("value"))
        text.write.mode("overwrite").text(f"{self.path}/notes/{name}-{part}")
        self._notes[name, part] = note

    @property
    def parts(self) -> list[int]:
        return sorted(part for name, part in self._notes if name == "source")

    def made(self, name: str, part: int) -> dict | None:
        """The note of a table's part, if it was made, by this object or another one since."""
        if (name, part) not in self._notes:
            self._load(f"notes/{name}-{part}")
        return self._notes.get((name, part))

    def open(self) -> None:
        """Opens a store as it is."""
        self._load()
        if not self.parts:
            raise ValueError(f"there is no store at {self.path}")
        self._find_replaced()

    def open_rows(self, told: dict) -> None:
        """Opens or begins a store of a DataFrame, of which ``told`` is known."""
        self._load()
        known = self._notes.get(("source", 0))
        if known is None:
            self._note("source", 0, source=told)
        elif known["source"] != told:
            raise self._other(told)

    def _other(self, told: object) -> ValueError:
        known = self._notes["source", 0]["source"]
        return ValueError(
            f"the store at {self.path} was made from {known}, not from {told}; "
            "take a new folder, or open it without a source"
        )

    def open_files(self, source: list[str], files: DataFrame) -> None:
        """Opens or begins a store of ``files (path, size, modified, log_id)``.

        Added files make a new part, and so do files that grew.  Raises if files of the store are gone.
        """
        self._load()
        if not self.parts:
            self._add_part(source, files)
            return
        if "files" not in self._notes["source", 0]:
            raise self._other(source)
        known = (
            self.spark.read.schema(f"{_FILES}, part int").parquet(f"{self.path}/files")
            .filter(F.col("part").isin(self.parts))
            .groupBy("path").agg(F.max_by(F.struct("size", "modified"), "part").alias("known"))
        )
        both = files.join(known, "path", "full_outer")
        new = F.struct("size", "modified") != F.col("known")
        gone, news = both.agg(
            F.count_if(F.col("size").isNull()), F.count_if(F.col("known").isNull() | new)
        ).first()
        if gone:
            raise self._other(f"{source}: {gone} of its files are missing")
        if news:
            logs = both.filter(F.col("known").isNull() | new).select("log_id").distinct()
            self._add_part(source, files.join(logs, "log_id", "left_semi"))
        self._find_replaced()

    def _add_part(self, source: list[str], files: DataFrame) -> None:
        part = len(self.parts)
        path = f"{self.path}/files/part={part}"
        files.select("path", "size", "modified", "log_id").write.mode("overwrite").parquet(path)
        n = self.spark.read.schema(_FILES).parquet(path).count()
        self._note("source", part, source=source, files=n)

    def _find_replaced(self) -> None:
        if len(self.parts) < 2:
            return
        logs = self.spark.read.schema(f"{_FILES}, part int").parquet(f"{self.path}/files")
        logs = logs.filter(F.col("part").isin(self.parts)).select("log_id", "part").distinct()
        last = Window.partitionBy("log_id")
        replaced = logs.withColumn("last", F.max("part").over(last)).filter("part < last").drop("last")
        self._replaced = None if replaced.isEmpty() else replaced

    def files_of(self, part: int) -> list[str]:
        rows = self.spark.read.schema(_FILES).parquet(f"{self.path}/files/part={part}")
        return [r[0] for r in rows.select("path").collect()]

    def make(
        self,
        name: str,
        part: int,
        make: Callable[[], DataFrame],
        partition_by: tuple[str, ...] = (),
        say: Callable[[], dict] = dict,
    ) -> DataFrame:
        """A part of a table, made and written first if it is missing."""
        if self.made(name, part) is None:
            df = make()
            path = f"{self.path}/{name}/part={part}"
            with _unsorted_folders(self.spark) if partition_by else nullcontext():
                df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
            self._note(name, part, schema=df.schema.json(), **say())
        return self._read(name, [part]).drop("part")

    def table(self, name: str) -> DataFrame:
        """All parts of a table, without logs that a later part has anew."""
        rows = self._read(name, self.parts)
        if self._replaced is not None:
            rows = rows.join(self._replaced, ["log_id", "part"], "left_anti")
        return rows.drop("part")

    def _read(self, name: str, parts: list[int]) -> DataFrame:
        schema = StructType.fromJson(json.loads(self._notes[name, parts[0]]["schema"]))
        whole = StructType([*schema.fields, StructField("part", IntegerType())])
        rows = self.spark.read.schema(whole).parquet(f"{self.path}/{name}")
        return rows.filter(F.col("part").isin(parts)).select(*schema.names, "part")
