"""The fact tables of a set of event logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from threading import RLock

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.operators import executions as ex
from eventlens.operators import jobs as jb
from eventlens.operators import stages as st
from eventlens.operators import tasks as tk
from eventlens.plans import flatten, metrics
from eventlens.session import Store, configure
from eventlens.sources import (
    bad_of,
    counts_of,
    decode_lines,
    events_of,
    read_events,
    source_files,
)


def _told() -> tuple[Column, Column]:
    """What tells the rows of a DataFrame: their number, and a hash of them all."""
    return F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(log_id, seq, value))").alias("hash")


class LogFacts:
    """Typed tables of one or many event logs, made on first use.

    ``source`` is what :func:`eventlens.sources.read_events` takes.

    With ``store``, a folder that all machines of the cluster can reach, the events
    are decoded once and written there as Parquet, and so is each table when it is
    first asked for.  Later tables and reports read the columns they need from these
    files, and a lost executor costs no more than its own tasks.  A store can be opened
    later (``source`` may then be None) and a broken run resumed.

    A store notes the files it was made from.  Opened with a folder that has gained
    files since, it decodes the logs of these files only, and the tables of these logs
    are made and put beside the others; a log that grew takes the place of its former
    rows.  Files that are gone raise an error, and so does another DataFrame.  Tables
    that depend on ``match`` or ``initial_plans`` have names of their own, and
    ``strict`` holds for a reopened store too.

    Without ``store`` the decoded lines and the tables are persisted by Spark (memory
    and disk, lineage kept) when they are first computed; :meth:`unpersist` lets go of
    them, and of no other object's.  Either way each line is decoded once: events,
    :attr:`event_counts`, :attr:`bad_lines` and ``strict`` come from the same pass.

    ``partitions`` is the number of partitions of the task fold, by far the largest
    shuffle; take some 128 MB of decoded text for each.  By default the session's
    ``spark.sql.shuffle.partitions`` holds, which no part of the library changes.

    ``match`` and ``initial_plans`` widen what counts as a Parquet scan and
    which plans are read (see ``plans``).
    """

    def __init__(
        self,
        spark: SparkSession,
        source: str | Sequence[str] | DataFrame | None,
        store: str | None = None,
        strict: bool = False,
        match: str = "exact",
        initial_plans: bool = False,
        partitions: int | None = None,
    ):
        self.spark = configure(spark)
        if source is None and store is None:
            raise ValueError("either a source or a store is needed")
        self.source = source
        self.lines = None if source is None else read_events(spark, source)
        self.strict = strict
        self.match = match
        self.initial_plans = initial_plans
        self.partitions = partitions
        self._made: dict[str, DataFrame] = {}
        self._locks: dict[str, RLock] = {}
        self._owner = uuid.uuid4().hex
        self.store = Store(spark, store) if store else None
        self._part: int | None = None
        self._parts: list[LogFacts] = []
        if self.store:
            self._open()
            if strict and not self.bad_lines.isEmpty():
                raise ValueError("malformed event line in log " + str(self.bad_lines.first()[0]))

    def _open(self) -> None:
        if self.source is None:
            self.store.open()
        elif isinstance(self.source, DataFrame):
            self.store.open_rows({"rows": self.source.schema.simpleString()})
            known = self.store.made("events", 0)
            if known and known["rows"] != list(self.lines.agg(*_told()).first()):
                raise ValueError(f"the store at {self.store.path} was made from other rows")
        else:
            source = [self.source] if isinstance(self.source, str) else list(self.source)
            self.store.open_files(source, source_files(self.spark, self.source))
        for part in self.store.parts:
            facts = copy(self)
            facts._part, facts._made = part, {}
            self._parts.append(facts)

    def _table(
        self,
        name: str,
        make: Callable[[LogFacts], DataFrame],
        partition_by: tuple[str, ...] = (),
        say: Callable[[], dict] = dict,
    ) -> DataFrame:
        """A table by its name; ``make`` makes it from the other tables of the same part.

        Threads that ask for the same table wait for the one that makes it.  Tables need
        each other in one direction only, so none waits for another without end.
        """
        with self._locks.setdefault(name, RLock()):
            if name not in self._made:
                self._made[name] = self._make(name, make, partition_by, say)
            return self._made[name]

    def _make(
        self,
        name: str,
        make: Callable[[LogFacts], DataFrame],
        partition_by: tuple[str, ...],
        say: Callable[[], dict],
    ) -> DataFrame:
        if not self.store:
            # The condition makes the plan this object's own: Spark looks tables up by
            # their plans, and another object's unpersist would let go of this one.
            own = F.lit(self._owner) == F.lit(self._owner)
            return make(self).filter(own).persist(StorageLevel.MEMORY_AND_DISK)
        if self._part is not None:
            return self.store.make(name, self._part, lambda: make(self), partition_by, say)
        for part in self._parts:
            part._table(name, make, partition_by, say)
        return self.store.table(name)

    def _lines(self) -> DataFrame:
        """The lines of this part: all, or those of the files that it added."""
        if self.lines is None:
            raise ValueError(f"the store at {self.store.path} has no events; open it with its source")
        if not self.store or len(self.store.parts) == 1:
            return self.lines
        return read_events(self.spark, self.store.files_of(self._part), self.source)

    def _plans(self, name: str) -> str:
        """Name of a table that depends on which plans are read."""
        return f"{name}-initial" if self.initial_plans else name

    def _events(self, *kinds: str) -> DataFrame:
        return self.events.filter(F.col("event").isin(*kinds))

    def unpersist(self) -> None:
        """Lets go of persisted tables; they are made again when asked for."""
        if not self.store:
            for df in self._made.values():
                df.unpersist()
            self._made.clear()

    def of_log(self, log_id: str | None) -> LogFacts | OneLog:
        """The same tables, limited to one log; None for all of them."""
        return self if log_id is None else OneLog(self, log_id)

    @property
    def _decoded(self) -> DataFrame:
        """All lines, decoded once; see :func:`eventlens.sources.decode_lines`."""
        seen = Observation()

        def make(part: LogFacts) -> DataFrame:
            lines = part._lines()
            if part.store and isinstance(part.source, DataFrame):
                lines = lines.observe(seen, *_told())
            return decode_lines(lines, part.strict and not part.store)

        def say() -> dict:
            return {"rows": list(seen.get.values())} if isinstance(self.source, DataFrame) else {}

        return self._table("events", make, ("event",), say)

    @property
    def events(self) -> DataFrame:
        """Typed events of the ten kinds."""
        return events_of(self._decoded)

    @property
    def event_counts(self) -> DataFrame:
        """Lines per event name, those that are not used further included."""
        return self._table("event_counts", lambda f: counts_of(f._decoded))

    @property
    def bad_lines(self) -> DataFrame:
        """Lines that are no JSON objects."""
        return bad_of(self._decoded)

    @property
    def executions(self) -> DataFrame:
        return self._table(
            "executions", lambda f: ex.executions(f._events(S.SQL_START, S.SQL_END))
        )

    @property
    def driver_accums(self) -> DataFrame:
        return self._table("driver_accums", lambda f: ex.driver_accums(f._events(S.SQL_ACCUMS)))

    @property
    def jobs(self) -> DataFrame:
        return self._table("jobs", lambda f: jb.jobs(f._events(S.JOB_START, S.JOB_END)))

    @property
    def job_stages(self) -> DataFrame:
        return self._table("job_stages", lambda f: jb.job_stages(f._events(S.JOB_START)))

    @property
    def stage_submissions(self) -> DataFrame:
        """Submitted stage attempts with their job."""
        return self._table(
            "stage_submissions",
            lambda f: st.stage_job_asof(f._events(S.JOB_START, S.STAGE_SUBMITTED)),
        )

    @property
    def stages(self) -> DataFrame:
        return self._table(
            "stages",
            lambda f: st.stages(f._events(S.STAGE_COMPLETED), f.stage_submissions),
        )

    @property
    def stage_rdd_types(self) -> DataFrame:
        return st.stage_rdd_types(self.stage_submissions)

    @property
    def stage_accumulables(self) -> DataFrame:
        return self._table(
            "stage_accumulables",
            lambda f: st.stage_accumulables(f._events(S.STAGE_COMPLETED)),
        )

    @property
    def _tasks(self) -> DataFrame:
        return self._table(
            "tasks",
            lambda f: tk.tasks_with_accums(f._events(S.TASK_START, S.TASK_END), f.partitions),
        )

    @property
    def tasks(self) -> DataFrame:
        return self._tasks.drop("sql_accums")

    @property
    def task_sql_accums(self) -> DataFrame:
        return tk.accums_of(self._tasks)

    @property
    def plan_tree(self) -> DataFrame:
        """Nodes of every final plan event, before later ones replace earlier ones."""
        return self._table(
            self._plans("plan_tree"),
            lambda f: flatten.flatten_plans(
                f._events(S.SQL_PLAN, S.SQL_START), f.initial_plans
            ),
        )

    @property
    def plan_nodes(self) -> DataFrame:
        return self._table(self._plans("plan_nodes"), lambda f: flatten.plan_nodes(f.plan_tree))

    @property
    def plan_metrics(self) -> DataFrame:
        return self._table(self._plans("plan_metrics"), lambda f: flatten.plan_metrics(f.plan_tree))

    def _by_match(self, name: str) -> str:
        """Name of a table that depends on what counts as a scan, too."""
        return self._plans(name) + ("" if self.match == "exact" else f"-{self.match}")

    @property
    def stage_plan_metrics(self) -> DataFrame:
        return self._table(
            self._by_match("stage_plan_metrics"),
            lambda f: metrics.stage_plan_metrics(
                metrics.resolve_stage_metrics(f.stage_accumulables, f.plan_metrics), f.match
            ),
        )

    @property
    def stage_scans(self) -> DataFrame:
        """What the topmost scans and filters of each stage counted; read by many reports."""
        return self._table(
            self._by_match("stage_scans"),
            lambda f: metrics.stage_scans(f.stage_plan_metrics, f.match),
        )

    TABLES = (
        "executions",
        "driver_accums",
        "jobs",
        "job_stages",
        "stages",
        "stage_rdd_types",
        "stage_accumulables",
        "tasks",
        "task_sql_accums",
        "plan_nodes",
        "plan_metrics",
        "stage_plan_metrics",
        "stage_scans",
    )

    def build(self) -> LogFacts:
        """Makes all tables: writes them to the store, or marks them to be persisted.

        Tables that do not need each other are written at the same time, so that the cluster
        has work while the last tasks of one of them run.
        """
        if not self.store:
            for name in self.TABLES:
                getattr(self, name)
            return self
        self._decoded
        make = inheritable_thread_target(self.spark)(lambda name: getattr(self, name))
        with ThreadPoolExecutor(len(self.TABLES)) as pool:
            list(pool.map(make, self.TABLES))
        return self


class OneLog:
    """The tables of a :class:`LogFacts`, limited to one log.

    The limit is put on every table: Spark carries it over inner joins by
    itself, but not into all inputs of outer joins.
    """

    def __init__(self, facts: LogFacts, log_id: str):
        self._facts, self._log_id = facts, log_id

    def of_log(self, log_id: str | None) -> OneLog:
        """This log, whichever is asked for; another one has no rows here."""
        return self if log_id in (None, self._log_id) else OneLog(self, log_id)

    def build(self) -> OneLog:
        """Makes all tables, those of other logs included; see :meth:`LogFacts.build`."""
        self._facts.build()
        return self

    def __getattr__(self, name: str):
        value = getattr(self._facts, name)
        if isinstance(value, DataFrame):
            return value.filter(F.col("log_id") == self._log_id)
        return value
