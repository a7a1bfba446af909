"""Reading log files as ordered lines."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Codecs that Spark can log with but its text reader cannot decode.
UNREADABLE = r"(?i)\.(lzf)(\.inprogress)?$"


def read_events(
    spark: SparkSession,
    source: str | Sequence[str] | DataFrame,
    root: str | Sequence[str] | None = None,
) -> DataFrame:
    """Lines of one or many event logs as ``(log_id, log_name, seq, value)``.

    ``source`` is a path or a list of paths (plain files, rolled log folders,
    folders of either; plain or compressed), or a DataFrame that already has
    ``log_id``, ``seq`` and ``value``.

    ``log_id`` is the path of the file (of the folder, for rolled logs) below the
    source, so equal names in two folders stay two logs; with several sources it is
    the whole path.  ``log_name`` is the last part of it.  ``root`` is the source that
    logs are named by, where only some files of it are read.

    ``seq`` orders the lines of a log: index of the rolled file, start of the
    file split, row number within the split.  It is made on the scan itself, so
    it costs no shuffle and no global numbering, and a recomputed task gives
    the same values.

    A file whose codec the text reader cannot decode raises an error.
    """
    if isinstance(source, DataFrame):
        name = F.col("log_name" if "log_name" in source.columns else "log_id")
        return source.select("log_id", name.alias("log_name"), "seq", "value")

    files = text_files(spark, source)
    path, file_name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    roll = _roll(file_name)
    log_path, name = _log(path, roll)
    fail = F.raise_error(F.concat(F.lit("cannot read the codec of log file "), path))
    return files.filter(
        F.when(file_name.rlike(UNREADABLE), fail.cast("boolean")).otherwise(F.lit(True))
    ).select(
        _log_id(log_path, root or source, name).alias("log_id"),
        name.alias("log_name"),
        F.struct(
            F.coalesce(roll.try_cast("bigint"), F.lit(0).cast("bigint")).alias("roll"),
            F.col("_metadata.file_block_start").alias("split_start"),
            F.monotonically_increasing_id().alias("row"),
        ).alias("seq"),
        "value",
    )


def _roll(file_name: Column) -> Column:
    """Index of a rolled file (``events_<n>_<app>``) or of one that Spark rewrote
    (``part-<n>-...``); such files are one log per folder.  Empty for others."""
    return F.regexp_extract(file_name, r"^(?:events_|part-)(\d+)", 1)


def _log(path: Column, roll: Column) -> tuple[Column, Column]:
    """Path and name of the log that a file belongs to."""
    log_path = F.when(roll == "", path).otherwise(F.regexp_replace(path, "/[^/]*$", ""))
    return log_path, F.element_at(F.split(log_path, "/"), -1)


def _log_id(log_path: Column, source: str | Sequence[str], name: Column) -> Column:
    return _below(log_path, source, name) if isinstance(source, str) else log_path


def _below(log_path: Column, root: str, name: Column) -> Column:
    """The part of a path below the source; the name where the source is the log itself."""
    plain = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/{0,2}", "", root).strip("/")
    if not plain or re.search(r"[*?\[\]{}]", plain):
        return log_path
    at = F.locate(f"/{plain}/", F.concat(log_path, F.lit("/")))
    rest = F.substring(log_path, at + F.lit(len(plain) + 2), F.length(log_path))
    return F.when(at == 0, log_path).when(rest == "", name).otherwise(rest)


def text_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    return reader.text(paths if isinstance(paths, str) else list(paths))


def source_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The files below a source: ``(path, size, modified, log_id)``, without reading them."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True)
        .load(paths if isinstance(paths, str) else list(paths))
    )
    path = F.col("_metadata.file_path")
    log_path, name = _log(path, _roll(F.col("_metadata.file_name")))
    return listed.select(
        path.alias("path"),
        F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("modified"),
        _log_id(log_path, paths, name).alias("log_id"),
    )


def skip_blank(lines: DataFrame) -> DataFrame:
    return lines.filter(F.col("value").rlike(r"\S"))
