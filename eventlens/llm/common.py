"""Shared helpers: written tables in the shared folder, keys of documents, ranks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java pattern of a run of white space (ASCII).
SPACES = r"[\x20\x09-\x0D]+"
#: A document is told by its id and a hash of its text, so that rows that share an id
#: but not a text stay apart.  Null ids are equal to each other.
KEY = ("doc_id", "text_key")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables that all machines reach.

    Below ``spark.checkpoint.dir``; where that is unset, below the warehouse, which
    is shared as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or (
        spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    )
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, size: int) -> Iterator[None]:
    """Tables written meanwhile go to Python tasks in batches of some ``size`` bytes.

    Spark counts rows otherwise, so a task would hold 10,000 texts of any length, on both
    sides.  The setting is put back.
    """
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, size)
    try:
        yield
    finally:
        spark.conf.unset(_BATCH) if before is None else spark.conf.set(_BATCH, before)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"__{name}_{uuid.uuid4().hex}"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, text)``; other columns, whatever their names, are left out."""
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")
    )


def attach(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEY, how: str = "left"):
    """Joins on ``keys`` (nulls are equal) and keeps the left ones."""
    other = right.select(
        *(F.col(k).alias(f"__{k}") for k in keys), *(c for c in right.columns if c not in keys)
    )
    condition = left[keys[0]].eqNullSafe(other[f"__{keys[0]}"])
    for k in keys[1:]:
        condition &= left[k].eqNullSafe(other[f"__{k}"])
    joined = left.join(other, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(f"__{k}" for k in keys))


#: Values that a key is hashed to before a join, and so the most rows of what is broadcast.
BUCKETS = 1 << 20


def key_bucket(columns: tuple[str, ...] = KEY) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def narrowed(rows: DataFrame, keys: DataFrame, columns: tuple[str, ...] = KEY) -> DataFrame:
    """``rows`` without most of those whose key is not in ``keys``, before any shuffle.

    The hash buckets of ``keys``, at most :data:`BUCKETS` numbers, are broadcast.  Where
    they are all taken nothing is left out; a join on the key itself must follow.
    """
    bucket = fresh("bucket")
    buckets = keys.select(key_bucket(columns).alias(bucket)).distinct()
    return rows.join(F.broadcast(buckets), key_bucket(columns) == F.col(bucket), "left_semi")


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """The rows of ``docs``, with all their columns, whose key is not in ``dropped``.

    Only rows in a hash bucket of a dropped one are shuffled; see :func:`narrowed`.
    """
    dropped = stored(dropped.select(*KEY).distinct(), "dropped")
    bucket, same_id, same_key = fresh("bucket"), fresh("id"), fresh("key")
    buckets = F.broadcast(dropped.select(key_bucket().alias(bucket)).distinct())
    text_key = F.xxhash64(docs[text_col].cast("string"))
    near = F.pmod(F.xxhash64(docs[id_col], text_key), F.lit(BUCKETS)) == F.col(bucket)
    ids = dropped.select(F.col("doc_id").alias(same_id), F.col("text_key").alias(same_key))
    same = docs[id_col].eqNullSafe(F.col(same_id)) & text_key.eqNullSafe(F.col(same_key))
    asked = docs.join(buckets, near, "left_semi").join(ids, same, "left_anti")
    return docs.join(buckets, near, "left_anti").unionByName(asked)


def most_frequent(counts: DataFrame, most: int, name: str) -> list:
    """Rows of ``counts`` with the highest ``n``, most frequent first: ``most`` at most.

    A histogram of the counts, which has a fixed size, tells from which count on they
    are few enough; only those come to the driver.  Where very many rows share a count, they are left out.
    """
    counts = stored(counts, name)
    # Sixteen classes for each doubling.
    kind = F.floor(F.log2("n") * 16).cast("int")
    classes = counts.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least, total = None, 0
    for r in sorted(classes, reverse=True):
        total += r["rows"]
        if total > most:
            break
        least = r["kind"]
    if least is None:
        return []
    rows = counts.filter(kind >= least).collect()
    return sorted(rows, key=lambda r: (-r["n"], *r))


def ranked(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the position of each row (from 0) in a total order, without a single task for all.

    Range partitions are numbered one by one; only their sizes come to the driver.
    """
    parts = stored(
        df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranked"
    )
    sizes = sorted((r[0], r[1]) for r in parts.groupBy("__part").count().collect())
    offsets, total = [], 0
    for part, n in sizes:
        offsets.append((part, total))
        total += n
    starts = df.sparkSession.createDataFrame(offsets, "__at int, __start bigint")
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return (
        parts.withColumn("__row", within)
        .join(starts, F.col("__part") == F.col("__at"))
        .withColumn(name, F.col("__start") + F.col("__row"))
        .drop("__part", "__at", "__start", "__row")
    )
