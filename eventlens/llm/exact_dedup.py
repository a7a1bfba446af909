"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.llm.common import SPACES, keyed, stored

_TEXT = ("text_sha256", "n_bytes", "checksum")


def digest_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_key, text_sha256, n_bytes, checksum, run)`` of every row.

    Texts are compared after each run of white space became one space; null counts as
    empty.  Besides the SHA-256 a length and a second hash are kept, which every level
    of the merge compares too.  ``run`` is the partition that read the row.
    """
    rows = keyed(docs, id_col, text_col)
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), SPACES, " ")
    return rows.withColumn("plain", plain).select(
        "doc_id",
        "text_key",
        F.sha2("plain", 256).alias("text_sha256"),
        F.octet_length("plain").alias("n_bytes"),
        F.xxhash64("plain").alias("checksum"),
        F.spark_partition_id().alias("run"),
    )


def merge_runs(runs: DataFrame, fan_in: int = 8) -> DataFrame:
    """One row per distinct text: ``(text_sha256, n_bytes, checksum, keep_id, group_size)``.

    Every partition first reduces its own rows to a run with one row per text.  Then,
    round by round, ``fan_in`` neighbouring runs exchange their rows by (merged run,
    digest), and each task puts what it gets in the order of digests and ids.  In this
    order the rows of a text stand together, the smallest id first: that row stays, if
    length and second hash are equal too, with the sizes of all.  A text with a third of all
    rows has one row per run after the first step and loses a factor ``fan_in`` of them
    in each round, so no key is hot anywhere; a run is spread over tasks by digest, so no
    task holds a whole run.
    """
    last = runs.agg(F.max("run")).first()[0] or 0
    merged = runs.groupBy("run", *_TEXT).agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    text = Window.partitionBy("run", *_TEXT).orderBy(F.asc_nulls_last("keep_id"))
    whole = text.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    while last > 0:
        last //= fan_in
        merged = (
            merged.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .withColumns(
                {"place": F.row_number().over(text), "group_size": F.sum("group_size").over(whole)}
            )
            .filter("place = 1").drop("place")
        )
    return merged.drop("run")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8
) -> DataFrame:
    """One row per input row with its group of equal texts.

    Columns: doc_id, text_key (hash of the raw text), keep_id (smallest id of the group),
    group_size, kept, text_sha256.

    Null and empty texts are equal to each other; white space only is a text of one
    space.  Null ids come last: such a row stays only where no row of its group has an
    id.  Repeated rows of one id count in ``group_size`` and share their fate.  A text of
    any length is one row, of which only the digest moves on.  An empty table gives an empty result.
    Other columns are not read.
    """
    runs = stored(digest_runs(docs, id_col, text_col), "digest-runs")
    texts = stored(merge_runs(runs, fan_in), "digest-root")
    return runs.drop("run").join(texts, list(_TEXT)).select(
        "doc_id",
        "text_key",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )
