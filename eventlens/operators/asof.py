"""As-of join: the latest fact logged before each probe, per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Width of a chunk when ``seq`` is a plain number, as a power of two.
_CHUNK_BITS = 20


def seq_chunk(df: DataFrame) -> Column:
    """A coarse, order-preserving part of ``seq``.

    Lines read from files are chunked by file split (all of a split's lines
    share it), numbered lines by blocks of numbers.
    """
    if isinstance(df.schema["seq"].dataType, T.StructType):
        return F.struct(F.col("seq.roll"), F.col("seq.split_start"))
    return F.shiftright(F.col("seq"), _CHUNK_BITS)


def latest_before(
    probes: DataFrame, facts: DataFrame, on: Sequence[str], value: str
) -> DataFrame:
    """``probes`` plus the column ``value`` of the last fact with a lower ``seq``.

    Both inputs have the columns ``on`` and ``seq``.  Probes without an earlier
    fact get null.

    Works in two steps so that neither pairs of rows are formed nor one task
    has to sort all rows of a hot key: inside a chunk of the log by a running
    window over (key, chunk), between chunks by the last value per (key, chunk),
    carried forward.  The second step sees one row per key and chunk.
    """
    on = list(on)
    probe_cols = [c for c in probes.columns if c not in on and c != "seq"]
    fact_rows = facts.select(
        *on,
        "seq",
        seq_chunk(facts).alias("_chunk"),
        F.struct(F.col(value).alias("v")).alias("_fact"),
    )
    probe_rows = probes.select(
        *on,
        "seq",
        seq_chunk(probes).alias("_chunk"),
        F.struct(F.lit(True).alias("_is_probe"), *probe_cols).alias("_probe"),
    )

    before = (
        Window.partitionBy(*on, "_chunk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    )
    near = (
        fact_rows.unionByName(probe_rows, allowMissingColumns=True)
        .withColumn("_near", F.last("_fact", ignorenulls=True).over(before))
        .filter(F.col("_probe").isNotNull())
    )

    earlier = (
        Window.partitionBy(*on).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        fact_rows.unionByName(probe_rows, allowMissingColumns=True)
        .groupBy(*on, "_chunk")
        .agg(
            F.max_by("_fact", F.when(F.col("_fact").isNotNull(), F.col("seq"))).alias("_fact"),
            F.max(F.col("_probe").isNotNull()).alias("_wanted"),
        )
        .withColumn("_far", F.last("_fact", ignorenulls=True).over(earlier))
        .filter("_wanted")
        .select(*on, "_chunk", "_far")
    )
    return near.join(carried, [*on, "_chunk"], "left").select(
        *on,
        "seq",
        *[F.col("_probe")[c].alias(c) for c in probe_cols],
        F.coalesce("_near", "_far")["v"].alias(value),
    )
