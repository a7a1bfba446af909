"""Top-k rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group in the given total order, with ``rank``.

    Spark cuts each input partition to ``k`` rows per group before the shuffle
    (window group limit), so a hot group costs no more than a small one.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def by_duration() -> Column:
    """Longest first; missing and zero durations count as -1."""
    return F.coalesce(F.nullif(F.col("duration_ms"), F.lit(0)), F.lit(-1)).desc()
