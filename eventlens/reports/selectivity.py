"""Rows and time of scans, and what the filters above them let through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.facts import LogFacts


def scan_selectivity(
    facts: LogFacts, use_post_scan: bool = False, stages: DataFrame | None = None
) -> DataFrame:
    """One row per stage attempt (of ``stages``) that has scan rows or a scan time.

    Of several scans or filters the topmost counts; ``use_post_scan`` takes the
    filter marked as nearest above the scan instead.  ``filtered_pct_ref`` is
    the share that passed (0 where nothing was dropped), ``retained_pct`` and
    ``filtered_out_pct`` are what their names say.
    """

    scans = facts.stage_scans
    if stages is not None:
        scans = scans.join(stages.select(*S.STAGE_KEY), S.STAGE_KEY, "left_semi")
    per_stage = (
        scans.filter("scan_rows IS NOT NULL OR scan_time_ms IS NOT NULL")
        .select(
            *S.STAGE_KEY,
            "scan_rows",
            "scan_time_ms",
            "file_name",
            F.col("post_scan_rows" if use_post_scan else "filter_rows").alias("filter_rows"),
        )
        .withColumn("filtered_out_rows", F.col("scan_rows") - F.col("filter_rows"))
    )

    out, scanned = F.col("filtered_out_rows"), F.col("scan_rows")
    return per_stage.withColumns(
        {
            "filtered_pct_ref": F.when(
                out > 0, F.lit(100.0) - F.try_divide(out.cast("double"), scanned.cast("double")) * 100
            ).when(out <= 0, F.lit(0.0)),
            "retained_pct": F.try_divide(
                F.col("filter_rows").cast("double"), scanned.cast("double")
            )
            * 100,
            "filtered_out_pct": F.try_divide(out.cast("double"), scanned.cast("double")) * 100,
        }
    )
