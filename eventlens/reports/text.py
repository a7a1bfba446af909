"""Readable forms of report columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions import fmt_seconds, kb_text, metric_value_text, thousands_text


def show_report(report: dict[str, DataFrame], n: int = 20) -> None:
    """Prints the tables of a report, readable columns included."""
    for name, table in report.items():
        print(name)
        with_text(table).show(n, truncate=False)


def with_text(report: DataFrame) -> DataFrame:
    """Adds a text column beside each raw column of a known unit.

    ``*_ms`` columns get ``*_text`` in seconds, ``*_bytes`` columns ``*_kb``,
    row counts of scans and filters ``*_text`` with grouped thousands, their
    percentages ``*_text`` with one decimal, the file of a scan ``file_text`` and the
    values of plan metrics ``value_text``; what is unknown is "n/a".
    """
    added = {}
    for name in report.columns:
        if name.endswith("_ms"):
            added[name.removesuffix("_ms") + "_text"] = fmt_seconds(F.col(name))
        elif name.endswith("_bytes"):
            added[name.removesuffix("_bytes") + "_kb"] = kb_text(F.col(name))
        elif name in ("scan_rows", "filter_rows", "filtered_out_rows"):
            added[name + "_text"] = thousands_text(F.col(name))
        elif name in ("filtered_pct_ref", "retained_pct", "filtered_out_pct"):
            percent = F.concat(F.format_number(F.col(name), 1), F.lit(" %"))
            added[name + "_text"] = F.coalesce(percent, F.lit("n/a"))
    if {"scan_rows", "file_name"} <= set(report.columns):
        added["file_text"] = F.coalesce(F.nullif(F.col("file_name"), F.lit("")), F.lit("n/a"))
    if {"metric_name", "value"} <= set(report.columns):
        added["value_text"] = metric_value_text(F.col("metric_name"), F.col("value"))
    return report.withColumns(added) if added else report
