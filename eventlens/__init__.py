"""Spark event logs as tables and performance reports."""

from eventlens.facts import LogFacts
from eventlens.reports import show_report, trace_execution, write_executions
from eventlens.session import configure, shared_folder
from eventlens.sources import parse_events, read_events

__all__ = [
    "LogFacts",
    "configure",
    "parse_events",
    "read_events",
    "shared_folder",
    "show_report",
    "trace_execution",
    "write_executions",
]
