from eventlens.reports.lookup import (
    execution_jobs,
    job_stage_list,
    stage_tasks,
    task_breakdown,
    write_executions,
)
from eventlens.reports.rankings import (
    skew_suspects,
    slowest_files,
    slowest_stages,
    slowest_tasks,
    stage_task_counts,
)
from eventlens.reports.selectivity import scan_selectivity
from eventlens.reports.summary import (
    execution_overview,
    execution_trace,
    job_summary,
    skipped_stages,
    stage_summary,
    trace_execution,
)
from eventlens.reports.text import show_report, with_text

__all__ = [
    "execution_jobs",
    "execution_overview",
    "execution_trace",
    "job_stage_list",
    "job_summary",
    "scan_selectivity",
    "show_report",
    "skew_suspects",
    "skipped_stages",
    "slowest_files",
    "slowest_stages",
    "slowest_tasks",
    "stage_summary",
    "stage_task_counts",
    "stage_tasks",
    "task_breakdown",
    "trace_execution",
    "with_text",
    "write_executions",
]
