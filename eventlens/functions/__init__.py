from eventlens.functions.scalars import (
    duration_seconds,
    duration_text,
    fmt_seconds,
    int_or_zero,
    is_ancestor,
    kb_text,
    metric_value_text,
    path_key,
    strip,
    thousands_text,
    to_int,
    utc_text,
)

__all__ = [
    "duration_seconds",
    "duration_text",
    "fmt_seconds",
    "int_or_zero",
    "is_ancestor",
    "kb_text",
    "metric_value_text",
    "path_key",
    "strip",
    "thousands_text",
    "to_int",
    "utc_text",
]
