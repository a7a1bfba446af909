from eventlens.sources.events import (
    bad_lines,
    bad_of,
    counts_of,
    decode_lines,
    event_counts,
    events_of,
    parse_events,
    route,
)
from eventlens.sources.lines import read_events, skip_blank, source_files

__all__ = [
    "bad_lines", "bad_of", "counts_of", "decode_lines", "event_counts", "events_of", "parse_events",
    "read_events", "route", "skip_blank", "source_files",
]
