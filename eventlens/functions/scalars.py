"""Column expressions.  All are built-in functions, none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metrics that hold a duration, by unit.
DURATION_METRICS_MS = ("scan time", "duration", "sort time", "fetch wait time", "task commit time")
DURATION_METRICS_NS = ("shuffle write time",)

MS_PER_DAY = 86_400_000


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any sort."""
    return F.trim(text, F.lit(" \t\n\r\x0b\x0c"))


def to_int(value: Column) -> Column:
    """Whole number, or null where there is none; fractions of numbers are cut."""
    return value.try_cast("bigint")


def int_or_zero(value: Column) -> Column:
    return F.coalesce(to_int(value), F.lit(0).cast("bigint"))


def utc_text(ms: Column) -> Column:
    """Epoch milliseconds as UTC text dd-MM-yyyy HH:mm:ss.

    Built from whole days and seconds so that it does not depend on the time
    zone of the session.
    """
    day = F.floor(ms / MS_PER_DAY)
    second = F.floor((ms - day * MS_PER_DAY) / 1000)

    def two_digits(n: Column) -> Column:
        return F.lpad(n.cast("string"), 2, "0")

    return F.concat(
        F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "dd-MM-yyyy"),
        F.lit(" "),
        F.concat_ws(
            ":",
            two_digits(F.floor(second / 3600)),
            two_digits(F.floor(second / 60) % 60),
            two_digits(second % 60),
        ),
    )


def _floor_div(v: Column, by: int) -> Column:
    """Whole part, rounded down, in integers: what is over is taken off first."""
    return ((v - F.pmod(v, F.lit(by))) / F.lit(by)).cast("bigint")


def duration_seconds(value: Column, unit: str = "ms") -> Column:
    """Seconds from milliseconds (one decimal) or nanoseconds (two decimals).

    Rounds half up in integer arithmetic; an unknown unit gives null.
    """
    v = to_int(value)
    if unit == "ms":
        return _floor_div(v + 50, 100) / F.lit(10.0)
    if unit == "ns":
        return _floor_div(v + 5_000_000, 10_000_000) / F.lit(100.0)
    return F.lit(None).cast("double")


def _plain_decimal(number: Column, digits: int) -> Column:
    # A cast from double to string switches to exponents at 1e7.
    text = number.cast(f"decimal(24,{digits})").cast("string")
    return F.regexp_replace(text, r"(\.\d+?)0$", "$1") if digits > 1 else text


def duration_text(seconds: Column, digits: int = 1) -> Column:
    return (
        F.when(seconds.isNull(), F.lit("n/a"))
        .when(seconds < 1, F.lit("<1 s"))
        .otherwise(F.concat(_plain_decimal(seconds, digits), F.lit(" s")))
    )


def fmt_seconds(value: Column, unit: str = "ms") -> Column:
    return duration_text(duration_seconds(value, unit), 2 if unit == "ns" else 1)


def kb_text(n_bytes: Column) -> Column:
    # n / 1024 is exact, so half-even rounding sees true ties only.
    kb = F.bround(to_int(n_bytes) / F.lit(1024.0), 1)
    return F.coalesce(_plain_decimal(kb, 1), F.lit("n/a"))


def metric_value_text(metric_name: Column, raw_value: Column) -> Column:
    """Durations as text, all other metric values as they are."""
    name = F.coalesce(strip(metric_name), F.lit(""))
    return (
        F.when(name.isin(*DURATION_METRICS_MS), fmt_seconds(raw_value, "ms"))
        .when(name.isin(*DURATION_METRICS_NS), fmt_seconds(raw_value, "ns"))
        .otherwise(raw_value.cast("string"))
    )


def thousands_text(n: Column) -> Column:
    return F.coalesce(F.replace(F.format_number(n, 0), F.lit(","), F.lit(" ")), F.lit("n/a"))


def path_key(path: Column) -> Column:
    """Sortable form of a plan path: "0.1.10" is [0, 1, 10]; null is [0]."""
    return F.transform(
        F.split(F.coalesce(path, F.lit("0")), r"\."),
        lambda part: F.coalesce(part.try_cast("int"), F.lit(0)),
    )


def is_ancestor(ancestor: Column, descendant: Column) -> Column:
    """True if the first plan path is the second one or lies above it."""
    return (ancestor == descendant) | descendant.startswith(F.concat(ancestor, F.lit(".")))
