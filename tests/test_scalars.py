import pytest
from conftest import rows
from pyspark.sql import functions as F

from eventlens import functions as fn


def values(spark, type_, pairs, expr):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(pairs)], f"i int, v {type_}")
    got = [r[1] for r in sorted(df.select("i", expr(F.col("v"))).collect())]
    assert got == [want for _, want in pairs]


def test_to_int(spark):
    texts = [("12", 12), (" 12 ", 12), ("1.5", None), ("", None), ("{}", None), ("x", None), (None, None), ("-3", -3)]
    values(spark, "string", texts, fn.to_int)
    values(spark, "double", [(12.7, 12), (-12.7, -12), (None, None)], fn.to_int)


def test_int_or_zero(spark):
    values(spark, "string", [("7", 7), ("x", 0), (None, 0)], fn.int_or_zero)


def test_duration_seconds(spark):
    ms = [(0, 0.0), (49, 0.0), (50, 0.1), (1249, 1.2), (1250, 1.3), (99_999, 100.0), (None, None)]
    values(spark, "bigint", ms, fn.duration_seconds)
    ns = [(0, 0.0), (4_999_999, 0.0), (5_000_000, 0.01), (1_234_000_000, 1.23), (None, None)]
    values(spark, "bigint", ns, lambda v: fn.duration_seconds(v, "ns"))
    values(spark, "bigint", [(5, None)], lambda v: fn.duration_seconds(v, "h"))


def test_duration_text(spark):
    pairs = [(None, "n/a"), (0.0, "<1 s"), (0.9, "<1 s"), (1.0, "1.0 s"), (12.3, "12.3 s"), (1.25e8, "125000000.0 s")]
    values(spark, "double", pairs, fn.duration_text)


def test_fmt_seconds(spark):
    values(spark, "bigint", [(None, "n/a"), (999, "1.0 s"), (940, "<1 s"), (61_000, "61.0 s")], fn.fmt_seconds)
    ns = [(1_500_000_000, "1.5 s"), (1_000_000_000, "1.0 s"), (1_230_000_000, "1.23 s"), (10_000_000_000, "10.0 s")]
    values(spark, "bigint", ns, lambda v: fn.fmt_seconds(v, "ns"))


def test_kb_text(spark):
    pairs = [(None, "n/a"), (0, "0.0"), (1024, "1.0"), (1536, "1.5"), (256, "0.2"), (768, "0.8"), (20 * 1024**3, "20971520.0")]
    values(spark, "bigint", pairs, fn.kb_text)


@pytest.mark.parametrize(
    "name, raw, want",
    [
        ("scan time", "1500", "1.5 s"),
        (" sort time ", "10", "<1 s"),
        ("shuffle write time", "2500000000", "2.5 s"),
        ("number of output rows", "12", "12"),
        ("duration", "x", "n/a"),
        (None, "12", "12"),
    ],
)
def test_metric_value_text(spark, name, raw, want):
    df = spark.createDataFrame([(name, raw)], "n string, v string")
    assert df.select(fn.metric_value_text(F.col("n"), F.col("v"))).first()[0] == want


def test_path_key(spark):
    pairs = [("0.1.10.2", [0, 1, 10, 2]), ("0", [0]), ("0.x.3", [0, 0, 3]), (None, [0]), ("", [0])]
    values(spark, "string", pairs, fn.path_key)


def test_paths_sort_like_tuples(spark):
    paths = ["0.10", "0.2", "0", "0.2.1", "0.1.5"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [r[0] for r in df.orderBy(fn.path_key(F.col("p"))).collect()]
    assert got == ["0", "0.1.5", "0.2", "0.2.1", "0.10"]


def test_is_ancestor(spark):
    cases = [("0.1", "0.1", True), ("0.1", "0.1.2", True), ("0.1", "0.10", False), ("0.1.2", "0.1", False)]
    df = spark.createDataFrame(cases, "a string, d string, want boolean")
    assert df.filter(fn.is_ancestor(F.col("a"), F.col("d")) != F.col("want")).count() == 0


def test_thousands_text(spark):
    values(spark, "bigint", [(1234567, "1 234 567"), (12, "12"), (None, "n/a")], fn.thousands_text)


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo", "Asia/Tokyo"])
def test_utc_text_does_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        pairs = [(0, "01-01-1970 00:00:00"), (1_700_000_000_999, "14-11-2023 22:13:20"), (1_541_300_400_000, "04-11-2018 03:00:00"), (None, None)]
        values(spark, "bigint", pairs, fn.utc_text)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_with_text(spark):
    from eventlens.reports import with_text

    df = spark.createDataFrame([(1500, 2048, 12345, "f")], "duration_ms bigint, input_bytes bigint, scan_rows bigint, file_name string")
    got = with_text(df).first().asDict()
    assert (got["duration_text"], got["input_kb"], got["scan_rows_text"]) == ("1.5 s", "2.0", "12 345")
    assert rows(with_text(df.select("file_name"))) == [("f",)]
    metrics = spark.createDataFrame([("scan time", "2500")], "metric_name string, value string")
    assert with_text(metrics).first().value_text == "2.5 s"


def test_text_of_selectivity(spark):
    from eventlens.reports import with_text

    df = spark.createDataFrame(
        [(1234567, "f", 1000, 12.345), (5, "", None, None)],
        "scan_rows long, file_name string, filtered_out_rows long, filtered_out_pct double",
    )
    first, second = with_text(df).collect()
    assert (first.filtered_out_rows_text, first.filtered_out_pct_text, first.file_text) == ("1 000", "12.3 %", "f")
    assert (second.filtered_out_rows_text, second.filtered_out_pct_text, second.file_text) == ("n/a",) * 3
