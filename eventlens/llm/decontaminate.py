"""Benchmark passages in documents by winnowing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import KEY, attach, keyed, narrowed, stored

#: What stands between words of text whose A-Z were lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text in upper case.
_UPPER_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x7F]+"
#: Bits of a fingerprint that hold its place; the others hold the hash.
_PLACE_BITS = 30


def _lowered(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def _split(text: Column, gap: str) -> Column:
    # Only the ends can be empty.  Splitting is ten times as fast as extracting matches.
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def _exact_words(text: str) -> Column:
    return _split(_lowered(F.col(text)), GAP)


def _folded_words(text: str) -> Column:
    """Words in upper case: quick, and equal wherever the exact words are equal."""
    return _split(F.upper(F.col(text)), _UPPER_GAP)


def _grams(words: Column, n: int) -> Column:
    """Hash (high bits) and place (low bits) of each run of ``n`` words."""
    return F.when(
        F.size(words) >= n,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - n),
            lambda i: F.shiftleft(F.xxhash64(F.lit(n), F.slice(words, i + 1, n)), _PLACE_BITS)
            .bitwiseOR(i.cast("bigint")),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: Column, window: int) -> Column:
    """The smallest hash, at its leftmost place, of each run of ``window`` grams."""
    return F.when(
        F.size(grams) >= window,
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.size(grams) - (window - 1)),
                lambda i: F.array_min(F.slice(grams, i, window)),
            )
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row.

    Catalyst would copy the expression to each place that uses it, lambdas included; it
    does not do so across a generator, here of one element.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def _fingerprints(words: DataFrame, span: int, k: int, short: list[int]) -> DataFrame:
    """Adds ``marks`` to a table with folded ``words``: what finds spans of ``span`` words,
    and every run of as many words as a short item has."""
    marks = _winnowed(F.col("grams"), span - k + 1)
    return (
        _once(words, "grams", _grams(F.col("words"), k))
        .withColumn("marks", F.concat(marks, *(_grams(F.col("words"), n) for n in short)))
        .drop("grams")
    )


def _windows(item_words: Column, span: int) -> Column:
    n = F.size(item_words)
    return F.transform(
        F.sequence(F.lit(0), F.greatest(n - span, F.lit(0))),
        lambda s: F.array_join(F.slice(item_words, s + 1, span), " "),
    )


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    span: int = 10,
    k: int = 5,
) -> DataFrame:
    """Words of documents that lie in a passage of ``span`` words of a benchmark item.

    Winnowing: of each ``span - k + 1`` consecutive k-grams of words the smallest hash is
    kept, so every shared span of ``span`` words shares a kept hash.  Fingerprints of
    documents are joined with those of the items; around each hit the spans that hold it
    are compared word by word.  An item of fewer words (but not none) is one span, found
    by hashes of runs of its length.

    Columns: doc_id, text_key, n_words, n_hit (words inside a span), n_items (items with
    spans in the document), items_sha256 (of the sorted ids, comma-joined), contaminated.
    Null texts have no words; items without id are left out; repeated items and rows
    change nothing.  Other columns are not read.  Without hits the digest is that of
    the empty text.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item_id"), F.col(item_text_col).alias("text")
    ).filter("item_id is not null")
    items = _once(items, "words", _exact_words("text")).filter("size(words) > 0")
    # Which lengths below the span occur: nine numbers at most.
    short = sorted(
        r[0]
        for r in items.select(F.size("words").alias("n")).filter(F.col("n") < span)
        .distinct().collect()
    )
    passages = stored(
        items.select("item_id", F.explode(_windows(F.col("words"), span)).alias("passage"))
        .distinct(),
        "passages",
    )
    # A passage holds its own words only, so its marks are those of any text around it.
    item_marks = stored(
        _fingerprints(
            _once(passages.select("passage"), "words", _folded_words("passage")), span, k, short
        )
        .select(F.explode("marks").alias("mark"))
        .select(F.shiftright("mark", _PLACE_BITS).alias("mark"))
        .distinct(),
        "item-marks",
    )

    rows = keyed(docs, id_col, text_col)
    marked = stored(
        _fingerprints(_once(rows, "words", _folded_words("text")), span, k, short).select(
            *KEY,
            F.size("words").cast("bigint").alias("n_words"),
            "marks",
        ),
        "document-marks",
    )
    hits = stored(
        marked.select(*KEY, F.explode("marks").alias("m"))
        .select(
            *KEY,
            F.shiftright("m", _PLACE_BITS).alias("mark"),
            F.col("m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)).cast("int").alias("place"),
        )
        .join(item_marks, "mark", "left_semi")
        .groupBy(*KEY)
        .agg(F.collect_set("place").alias("places")),
        "hits",
    )

    # The spans around each hit, compared as text.
    found = _once(attach(narrowed(rows, hits), hits, how="inner"), "words", _exact_words("text"))
    size = F.size("words")
    lengths = F.array(*(F.lit(n) for n in [span, *short]))
    around = F.array_distinct(
        F.flatten(
            F.transform(
                "places", lambda p: F.sequence(F.greatest(p - (span - k), F.lit(0)), p)
            )
        )
    )
    found = _once(found, "around", around).select(
        *KEY,
        F.flatten(
            F.transform(
                lengths,
                lambda n: F.transform(
                    F.filter("around", lambda s: s + n <= size),
                    lambda s: F.struct(
                        s.alias("start"),
                        n.alias("n"),
                        F.array_join(F.slice("words", s + 1, n), " ").alias("passage"),
                    ),
                ),
            )
        ).alias("spans"),
    )
    spans = found.select(*KEY, F.inline("spans"))
    texts = passages.select("passage").distinct()
    spans = stored(spans.join(texts, "passage", "left_semi").distinct(), "found-spans")

    covered = (
        spans.groupBy(*KEY)
        .agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("s"))
        .select(
            *KEY,
            F.aggregate(
                "s",
                F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
                lambda acc, x: F.struct(
                    F.greatest(acc["end"], x["start"] + x["n"]).alias("end"),
                    (
                        acc["hit"]
                        + F.greatest(
                            x["start"] + x["n"] - F.greatest(acc["end"], x["start"]), F.lit(0)
                        )
                    ).alias("hit"),
                ),
            )["hit"].cast("bigint").alias("n_hit"),
        )
    )
    with_items = (
        spans.select(*KEY, "passage").distinct()
        .join(passages, "passage")
        .select(*KEY, "item_id").distinct()
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
        .select(
            *KEY,
            F.size("ids").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        )
    )
    out = attach(attach(marked.drop("marks"), covered), with_items)
    return out.select(
        *KEY,
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("bigint")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
