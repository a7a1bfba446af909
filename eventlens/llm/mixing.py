"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import SPACES, ranked, stored

#: Documents whose fractions one task rounds against each other at the first level, and
#: residuals at each level above.
GROUP_ROWS, FAN_IN = 4096, 64
_STATE = (
    "doc_id long, text_key long, source string, size long, source_size long, target double, "
    "whole long, p double, open boolean, salt long"
)


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3
) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from rows ``(source, size)``.

    Sources in code-point order, null last, take the weights in turn and share the sum
    of all sizes.  A target stops at ``cap`` times the size of its source; what is over
    goes to the others by weight, until none is above.
    """
    sources = sizes.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs")
    )
    sources = ranked(stored(sources, "sources"), [F.asc_nulls_last("source")])
    of_rank = F.element_at(
        F.array(*(F.lit(w) for w in weights)), (F.col("rank") % len(weights)).cast("int") + 1
    )
    sources = stored(sources.withColumn("weight", of_rank.cast("long")), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    # Level of the water: what a weight of one gets.  Each step fills more sources up.
    level, full = 0.0, -1
    while True:
        filled = F.col("weight") * F.lit(level) > F.col("source_size") * cap
        if full < 0:
            filled = F.lit(False)
        n, taken, weight = sources.agg(
            F.count_if(filled),
            F.sum(F.when(filled, F.col("source_size"))),
            F.sum(F.when(~filled, F.col("weight"))),
        ).first()
        if n == full:
            break
        full = n
        if not weight:
            level = float("inf")
            break
        level = (total - cap * (taken or 0)) / weight
    capped = F.col("source_size").cast("double") * cap
    target = capped if level == float("inf") else F.least(capped, F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def _rounded(rows: DataFrame) -> DataFrame:
    """Rounds the fractions of each (source, salt) but for one residual, which stays open.

    Two documents with fractions p and q of sizes s and t pass words to each other until
    one fraction is 0 or 1; which way is drawn so that no expectation changes, and the
    sum of words stays as it is.
    """

    def pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that is still open, with its fraction
        group = None
        for batch in batches:
            rows, out = batch.to_pylist(), []
            for row in rows:
                if (row["source"], row["salt"]) != group:
                    if held:
                        out.append(held)
                    held, group = None, (row["source"], row["salt"])
                if not 0 < row["p"] < 1 or not row["size"]:
                    out.append(row | {"open": False})
                    continue
                if held is None:
                    held = row
                    continue
                s, t, p, q = held["size"], row["size"], held["p"], row["p"]
                up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
                moved = up if row["u"] * (up + down) < down else -down
                full_p = moved == (1 - p) * s or moved == -p * s
                p, q = p + moved / s, q - moved / t
                if full_p:
                    out.append(held | {"p": float(p > 0.5), "open": False})
                    held = row | {"p": q}
                else:
                    out.append(row | {"p": float(q > 0.5), "open": False})
                    held = held | {"p": p}
                if not 1e-12 < held["p"] < 1 - 1e-12:
                    out.append(held | {"p": float(held["p"] > 0.5), "open": False})
                    held = None
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        if held:
            yield pa.RecordBatch.from_pylist([held], _SCHEMA)

    return (
        rows.repartition("source", "salt")
        .sortWithinPartitions("source", "salt", F.desc("size"), "doc_id", "text_key")
        .mapInArrow(pivot, _STATE)
    )


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()), ("text_key", pa.int64()), ("source", pa.string()),
        ("size", pa.int64()), ("source_size", pa.int64()), ("target", pa.float64()),
        ("whole", pa.int64()), ("p", pa.float64()), ("open", pa.bool_()), ("salt", pa.int64()),
    ]
)


def _rounded_together(rows: DataFrame) -> DataFrame:
    """Rounds the equal fractions of each (source, salt) but for one residual at most.

    The longest document is paired with the pool of all shorter ones, which share one
    fraction: words pass between the two until the document or the pool is integral, then
    the next longest is paired with what is left of the pool.  So a long
    document is decided while there are many words to make up for it, and what stays open is
    mostly one of the shortest.  Which way words pass is drawn so that no expectation changes.
    """

    def settle(group: list[dict]) -> list[dict]:
        rest, p, out = sum(r["size"] for r in group), None, []
        for i, row in enumerate(group):
            p, size = row["p"] if p is None else p, row["size"]
            rest -= size
            if not size or p <= 1e-12 or p >= 1 - 1e-12:
                out.append(row | {"p": float(p > 0.5), "open": False})
                continue
            if rest <= 0:
                return [*out, row | {"p": p}, *(r | {"p": 0.0, "open": False} for r in group[i + 1 :])]
            up, down = min((1 - p) * size, p * rest), min(p * size, (1 - p) * rest)
            moved = up if row["u"] * (up + down) < down else -down
            if moved in ((1 - p) * size, -p * size):
                out.append(row | {"p": float(moved > 0), "open": False})
                p -= moved / rest
            else:
                pool = float(moved < 0)
                out.append(row | {"p": p + moved / size})
                return [*out, *(r | {"p": pool, "open": False} for r in group[i + 1 :])]
        return out

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if group and (row["source"], row["salt"]) != (group[0]["source"], group[0]["salt"]):
                    yield pa.RecordBatch.from_pylist(settle(group), _SCHEMA)
                    group = []
                group.append(row)
        if group:
            yield pa.RecordBatch.from_pylist(settle(group), _SCHEMA)

    return (
        rows.repartition("source", "salt")
        .sortWithinPartitions("source", "salt", F.desc("size"), "doc_id", "text_key")
        .mapInArrow(pool, _STATE)
    )


def _draw(seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_key"), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = (1, 2, 3),
    cap: int = 3,
    seed: int = 7,
) -> DataFrame:
    """How often each document goes into a mix that gives each source its target of words.

    A document's size is its number of words (runs that are not ASCII white space).  All
    documents of a source have the same fractional number of copies, target over size of
    the source.  Its whole part is taken as it is; the fractions are rounded by the
    pivotal method: two pass words until one of them is integral.  In groups of
    documents (sources are split by a hash of the document) the longest is paired with all
    shorter ones, and so on; see :func:`_rounded_together`.  A group leaves one open fraction
    at most, mostly of a short document.  These are paired in groups of ``FAN_IN`` at the
    next level, until one is left for a source; that one is rounded to the nearer side.  So
    a source misses its target by half of that document at most.

    Columns: doc_id, text_key, source, size, source_size, target, copies, taken (words).
    Null and empty texts have size 0, and nothing is taken.  Null is a source of its own,
    the last.  Repeated rows are documents of their own.  Draws are hashes of seed, id
    and text, so reruns agree.  Other columns are not read.
    """
    words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), ""))
    rows = stored(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.xxhash64(F.col(text_col).cast("string")).alias("text_key"),
            F.col(source_col).cast("string").alias("source"),
            F.col(text_col).cast("string").alias("text"),
        ).select("doc_id", "text_key", "source", words.cast("long").alias("size")),
        "sizes",
    )
    sources = stored(source_targets(rows, weights, cap), "targets")
    largest = sources.agg(F.max("n_docs")).first()[0] or 0

    other = sources.withColumnRenamed("source", "__source")
    copies = F.when(
        F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))
    ).otherwise(0.0)
    state = rows.join(other, F.col("source").eqNullSafe(F.col("__source"))).select(
        "doc_id", "text_key", "source", "size", "source_size", "target",
        F.floor(copies).alias("whole"),
        (copies - F.floor(copies)).alias("p"),
        F.lit(True).alias("open"),
        F.pmod(
            F.xxhash64(F.lit(seed), "text_key", "doc_id"),
            F.ceil(F.col("n_docs") / GROUP_ROWS),
        ).alias("salt"),
    )
    groups, done, depth = max(1, ceil(largest / GROUP_ROWS)), [], 0
    while True:
        depth += 1
        rounded = _rounded_together if depth == 1 else _rounded
        level = stored(rounded(state.withColumn("u", _draw(seed + depth))), f"rounded-{depth}")
        done.append(level.filter("not open"))
        state = level.filter("open")
        if groups == 1:
            break
        groups = ceil(groups / FAN_IN)
        state = state.withColumn("salt", F.floor(F.col("salt") / FAN_IN))
    # One fraction a source is left, which is rounded to the nearer side.
    last = state.withColumn("p", (F.col("p") >= 0.5).cast("double"))
    out = last
    for part in done:
        out = out.unionByName(part)
    n = (F.col("whole") + F.col("p").cast("long")).alias("copies")
    return out.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0)).select(
        "doc_id", "text_key", "source", "size", "source_size", "target", n
    ).withColumn("taken", F.col("copies") * F.col("size"))
