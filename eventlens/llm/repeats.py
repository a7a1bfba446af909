"""Removing repeated byte strings: longest-previous-factor arrays over suffix orders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import attach, most_frequent, stored
from eventlens.llm.textbytes import PIECE_BYTES, byte_codes, mix, pieces, prefix_sums, span_hashes

KEY = ("doc_id", "text_key")
#: Grams that are kept in mind as frequent ones; how many changes speed, never results.
FREQUENT = 20_000
#: Context bytes whose suffixes are sorted together, where groups are small.
BATCH_BYTES = 1 << 21


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, out = 1, x
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _segments(batch: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, start in its text, bytes, offsets)``; long texts come in overlapping parts."""
    for first, last, data, offsets in pieces(batch, "text"):
        if last - first > 1 or len(data) <= PIECE_BYTES + length:
            yield first, 0, data, offsets
            continue
        for at in range(0, len(data) - length + 1, PIECE_BYTES):
            part = data[at : at + PIECE_BYTES + length - 1]
            yield first, at, part, np.array([0, len(part)])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, k: int):
    """The strings of ``length`` bytes of texts, in runs of neighbours with the same anchor.

    The anchor of a string is the leftmost of its k-grams with the smallest hash, so equal
    strings have equal anchors at equal places.  Returns for each run: row, first start,
    number of starts, hash of the anchor's gram, hash of the bytes of all its strings.
    """
    # Hashes are unsigned here too: numpy joins signed with unsigned ones as floats.
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    n = len(data) - length + 1
    if n <= 0:
        return nothing
    sums = prefix_sums(data, byte_codes(False))
    at = np.arange(len(data) - k + 1)
    grams = span_hashes(sums, at, at + k)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    owner = (_sliding_min(packed, length - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n), "right") - 1
    whole = np.arange(n) + length <= offsets[row + 1]
    starts = np.flatnonzero(whole)
    if not len(starts):
        return nothing
    own = owner[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin = starts[first]
    whole_run = span_hashes(sums, begin, begin + count + length - 1)
    return row[begin], begin, count, grams[own[first]], whole_run


def previous_factors(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Whether the longest previous factor at each start has ``length`` bytes or more.

    ``starts`` are in text order and have ``length`` bytes each.  The suffixes at them are
    sorted by their first ``length`` bytes (ranks by prefix doubling), equal ones by
    place.  The longest previous factor is the longer match with the previous and the
    next smaller place in that order.  Within a run of suffixes that agree on ``length``
    bytes places rise, so the previous smaller place of all but the first is its left
    neighbour, and the first agrees with neither on that many bytes.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    rank = np.zeros(len(data), np.uint64)
    for j in range(8):
        rank |= padded[j : j + len(data)] << np.uint64(56 - 8 * j)
    have = 8
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    while have < length:
        step = min(have, length - have)
        if have + step == length:
            pair = (rank[starts] << np.uint64(32)) | rank[starts + step]
            order = np.argsort(pair, kind="stable")
            same = np.zeros(len(starts), bool)
            same[order[1:]] = pair[order[1:]] == pair[order[:-1]]
            return same
        ahead = np.zeros(len(rank), np.uint64)
        ahead[: len(rank) - step] = rank[step:]
        rank = np.unique((rank << np.uint64(32)) | ahead, return_inverse=True)[1].astype(np.uint64)
        have += step
    raise ValueError("length must be over 8")


def _spans(rows: np.ndarray, starts: np.ndarray, length: int):
    """Covered spans of strings that start at ``starts`` (sorted by row and start)."""
    if not len(starts):
        return starts, starts, starts
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (starts[1:] > starts[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return rows[first], starts[first], starts[last] + length


_ANCHOR = "doc_id long, text_key long, start int, n int, gram long, run long, again boolean"


def _again(doc_id: pa.Array, text_key, start, gram, run) -> np.ndarray:
    """Rows with an equal run at an earlier place among the given ones."""
    both = mix(gram ^ mix(run))
    _, place, counts = np.unique(both, return_inverse=True, return_counts=True)
    some = np.flatnonzero(counts[place] > 1)
    again = np.zeros(len(start), bool)
    ids = doc_id.take(pa.array(some))
    none = ids.is_null().to_numpy(zero_copy_only=False)
    ids = pc.fill_null(ids, 0).to_numpy()
    order = np.lexsort((start[some], text_key[some], ids, none, run[some], gram[some]))
    g, r = gram[some][order], run[some][order]
    again[some[order[1:]]] = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
    return again


def _anchor_rows(docs: DataFrame, length: int, k: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for first, base, data, offsets in _segments(batch, length):
                row, start, n, gram, run = anchors(data, offsets, length, k)
                if len(row):
                    found.append((first + row, start - offsets[row] + base, n, gram, run))
            if not found:
                continue
            row, start, n, gram, run = (np.concatenate(x) for x in zip(*found, strict=True))
            doc_id = batch.column("doc_id").take(pa.array(row))
            text_key = batch.column("text_key").take(pa.array(row))
            again = _again(doc_id, text_key.to_numpy(), start, gram, run)
            yield pa.RecordBatch.from_arrays(
                [
                    doc_id, text_key, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array(gram.view(np.int64)), pa.array(run.view(np.int64)), pa.array(again),
                ],
                names=["doc_id", "text_key", "start", "n", "gram", "run", "again"],
            )

    return docs.mapInArrow(make, _ANCHOR)


def _frequent(docs: DataFrame, length: int, k: int) -> list[int]:
    """Grams of anchors that recur most, as tasks see them; see :data:`FREQUENT`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for _, _, data, offsets in _segments(batch, length):
                gram = anchors(data, offsets, length, k)[3].view(np.int64)
                new, n = np.unique(gram, return_counts=True)
                new, n = new[n > 1], n[n > 1]
                joined = np.concatenate([keys, new])
                n = np.concatenate([counts, n])
                keys, place = np.unique(joined, return_inverse=True)
                counts = np.bincount(place, n, len(keys)).astype(np.int64)
                if len(keys) > FREQUENT:
                    top = np.argsort(-counts, kind="stable")[:FREQUENT]
                    keys, counts = keys[top], counts[top]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "n"])

    seen = docs.select("text").mapInArrow(count, "gram long, n long")
    counts = seen.groupBy("gram").agg(F.sum("n").alias("n")).filter("n >= 1000")
    return sorted(r[0] for r in most_frequent(counts, FREQUENT, "gram-counts"))


_SHARED = "doc_id long, text_key long, start int, n int, gram long, hot boolean, later boolean"


def _shared(found: DataFrame) -> DataFrame:
    """Runs whose anchor occurs more than once; ``later`` if an equal run came earlier.

    Of equal runs that were read together all but the first are ``again``: each task
    hands on one row of them for comparison, however many copies there are.

    The first of equal runs is only kept if the gram has other runs too (or is frequent).
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None
        for batch in batches:
            held = batch if held is None else pa.concat_batches([held, batch])
            gram = held.column("gram").to_numpy()
            if held.column("hot")[-1].as_py():
                end = len(gram)  # all rows of a frequent gram are kept, so it can be cut
            elif gram[0] != gram[-1]:
                end = len(gram) - int((gram[::-1] != gram[-1]).argmax())
            else:
                continue  # the gram may go on in the next batch
            out, last = resolve(held.slice(0, end), last)
            yield out
            held = held.slice(end) if end < len(gram) else None
        if held is not None:
            yield resolve(held, last)[0]

    def resolve(rows: pa.RecordBatch, last: tuple | None) -> tuple[pa.RecordBatch, tuple | None]:
        again = rows.column("again").to_numpy(zero_copy_only=False)
        later, keep = again.copy(), again.copy()
        at = np.flatnonzero(~again)
        if len(at):
            gram, run = rows.column("gram").to_numpy()[at], rows.column("run").to_numpy()[at]
            new_gram = np.ones(len(gram), bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_run = new_gram.copy()
            new_run[1:] |= run[1:] != run[:-1]
            new_run[0] = (gram[0], run[0]) != last
            of = np.cumsum(new_gram) - 1
            several = np.bincount(of, new_run)[of] > 1
            later[at] = ~new_run
            keep[at] = ~new_run | several | rows.column("hot").to_numpy(zero_copy_only=False)[at]
            last = (gram[-1], run[-1])
        names = ["doc_id", "text_key", "start", "n", "gram", "hot"]
        out = pa.RecordBatch.from_arrays(
            [*(rows.column(c) for c in names), pa.array(later)], names=[*names, "later"]
        )
        return out.filter(pa.array(keep)), last

    # Rows that are known to be later ones are only passed on, each where there is room.
    salt = F.when(F.col("again"), F.pmod(F.xxhash64("doc_id", "start"), F.lit(1 << 20)) + 1024)
    salt = salt.when(F.col("hot"), F.pmod(F.col("run"), F.lit(1024))).otherwise(0)
    salted = found.withColumn("salt", salt.cast("int"))
    return (
        salted.repartition("gram", "salt")
        .sortWithinPartitions(
            "gram", "salt", "run", F.asc_nulls_last("doc_id"), "text_key", "start"
        )
        .drop("salt")
        .mapInArrow(scan, _SHARED)
    )


_CONTEXT = "doc_id long, text_key long, start int, n int, gram long, hot boolean, bytes binary"
_SPAN = "doc_id long, text_key long, begin int, end int"


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """The bytes of each run; ``texts`` has the runs of a text as an array ``runs``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, runs, parts, size = [], [], [], 0
            for i in range(batch.num_rows):
                view = memoryview(batch.column("text")[i].as_buffer())
                listed = batch.column("runs")[i].values
                start = listed.field("start").to_numpy()
                end = start + listed.field("n").to_numpy() + length - 1
                parts += [bytes(view[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                rows.append(np.full(len(start), i))
                runs.append(listed)
                size += int((end - start).sum())
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield made(batch, rows, runs, parts)
                    rows, runs, parts, size = [], [], [], 0

    def made(batch, rows, runs, parts) -> pa.RecordBatch:
        take, listed = pa.array(np.concatenate(rows)), pa.concat_arrays(runs)
        names = ["start", "n", "gram", "hot"]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(take),
                batch.column("text_key").take(take),
                *(listed.field(c) for c in names),
                pa.array(parts, pa.binary()),
            ],
            names=["doc_id", "text_key", *names, "bytes"],
        )

    return texts.mapInArrow(cut, _CONTEXT)


_SPANS_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def _merged(spans: pa.ListScalar) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    if not spans.is_valid or not len(spans.values):
        return []
    begin, end = spans.values.field("begin").to_numpy(), spans.values.field("end").to_numpy()
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by])
    new = np.ones(len(begin), bool)
    new[1:] = begin[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(begin)) - 1
    return list(zip(begin[first].tolist(), end[last].tolist(), strict=True))


_RESOLVED = _SPAN + ", w1 long, w2 long"


def _resolved(contexts: DataFrame, length: int) -> DataFrame:
    """Spans found by suffix orders of runs with the same gram.

    Groups of one gram are whole, but for frequent grams, which are dealt out by run:
    strings of these that have no earlier match in their batch are handed on with two
    hashes (w1, w2) to be compared across batches.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while batch.num_rows:
                gram = batch.column("gram").to_numpy()
                hot = batch.column("hot").to_numpy(zero_copy_only=False)
                lengths = batch.column("n").to_numpy() + length - 1
                total = size + np.cumsum(lengths)
                # Cut where the batch is full and a gram ends, or within a frequent one.
                full = total >= BATCH_BYTES
                ends = np.zeros(len(gram), bool)
                ends[:-1] = gram[1:] != gram[:-1]
                cut = np.flatnonzero(full & (ends | hot))
                if not len(cut):
                    held.append(batch)
                    size = int(total[-1])
                    break
                at = int(cut[0]) + 1
                yield from resolve(pa.concat_batches([*held, batch.slice(0, at)]))
                held, size, batch = [], 0, batch.slice(at)
        if held:
            yield from resolve(pa.concat_batches(held))

    def resolve(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        table = pa.table(rows).sort_by(
            [("doc_id", "ascending"), ("text_key", "ascending"), ("start", "ascending")]
        ).combine_chunks()
        # Null ids come last in the order of documents.
        column = {c: table.column(c).combine_chunks() for c in table.column_names}
        body = column["bytes"]
        offsets = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, body.offset * 4)
        data = np.frombuffer(body.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets.astype(np.int64) - offsets[0]
        n = column["n"].to_numpy()
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[row] + within
        earlier = previous_factors(data, starts, length)
        place = column["start"].to_numpy()[row] + within
        r, a, b = _spans(row[earlier], place[earlier], length)
        yield made(column, r, a, b, None, None)
        hot = column["hot"].to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~earlier & hot[row])
        if len(rest):
            at = starts[rest]
            w1 = span_hashes(prefix_sums(data, byte_codes(False)), at, at + length)
            w2 = span_hashes(prefix_sums(data, mix(byte_codes(False))), at, at + length)
            yield made(column, row[rest], place[rest], place[rest] + length, w1, w2)

    def made(column, row, begin, end, w1, w2) -> pa.RecordBatch:
        take = pa.array(row)
        hashes = [
            pa.nulls(len(row), pa.int64()) if w is None else pa.array(w.view(np.int64))
            for w in (w1, w2)
        ]
        return pa.RecordBatch.from_arrays(
            [
                column["doc_id"].take(take), column["text_key"].take(take),
                pa.array(begin.astype(np.int32)), pa.array(end.astype(np.int32)), *hashes,
            ],
            names=["doc_id", "text_key", "begin", "end", "w1", "w2"],
        )

    salted = contexts.withColumn(
        "salt",
        F.when(F.col("hot"), F.pmod(F.xxhash64("bytes"), F.lit(1024))).otherwise(0).cast("int"),
    )
    return (
        salted.repartition("gram", "salt").sortWithinPartitions("gram", "salt").drop("salt")
        .mapInArrow(scan, _RESOLVED)
    )


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 100,
    k: int = 32,
    keep_bytes: bool = True,
) -> DataFrame:
    """Bytes covered by a string of ``length`` bytes that also starts earlier.

    Earlier is a smaller id, or the same document and an earlier start.  The first
    occurrence of every string stays, wherever later ones are cut.

    Every string has an anchor: of its k-grams the one with the smallest hash.  Runs of
    neighbouring strings with one anchor are dealt out by the anchor's gram, so equal
    strings meet.  A run whose bytes all came earlier goes as a whole.  The first ones of
    different runs with the same gram (where a copied passage begins, ends or was edited)
    are put in suffix order, and longest-previous-factor arrays tell which of their
    strings have an earlier match.  Runs of frequent grams are dealt out further, and
    what stays of them is compared by hashes of the strings.

    Columns: doc_id, text_key, n_bytes, n_removed, n_spans (maximal removed runs of bytes),
    spans (array of begin and end), kept_sha256 (of the bytes that stay), kept (these
    bytes, not always valid UTF-8; null without ``keep_bytes``).  Null texts are empty.  Null ids come last.  Rows that
    share id and text are one document.  Other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        text.cast("binary").alias("text"),
    )
    # A row that is there twice is one document, whose places are not earlier than themselves.
    once = rows
    if not rows.groupBy(*KEY).count().filter("count > 1").isEmpty():
        once = stored(rows.dropDuplicates(list(KEY)), "documents-once")
    hot = _frequent(once, length, k)
    found = _anchor_rows(once, length, k)
    spark = docs.sparkSession
    # FREQUENT numbers at most.
    listed = F.broadcast(
        spark.createDataFrame([(g,) for g in hot], "gram long").withColumn("hot", F.lit(True))
    )
    found = found.join(listed, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    shared = stored(_shared(found), "shared-runs")

    later = shared.filter("later").select(
        *KEY, F.col("start").alias("begin"), (F.col("start") + F.col("n") + length - 1).alias("end")
    )
    open_runs = (
        shared.filter("not later").groupBy(*KEY)
        .agg(F.collect_list(F.struct("start", "n", "gram", "hot")).alias("runs"))
    )
    distinct_texts = attach(once, open_runs, KEY, "inner")
    resolved = stored(_resolved(_contexts(distinct_texts, length), length), "resolved")
    done = resolved.filter("w1 is null").select(*KEY, "begin", "end")
    strings = resolved.filter("w1 is not null")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "begin")
    firsts = strings.groupBy("w1", "w2").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    again = (
        strings.join(firsts.filter("n > 1"), ["w1", "w2"]).filter(order != F.col("first"))
        .select(*KEY, "begin", "end")
    )
    spans = (
        later.union(done).union(again).distinct()
        .groupBy(*KEY).agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for i in range(batch.num_rows):
                body = memoryview(batch.column("text")[i].as_buffer())
                merged = _merged(batch.column("spans")[i])
                parts, at = [], 0
                for a, b in merged:
                    parts.append(body[at:a])
                    at = b
                kept = b"".join([*parts, body[at:]])
                rows.append(
                    (i, len(body), len(body) - len(kept), len(merged),
                     [{"begin": a, "end": b} for a, b in merged],
                     hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None)
                )
                size += len(kept) if keep_bytes else 0
                if size >= BATCH_BYTES or i == batch.num_rows - 1:
                    yield made(batch, rows)
                    rows, size = [], 0

    def made(batch, rows) -> pa.RecordBatch:
        i, *columns = zip(*rows, strict=True)
        types = [pa.int64(), pa.int64(), pa.int64(), _SPANS_TYPE, pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(i)),
                batch.column("text_key").take(pa.array(i)),
                *(pa.array(c, t) for c, t in zip(columns, types, strict=True)),
            ],
            names=[
                "doc_id", "text_key", "n_bytes", "n_removed", "n_spans", "spans",
                "kept_sha256", "kept",
            ],
        )

    return attach(rows, spans, KEY, "left").mapInArrow(
        cut,
        "doc_id long, text_key long, n_bytes long, n_removed long, n_spans long, "
        "spans array<struct<begin: int, end: int>>, kept_sha256 string, kept binary",
    )


