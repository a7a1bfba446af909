"""WARC archives: writing pages, and a reader that salvages what damaged files still hold."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import stored

#: Payloads from this size on are written once; smaller ones as often as they come.
MIN_REVISIT = 1000
#: Bytes of an archive file, which the reader takes as one value.
FILE_BYTES = 1 << 27
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EOL = "\r\n"


def _header(name: str, value: Column) -> Column:
    """A header line; null values give none, line breaks within values are escaped."""
    plain = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), plain, F.lit(_EOL)), F.lit(""))


def warc_records(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """``(record)``: one WARC record a row, without its last line break.

    Of records with equal payloads (SHA-256 and length) of :data:`MIN_REVISIT` bytes or
    more, that with the largest id is a response and the others revisit it.  Null
    payloads are empty; rows without id can only revisit, unless no equal one has an id;
    repeated rows of the largest id are responses.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"),
    ).select("*", F.octet_length("payload").alias("n"), F.sha2("payload", 256).alias("sha256"))
    held = stored(
        rows.filter(F.col("n") >= MIN_REVISIT)
        .groupBy("sha256", "n").agg(F.max("id").alias("response_id"), F.count(F.lit(1)).alias("c"))
        .filter("c > 1 and response_id is not null").drop("c"),
        "responses",
    )
    rows = rows.join(held, ["sha256", "n"], "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("response_id"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{_EOL}Content-Type: text/html; charset=utf-8{_EOL}Content-Length: "),
        F.col("n").cast("string"),
        F.lit(_EOL + _EOL),
        F.col("payload"),
    )
    block = F.when(revisit, F.lit("")).otherwise(http)
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.concat(F.lit("none-"), F.sha1("payload"))), F.lit(">"))
    refers = F.concat(F.lit("<urn:page:"), F.col("response_id").cast("string"), F.lit(">"))
    rows = rows.select("*", block.alias("block"), revisit.alias("revisit"))
    return rows.select(
        F.concat(
            F.lit(f"WARC/1.1{_EOL}"),
            _header("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
            _header("WARC-Record-ID", name),
            _header("WARC-Target-URI", F.col("url")),
            _header("WARC-Date", F.lit(date)),
            _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
            _header("WARC-Refers-To", F.when(F.col("revisit"), refers)),
            _header("WARC-Profile", F.when(F.col("revisit"), F.lit(_REVISIT_PROFILE))),
            _header("X-Page-ID", F.col("id")),
            _header("X-Payload-Length", F.col("n")),
            F.lit(f"Content-Type: application/http; msgtype=response{_EOL}Content-Length: "),
            F.octet_length("block").cast("string"),
            F.lit(_EOL + _EOL),
            F.col("block"),
            F.lit(_EOL),
        ).alias("record")
    )


def write_warc(records: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Writes records as WARC files with Spark's text writer, whose line separator ends them.

    A file takes records of its task as long as they have ``file_bytes`` together; a longer
    record stands alone.  Numbered folders keep the files of a task apart.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, at = 0, 0
        for batch in batches:
            files = []
            for n in pc.binary_length(batch.column("record")).to_pylist():
                if size and size + n > file_bytes:
                    at, size = at + 1, 0
                size += n + len(_EOL)
                files.append(at)
            yield batch.append_column("file", pa.array(files, pa.int32()))

    numbered = records.select("record").mapInArrow(number, "record string, file int")
    numbered.write.option("lineSep", _EOL).partitionBy("file").text(path)


_ENTRY = pa.schema(
    [
        ("path", pa.string()), ("kind", pa.string()), ("offset", pa.int64()),
        ("length", pa.int64()), ("reason", pa.string()), ("warc_type", pa.string()),
        ("headers", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()),
        ("payload_sha1", pa.string()), ("payload", pa.binary()),
    ]
)
_ENTRY_SQL = (
    "path string, kind string, offset long, length long, reason string, warc_type string, "
    "headers map<string, string>, payload_bytes long, payload_sha1 string, payload binary"
)
_VERSION = re.compile(rb"WARC/(?:0\.1[78]|1\.[01])\r?\n")
_LINE = re.compile(rb"(?:^|(?<=\n))" + _VERSION.pattern)


def _record_at(data: bytes, at: int) -> dict | str:
    """The record that starts at ``at``, or what is wrong with it."""
    version = _VERSION.match(data, at)
    if not version:
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "no end of header"
    headers = {}
    for line in data[version.end() : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.strip().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    lower = {k.lower(): v for k, v in headers.items()}
    length = lower.get("content-length", "")
    if not length.isdigit():
        return "no length"
    start, stop = end + 4, end + 4 + int(length)
    if stop > len(data):
        return "cut off"
    if data[stop : stop + 4] != b"\r\n\r\n":
        return "no end of record"
    payload = data[start:stop]
    if lower.get("content-type", "").startswith("application/http"):
        head, gap, body = payload.partition(b"\r\n\r\n")
        payload = body if gap else payload
    sha1 = hashlib.sha1(payload).hexdigest()
    kind = lower.get("warc-type", "")
    told = lower.get("warc-payload-digest", "").lower()
    if kind != "revisit" and told.startswith("sha1:") and told != f"sha1:{sha1}":
        return "wrong digest"
    return {
        "end": stop + 4, "warc_type": kind, "headers": list(headers.items()),
        "payload_bytes": len(payload), "payload_sha1": sha1, "payload": payload,
    }


def salvage_plain(data: bytes) -> Iterator[dict]:
    """Records and gaps of an uncompressed archive, in order, covering every byte.

    After a failed check the search goes on at the next version line behind the one
    that failed, so a wrong length costs one record, not those it reaches into.
    """
    at, gap, reason = 0, None, None
    while at < len(data):
        found = _record_at(data, at)
        if isinstance(found, dict):
            if gap is not None:
                yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": reason}
                gap = None
            end = found.pop("end")
            yield {"kind": "record", "offset": at, "length": end - at, **found}
            at = end
            continue
        if gap is None:
            gap, reason = at, found
        later = _LINE.search(data, at + 1)
        at = later.start() if later else len(data)
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": reason}


_MAGIC = b"\x1f\x8b\x08"


def _until_error(member, chunk: bytes) -> tuple[list[bytes], int]:
    """What a decompressor gives before ``chunk`` fails, and the bytes that it takes before that."""
    parts, used, step = [], 0, len(chunk)
    step = 1 << step.bit_length()
    while step > 1:
        step //= 2
        trial = member.copy()
        try:
            parts.append(trial.decompress(chunk[used : used + step]))
        except zlib.error:
            continue
        member, used = trial, min(used + step, len(chunk))
    try:  # the byte that fails may end other codes first
        rest = chunk[used : used + 1]
        while out := member.decompress(rest, 1):
            parts.append(out)
            rest = member.unconsumed_tail
    except zlib.error:
        pass
    return parts, used


def _member_at(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content of a gzip member as far as it can be read, where that ends, what is wrong."""
    member, parts = zlib.decompressobj(31), []
    while at < len(data) and not member.eof:
        before, chunk = member.copy(), data[at : at + 65536]
        try:
            parts.append(member.decompress(chunk))
        except zlib.error as e:
            more, used = _until_error(before, chunk)
            return b"".join([*parts, *more]), at + used, str(e)
        at += 65536
    end = min(at, len(data)) - len(member.unused_data)
    return b"".join(parts), end, None if member.eof else "cut off"


def _next_place(data: bytes) -> Callable[[int], int]:
    """The next gzip member or version line from a place on; places must not fall.

    What follows a broken member or a hole need not begin a line.
    """
    held = [-1, -1]

    def find(at: int) -> int:
        if held[0] < at:
            held[0] = found if (found := data.find(_MAGIC, at)) >= 0 else len(data)
        if held[1] < at:
            held[1] = m.start() if (m := _VERSION.search(data, at)) else len(data)
        return min(held)

    return find


def salvage_members(data: bytes) -> Iterator[dict]:
    """Records and gaps of an archive of gzip members, of plain records, or of both.

    A member gives what can be read of it, with its records and gaps as in
    :func:`salvage_plain`; their offset and length are those of the member.  After a
    failed check the search goes on at the next member or version line, whichever comes
    first, whatever the file begins with.
    """
    find = _next_place(data)
    at, gap, reason = 0, None, None
    known: set[bytes] = set()  # records of failed members, whose stored bytes may show them again
    until = 0
    while at < len(data):
        if data.startswith(_MAGIC, at):
            body, end, wrong = _member_at(data, at)
            if any(e["kind"] == "record" for e in salvage_plain(body)):
                if gap is not None and gap < at:
                    yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": reason}
                gap, told = None, False
                for e in salvage_plain(body):
                    told |= e["kind"] == "gap"
                    if wrong is not None and e["kind"] == "record":
                        raw = body[e["offset"] : e["offset"] + e["length"]]
                        known.add(hashlib.sha1(raw).digest())
                    yield {**e, "offset": at, "length": end - at}
                if wrong is not None:
                    if not told:
                        yield {"kind": "gap", "offset": at, "length": end - at, "reason": wrong}
                    gap, reason, until = end, wrong, end
            elif gap is None:
                first = next((e["reason"] for e in salvage_plain(body)), "empty")
                gap, reason = at, wrong or first
            if wrong is None:
                at = end
                continue
        else:
            found = _record_at(data, at)
            if isinstance(found, dict):
                end = found.pop("end")
                again = end <= until and hashlib.sha1(data[at:end]).digest() in known
                if not again:
                    if gap is not None and gap < at:
                        yield {"kind": "gap", "offset": gap, "length": at - gap, "reason": reason}
                    gap = None
                    yield {"kind": "record", "offset": at, "length": end - at, **found}
                at = end
                continue
            if gap is None:
                gap, reason = at, found
        at = find(at + 1)
    if gap is not None and gap < len(data):
        yield {"kind": "gap", "offset": gap, "length": len(data) - gap, "reason": reason}


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives below ``path``, plain or of gzip members.

    A row for each record (kind ``record``) and each byte range that holds none (kind
    ``gap``, with the first reason): path, offset, length, warc_type, headers,
    payload_bytes, payload_sha1, payload (null without ``payloads``).  A record counts if
    its version line, header, length, end and SHA-1 digest (where one is given) are
    right; a revisit has no payload to check.  A file is read as one value, which Spark
    limits to 2 GB.  Empty files give no rows.
    """

    def salvage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                data, rows, size = content.as_py(), [], 0
                for e in salvage_members(data):
                    if not payloads:
                        e.pop("payload", None)
                    rows.append({"path": name.as_py(), **e})
                    size += e.get("payload_bytes", 0) + 1024
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, _ENTRY)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ENTRY)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(salvage, _ENTRY_SQL)
