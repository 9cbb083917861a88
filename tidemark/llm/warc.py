"""WARC archives: a writer with revisit records, and a salvage reader.

The writer forms records as strings, packs each into a gzip member of its own, gathers members to archives of bounded
bytes and lets Spark's text writer store those, so it works on any file system. The reader checks every record (version line, header, length, trailing line ends,
payload digest); after a failure it looks for the next gzip member or version line that begins a valid record, goes on
from there and logs the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ARROW_ROWS, arrow_rows, hot_join, written

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END, _MAGIC, _VERSION = b"\r\n\r\n", b"\x1f\x8b\x08", re.compile(rb"WARC/\d\.\d\r\n")
#: Bytes of an archive at most, unless its one record is larger; a task reads one archive at a time.
ARCHIVE_BYTES = 16 << 20


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of 20 bytes given in hex: 5 hex digits are 4 symbols."""
    out = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(_ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """One WARC record per row as a string column value.

    Of rows with equal payloads of at least ``least`` bytes, those with the largest id are responses and the others revisit
    it; smaller payloads are all responses. Payloads are told apart by SHA-256 and length. A null payload is empty, a null
    uri is left out, and null ids lose against all others. Repeated rows give a record each. An empty table gives no
    records, and other columns play no part.
    """
    rows = pages.select(
        F.col(id_col).alias("id"), F.regexp_replace(F.col(uri_col), r"[\r\n]", " ").alias("uri"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")
    ).select("*", F.octet_length("payload").alias("n"), F.unhex(F.sha2("payload", 256)).alias("key"), F.sha1("payload").alias("sha"))
    per = written(rows.groupBy("key").agg(F.max("id").alias("first"), F.max("n").alias("of"), F.count(F.lit(1)).alias("c")), "payloads")
    joined = hot_join(rows, per, "key", "c", per.agg(F.sum("c")).first()[0] or 0)
    visit = (F.col("c") > 1) & (F.col("n") >= int(least)) & ~F.col("id").eqNullSafe(F.col("first"))
    named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit("\r\n"))
    text = F.concat(
        F.lit("WARC/1.1\r\n"), head("WARC-Type", F.when(visit, "revisit").otherwise("response")), head("WARC-Record-ID", named(F.col("id"))),
        head("WARC-Date", F.lit("2024-01-01T00:00:00Z")), F.coalesce(head("WARC-Target-URI", F.col("uri")), F.lit("")),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha")))), head("WARC-Payload-Length", F.col("n").cast("string")),
        F.when(visit, head("WARC-Refers-To", named(F.col("first")))).otherwise(""), head("Content-Type", F.lit("text/html")),
        head("Content-Length", F.when(visit, "0").otherwise(F.col("n").cast("string"))), F.lit("\r\n"), F.when(visit, "").otherwise(F.col("payload")), F.lit("\r\n\r\n"),
    )
    return joined.select(text.alias("value"))


def _member(record: bytes) -> bytes:
    """A record as a gzip member. Its last byte is 0: from 16 MB on an empty member follows, as sizes end in their high byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    return out if out[-1] == 0 else out + _member(b"")


def write_warc(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **how) -> None:
    """Archives of at most archive_bytes, a gzip member per record. A row of the text writer is an archive: its line
    separator is the last member's last byte; file names end in .txt, as the writer itself doesn't compress."""

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], names=["value"])
        for batch in batches:
            for x in batch.column(0):
                member = _member(x.as_py().encode())
                if held and size + len(member) > archive_bytes:
                    yield flush()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield flush()

    spark = pages.sparkSession
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, arrow_rows(before))
    try:
        packed = records(pages, **how).mapInArrow(archives, "value binary").select(F.col("value").cast("string"))
        packed.write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)
    finally:
        spark.conf.set(ARROW_ROWS, before)


@dataclass
class Salvaged:
    """A record, or the gap that was quarantined (kind 'gap' with a reason); at and end are bytes of the archive."""

    kind: str
    at: int
    end: int
    reason: str = ""
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one(data: bytes, at: int) -> Salvaged | str:
    """The record at a place, or why there is none."""
    if not _VERSION.match(data, at):
        return "no version line"
    body = data.find(_END, at)
    if body < 0:
        return "header has no end"
    headers = {}
    for line in data[at:body].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        return "bad length"
    start = body + 4
    end = start + int(length)
    if data[end : end + 4] != _END:
        return "no line ends after the block"
    payload = data[start:end]
    known = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and known.startswith("sha1:") and known[5:] != _digest(payload):
        return "payload digest differs"
    return Salvaged(headers.get("warc-type", ""), at, end + 4, "", headers, payload)


def _plain(data: bytes) -> Iterator[Salvaged]:
    at = 0
    while at < len(data):
        found = _one(data, at)
        if isinstance(found, Salvaged):
            yield found
            at = found.end
            continue
        there = at + 1
        while (m := _VERSION.search(data, there)) and isinstance(_one(data, m.start()), str):
            there = m.start() + 1
        end = m.start() if m else len(data)
        yield Salvaged("gap", at, end, found)
        at = end


def _unpacked(data: bytes, at: int) -> tuple[bytes, int, str]:
    """All that a gzip member gives before its end or first fault, the place of that, and the fault or ''."""
    unpack, out, k, reason = zlib.decompressobj(31), [], at, ""
    for step in (1 << 16, 1 << 8, 1):
        while k < len(data):
            before = unpack.copy()
            try:
                out.append(unpack.decompress(data[k : k + step]))
            except zlib.error as e:
                reason, unpack = str(e), before
                break
            k = min(k + step, len(data))
            if unpack.eof:
                return b"".join(out), k - len(unpack.unused_data), ""
        else:
            return b"".join(out), k, "gzip member is cut short"
    piece = data[k : k + 1]
    try:
        while x := unpack.decompress(piece, 1):
            out.append(x)
            piece = unpack.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out), k, reason


def _next(data: bytes, member: int, plain: int) -> int:
    """The next place where a valid record begins: a gzip member from one place on, or a version line from another."""
    while (m := _VERSION.search(data, plain)) and isinstance(_one(data, m.start()), str):
        plain = m.start() + 1
    end = m.start() if m else len(data)
    while 0 <= (member := data.find(_MAGIC, member, end)):
        if any(x.kind != "gap" for x in _plain(_unpacked(data, member)[0])):
            return member
        member += 1
    return end


def salvage(data: bytes) -> Iterator[Salvaged]:
    """Records and gaps of an archive, plain or of gzip members with any number of records each; the two may alternate."""
    at = 0
    while at < len(data):
        if data.startswith(_MAGIC, at):
            out, end, reason = _unpacked(data, at)
            # Stored blocks show their records: what was unpacked isn't looked for again as plain text.
            end = _next(data, at + 1, end) if reason else end
            for x in _plain(out):
                yield Salvaged(x.kind, at, end, x.reason, x.headers, x.payload)
            if reason:
                yield Salvaged("gap", at, end, reason)
        elif isinstance(found := _one(data, at), Salvaged):
            yield found
            end = found.end
        else:
            end = _next(data, at, at + 1)
            yield Salvaged("gap", at, end, found)
        at = end


#: Rows of a batch that the reader gives back.
ROWS = 2000
_SCHEMA = "path string, kind string, at bigint, end bigint, reason string, id bigint, uri string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps of all archives below path, one row each.

    kind is the WARC type, or gap: then at, end and reason tell what was quarantined. Length and digest of a response are
    those of the payload read, of a revisit those it states. payload is null unless asked for. No archive gives no rows.
    """
    name = re.compile(r"<urn:page:(-?\d+)>")

    def number(x: str) -> int | None:
        return int(m[1]) if (m := name.fullmatch(x)) else None

    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in _SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for where, content in ((a, b) for batch in batches for a, b in zip(batch.column(0), batch.column(1))):
            rows: list[tuple] = []
            for x in salvage(content.as_py()):
                h, here = x.headers, x.kind not in ("gap", "revisit")
                stated = h.get("warc-payload-length", "")
                rows.append((
                    where.as_py(), x.kind, x.at, x.end, x.reason, number(h.get("warc-record-id", "")), h.get("warc-target-uri"),
                    len(x.payload) if here else int(stated) if stated.isdigit() else None, _digest(x.payload) if here else h.get("warc-payload-digest", "")[5:] or None,
                    number(h.get("warc-refers-to", "")), x.payload if payloads and here else None,
                ))
                if len(rows) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _SCHEMA)


def gaps(found: DataFrame) -> DataFrame:
    """The log of read_warc's gaps: of every archive with one, how many there are, their bytes, and their reasons."""
    lost = found.filter("kind = 'gap'").groupBy("path")
    return lost.agg(F.count(F.lit(1)).alias("gaps"), F.sum(F.col("end") - F.col("at")).alias("bytes"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def whole(found: DataFrame) -> DataFrame:
    """The records of read_warc; a gap is an error, for archives that must be intact."""
    lost = F.raise_error(F.concat(F.lit("gap in "), "path", F.lit(": "), "reason")).cast("boolean")
    return found.filter(F.when(F.col("kind") == "gap", lost).otherwise(True))
