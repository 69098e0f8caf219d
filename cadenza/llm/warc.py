"""WARC archives of web pages: a writer with revisit records and a salvage reader.

The writer makes each record as text with DataFrame expressions and writes it by Spark's
text sink, so archives go to any file system Spark writes to and a lost task is written
again under the commit protocol. Of records with equal payloads of at least ``least_bytes``
bytes the one with the largest id is a response, the others are revisits of it.

The reader takes plain archives and archives of gzip members. A record counts if its
headers, lengths, end mark and digests hold. After a failed check it looks for the next
member or version line that starts a valid record, goes on from there, and logs the bytes
between as a gap with the reason.

Nulls: a null payload is empty, a null id or address is left out of the record and comes
back null. Rows that share the largest id of their payload are responses all. An empty
table gives an empty folder of archives, and reading that gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..sources.scratch import materialize

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
_VERSION_LINE = re.compile(rb"WARC/1\.[0-9]+\r\n")
#: Two of these in one head are the heads of two records, the first of them cut.
ONCE = ("warc-type", "warc-record-id", "content-length")

HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
RECORDS_A_FILE = 2000
LEAST_BYTES = 0

RECORD = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("gap", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def base32(hex_sha1: Column) -> Column:
    """Bare upper-case base32 of a 40-digit hexadecimal SHA-1: 5 digits are 4 letters."""
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(hex_sha1, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    """A header line; nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(name + ": "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """``value``: the text of each record without its end mark."""
    payload = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload"))
    groups = rows.groupBy("sha1", "bytes").agg(F.max("id").alias("first_id"), F.count("*").alias("n"))
    groups = materialize(groups.where((F.col("n") > 1) & (F.col("bytes") >= least_bytes)).select("sha1", "first_id"), "repeated")
    # the repeated digests are few; Spark broadcasts them only below its size limit
    rows = rows.join(groups, "sha1", "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    block = F.when(again, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("payload")))
    rows = rows.withColumn("again", again).withColumn("block", block)
    head = F.concat(
        F.lit(VERSION + "\r\n"),
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", urn(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")),
        _line("WARC-Profile", F.when(F.col("again"), REVISIT)),
        _line("WARC-Refers-To", F.when(F.col("again"), urn(F.col("first_id")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        _line("WARC-Payload-Length", F.col("bytes")),
        _line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(F.col("block").cast("binary"))))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length("block")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(head, F.col("block")).alias("value"))


def write_archives(pages: DataFrame, path: str, records_a_file: int = RECORDS_A_FILE, **kw) -> None:
    """Write the archives of ``pages`` into a new folder."""
    records(pages, **kw).write.option("lineSep", END).option("maxRecordsPerFile", records_a_file).text(path)


class _Broken(Exception):
    """Why a record fails its checks."""


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324 (the format's digest)


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The valid record that starts at ``at`` and the position after it."""
    if not (line := _VERSION_LINE.match(data, at)):
        raise _Broken("no version line")
    head = {}
    pos = line.end()
    while True:
        # line by line, so that headers may be of any length and a bad one ends the search
        stop = data.find(b"\r\n", pos)
        if stop < 0:
            raise _Broken("headers don't end")
        if stop == pos:
            break
        name, colon, value = data[pos:stop].partition(b":")
        if not colon:
            raise _Broken("bad header line")
        name = name.strip().lower().decode("utf-8", "replace")
        if name in head and name in ONCE:
            raise _Broken("header repeated")
        head[name] = value.strip().decode("utf-8", "replace")
        pos = stop + 2
    size = head.get("content-length", "")
    if not size.isdecimal():
        raise _Broken("no content length")
    start = pos + 2
    end = start + int(size)
    if end + 4 > len(data) or bytes(data[end : end + 4]) != b"\r\n\r\n":
        raise _Broken("block is cut or has no end mark")
    block = bytes(data[start:end])
    if (said := head.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != _digest(block):
        raise _Broken("block digest differs")
    payload = block
    if head.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    kind = head.get("warc-type")
    said = head.get("warc-payload-digest", "")
    said = said[5:] if said.startswith("sha1:") else ""
    if kind == "response" and said and said != _digest(payload):
        raise _Broken("payload digest differs")
    told = head.get("warc-payload-length", "")
    return {
        "record_type": kind,
        "record_id": head.get("warc-record-id"),
        "target_uri": head.get("warc-target-uri"),
        "refers_to": head.get("warc-refers-to"),
        "payload_bytes": int(told) if kind == "revisit" and told.isdecimal() else len(payload),
        "payload_digest": said or _digest(payload),
        "payload": None if kind == "revisit" else payload,
    }, end + 4


def _member(data: memoryview, at: int) -> tuple[bytes, int, str]:
    """The content of the gzip member at ``at``, the position after it, and what is wrong with
    it; of a member that is cut or broken the content up to there."""
    unzip, out, lo, step = zlib.decompressobj(31), [], at, 1 << 20
    while lo < len(data):
        before = unzip.copy()
        try:
            out.append(unzip.decompress(data[lo : lo + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), lo, f"gzip: {e}"
            unzip, step = before, step >> 5
            continue
        if unzip.eof:
            return b"".join(out), min(lo + step, len(data)) - len(unzip.unused_data), ""
        lo += step
    return b"".join(out), len(data), "gzip member is cut"


class _Marks:
    """The next place of any of some marks; asked in rising order, so each byte is searched
    once for each mark, however many checks fail."""

    def __init__(self, data: bytes, *marks: bytes) -> None:
        self.data, self.found = data, dict.fromkeys(marks, -1)

    def after(self, at: int) -> int:
        for mark, place in self.found.items():
            if place < at:
                place = self.data.find(mark, at)
                self.found[mark] = place if place >= 0 else len(self.data)
        return min(self.found.values())


def _inside(data: bytes) -> Iterator[tuple[int, int, dict | str]]:
    """Begin and end of each valid record of a member's content, and of each gap with its reason."""
    at, lost, why, marks = 0, None, "", _Marks(data, b"WARC/1.")
    while at < len(data):
        try:
            row, after = _record(data, at)
        except _Broken as e:
            if lost is None:
                lost, why = at, str(e)
            at = marks.after(at + 1)
            continue
        if lost is not None:
            yield lost, at, why
            lost = None
        yield at, after, row
        at = after
    if lost is not None:
        yield lost, at, why


def salvage(data: bytes) -> Iterator[dict]:
    """Valid records of an archive in order, and its gaps (``gap`` has the reason).

    Records of a gzip member stand at the member's place, and so do the gaps inside it. Of a
    member that is cut or broken only records before its last bytes count, as its own check
    is missing; the member is a gap besides.
    """
    view, at, lost, why = memoryview(data), 0, None, ""
    marks = _Marks(data, b"WARC/1.", b"\x1f\x8b\x08")
    while at < len(data):
        found: list[dict] = []
        wrong = ""
        if data[at : at + 3] == b"\x1f\x8b\x08":
            inner, after, wrong = _member(view, at)
            for lo, hi, part in _inside(inner):
                if isinstance(part, dict):
                    if not wrong or hi < len(inner):
                        found.append(part)
                elif not wrong:
                    found.append({"gap": f"{part} (bytes {lo} to {hi} of the member's content)"})
            if found and all("gap" in row for row in found):
                found = [{"gap": found[0]["gap"]}]
        else:
            try:
                row, after = _record(data, at)
                found = [row]
            except _Broken as e:
                wrong = str(e)
        if lost is not None and (found or not wrong):
            yield {"position": lost, "length": at - lost, "gap": why}
            lost = None
        for row in found:
            yield row | {"position": at, "length": after - at}
        if wrong:
            if lost is None:
                lost, why = at, wrong
            at = marks.after(at + 1)
        else:
            at = after
    if lost is not None:
        yield {"position": lost, "length": len(data) - lost, "gap": why}


def _read(with_payload: bool):
    kind = pa.schema(
        [(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in RECORD.fields]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for row in salvage(content.as_py()):
                    if not with_payload:
                        row["payload"] = None
                    rows.append(row | {"archive": path.as_py()})
                    size += len(row.get("payload") or b"") + 500
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, kind)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All salvaged records of the archives below ``path``, and the gaps (``gap`` not null)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_read(with_payload), RECORD)
