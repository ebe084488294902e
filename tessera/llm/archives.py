"""Web archives: legacy ARC records in, WARC files out, and back again.

An ARC file is a version block, which names the header's fields, and records, each a header line and so many bytes as the
line declares: version 1 has five fields (URL, IP address, date, type, length), version 2 ten (with result code, checksum,
location, offset and file name).  ``arc_records`` parses whichever the version block says, gzipped or not.  ``to_warc``
makes the equivalent WARC records: an identifier derived from the record's URL, date and digest, the date as ISO 8601, the
type, and the payload's SHA-1.  Equal payloads of at least ``LEAST`` bytes are stored once, and the other records revisit
it.  Both kinds of files go through the cluster's file system, gzipped, so that tasks can be repeated on other executors.
A file is closed when it has ``FILE_BYTES`` bytes, so it is longer by one record at most, and is read record by record.

Defined results: a null payload is empty, a null URL is ``about:blank``.  Of equal payloads, the record with the largest
key is the response, and records that repeat that key with that payload are responses too.  Records without a key
come first.  A header line's type, and its URL, may hold spaces.  Bytes that follow no header, a record cut short by the
end of the file, or a SHA-1 in a version 2 header that isn't the record's, raise an error with the offset; checksums of
other kinds are not looked at.  An empty table gives no files and no records.  Other columns are not read, whatever their
names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, stage_table

#: Payloads from so many bytes on are stored once.
LEAST = 1000
#: A file is closed when it has so many bytes before compression.
FILE_BYTES = 64_000_000
#: Numbers of files that a task may take.
FILES = 1_000_000

#: The fields of an ARC header line by version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARC_ROW = "key long, url string, ip string, date string, type string, status int, payload binary"


# ---- ARC


def arc_header(version: int, url: str, body: bytes, offset: int, date: str = "19700101000000") -> bytes:
    line = [url, "0.0.0.0", date, "text/html"]
    if version == 2:
        line += ["200", base64.b32encode(hashlib.sha1(body).digest()).decode(), "-", str(offset), "pages.arc"]
    return " ".join([*line, str(len(body))]).encode() + b"\n"


def safe_url(url: str | None) -> str:
    """The URL without the spaces and control characters that a header line can't hold."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"


def arc_block(version: int) -> bytes:
    """The version block that begins an ARC file, without the line feed that parts records."""
    about = f"{version} 0 example\n{' '.join(ARC_FIELDS[version])}\n".encode()
    return f"filedesc://pages.arc 0.0.0.0 19700101000000 text/plain {'200 - - 0 pages.arc ' if version == 2 else ''}{len(about)}\n".encode() + about


def arc_record(version: int, key: int | None, url: str | None, payload: bytes, offset: int) -> bytes:
    """A record, stored as an HTTP response, without the line feed that parts records."""
    body = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if key is None else b"X-Key: %d\r\n" % key) + b"\r\n" + payload
    return arc_header(version, safe_url(url), body, offset) + body


def arc_file(rows: Iterable[tuple[int | None, str | None, bytes]], version: int) -> bytes:
    """An ARC file of records (key, url, payload)."""
    out = arc_block(version) + b"\n"
    for key, url, payload in rows:
        out += arc_record(version, key, url, payload, len(out)) + b"\n"
    return out


def arc_line(version: int) -> re.Pattern[str]:
    """A header line: the date tells where URL and address end, the fields behind the type are counted from the line's end."""
    return re.compile(r"(.*?) (\S+) (\d{8,14}) (.*)" + r" (\S+)" * (len(ARC_FIELDS[version]) - 5) + r" (\d+)")


def arc_records(data: bytes) -> Iterator[tuple[int | None, str, str, str, str, int, bytes]]:
    """(key, url, ip, date, type, status, payload) of each record of an ARC file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, fields, pattern = 0, None, re.compile(r".* (\d+)")
    while at < len(data):
        end = data.find(b"\n", at)
        line = pattern.fullmatch(data[at : max(end, at)].decode("utf-8", "replace"))
        if line is None:
            raise ValueError(f"no ARC header at byte {at}")
        start, stop = end + 1, end + 1 + int(line.groups()[-1])
        if stop > len(data):
            raise ValueError(f"ARC record at byte {at} is cut short")
        block = data[start:stop]
        if fields is None:
            version, names = int(block.split(b" ")[0]), block.split(b"\n")[1].decode().split(" ")
            if names != ARC_FIELDS.get(version):
                raise ValueError(f"ARC version {version} with fields {names}")
            fields, pattern = names, arc_line(version)
        else:
            r = dict(zip(fields, line.groups(), strict=True))
            check = r.get("Checksum", "").removeprefix("sha1:")
            if re.fullmatch("[A-Z2-7]{32}", check) and base64.b32decode(check) != hashlib.sha1(block).digest():
                raise ValueError(f"ARC record at byte {at} isn't what its checksum says")
            head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            told = r.get("Result-code", "")
            status = int(told) if told.isdigit() and int(told) else int(head[9:12]) if head[9:12].isdigit() else 0
            key = re.search(rb"(?im)^X-Key: (-?\d+)\r?$", head)
            yield (int(key[1]) if key else None, r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], status, payload)
        # Records are parted by a line feed.
        at = stop + 1 if data[stop : stop + 1] == b"\n" else stop


FILED = "file long, nth long, record binary"


def filed(items: Iterable, render: Callable[[tuple, int, int], list[bytes]], gap: int, most: int) -> Iterator[pa.RecordBatch]:
    """(file, nth, record) of a task's items.  ``render(item, file, offset)`` gives the records of an item that comes at an
    offset of a file, which is 0 at its beginning; ``gap`` bytes follow each, and a file ends at ``most`` bytes or more.  Numbers of files follow from the task's, so a
    task that is run again writes the same ones."""
    file, offset, nth, held, size = TaskContext.get().partitionId() * FILES, 0, 0, [], 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "nth", "record"])

    for item in items:
        if offset >= most:
            file, offset, nth = file + 1, 0, 0
        for record in render(item, file, offset):
            held.append((file, nth, record))
            offset, nth, size = offset + len(record) + gap, nth + 1, size + len(record)
        if size > 4_000_000:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def write_files(records: DataFrame, path: str, between: str) -> None:
    """Write (file, nth, record) as gzipped files below ``path``, with ``between`` behind each record.

    Spark's text writer takes bytes in a string column as they are, and its committer makes lost tasks harmless."""
    rows = records.sortWithinPartitions("file", "nth").select(F.col("record").cast("string").alias("value"), "file")
    rows.write.partitionBy("file").option("lineSep", between).option("compression", "gzip").text(path)


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, of which one slice at a time is held as Python values."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 8):
            yield from zip(*(c.slice(lo, 8).to_pylist() for c in batch.columns), strict=True)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Pages as ARC files below ``path``, of version 1 and 2 by turns."""

    def render(page: tuple, file: int, offset: int) -> list[bytes]:
        version, (key, url, html) = 1 + file % 2, page
        begin = [] if offset else [arc_block(version)]
        return [*begin, arc_record(version, key, url, (html or "").encode(), offset or len(begin[0]) + 1)]

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    most = FILE_BYTES
    write_files(rows.mapInArrow(lambda batches: filed(rows_of(batches), render, 1, most), FILED), path, "\n")


def files_below(spark: SparkSession, path: str) -> DataFrame:
    """(content) of the files below ``path``."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")


def in_batches(rows: Iterable[tuple], kinds: list[pa.DataType], names: list[str], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total > 4_000_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
            held, total = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names=names)


def read_arc(files: DataFrame) -> DataFrame:
    """The records of ARC files (content binary), such as ``files_below`` gives."""
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.binary()]
    names = [x.split()[0] for x in ARC_ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (record for batch in batches for content in batch.columns[0] for record in arc_records(content.as_py()))
        return in_batches(rows, kinds, names, lambda r: len(r[-1]) + 200)

    return files.select("content").mapInArrow(run, ARC_ROW)


# ---- WARC


def with_digests(records: DataFrame) -> DataFrame:
    """``records`` with payload_bytes and payload_digest (lower-case hex SHA-1)."""
    return records.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})


def responses(records: DataFrame) -> DataFrame:
    """(payload_digest, payload_bytes, keeper) of payloads of at least LEAST bytes that several records have."""
    large = records.select("key", "payload_bytes", "payload_digest").where(F.col("payload_bytes") >= LEAST)
    return large.groupBy("payload_digest", "payload_bytes").agg(F.max("key").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def to_warc(records: DataFrame) -> DataFrame:
    """(file, nth, record) for ARC records: each a whole WARC record without the blank lines that end it.

    Revisits and their responses are found from digests alone; payloads are read again where they are, and are shuffled
    once, by key, which is unique and so never hot."""
    records = with_digests(records)
    marks = stage_table(records.select("key", "payload_bytes", "payload_digest"), "digests")
    refers = marks.join(responses(marks), ["payload_digest", "payload_bytes"]).where("key IS NOT NULL AND key <> keeper")
    refers = stage_table(refers.select("key", F.col("payload_digest").alias("of"), "keeper").distinct(), "revisits")
    same = (records["key"] == refers["key"]) & (records["payload_digest"] == refers["of"])
    joined = records.join(refers.hint("shuffle_hash"), same, "left").select(records["key"], "url", "ip", "date", "type", "status", "payload", "payload_bytes", "payload_digest", "keeper")
    most = FILE_BYTES
    return joined.mapInArrow(lambda batches: filed(rows_of(batches), lambda row, file, offset: [warc_record(*row)], 4, most), FILED)


def record_id(url: str, date: str, digest: str, key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def iso_date(date: str) -> str:
    d = (date + "19700101000000"[len(date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(key: int | None, url: str, ip: str, date: str, kind: str, status: int, payload: bytes, size: int, digest: str, keeper: int | None) -> bytes:
    http = f"HTTP/1.1 {status or 200} OK\r\nContent-Type: {kind}\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if keeper is not None else http + payload
    sha1 = lambda x: "sha1:" + base64.b32encode(x).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if keeper is None else 'revisit'}", f"WARC-Record-ID: {record_id(url, date, digest, key)}",
        f"WARC-Date: {iso_date(date)}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: {sha1(bytes.fromhex(digest))}",
        f"WARC-Block-Digest: {sha1(hashlib.sha1(block).digest())}", f"X-Payload-Length: {size}",
    ]
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    if keeper is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Key: {keeper}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block


def write_warc(records: DataFrame, path: str) -> None:
    """Write records (file, nth, record) as gzipped WARC files below ``path``; two line breaks end a WARC record."""
    write_files(records, path, "\r\n\r\n")


def warc_blocks(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file, gzipped or not."""
    raw = io.BytesIO(content)
    f = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := f.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC header: {line[:60]!r}")
        fields: dict[str, str] = {}
        while (line := f.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = f.read(int(fields["content-length"]))
        if len(block) != int(fields["content-length"]) or f.read(4) != b"\r\n\r\n":
            raise ValueError(f"WARC record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The records of the WARC files below ``path``: key, url, date, record_id, record_type, refers_to, payload_bytes,
    payload_digest, and payload if asked for (null for revisits).  A payload that its digest or length contradicts is an
    error."""
    schema = "key long, url string, date string, record_id string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def row(h: dict[str, str], block: bytes) -> tuple:
        number = lambda name: int(h[name]) if name in h else None
        digest, size = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex(), number("x-payload-length")
        payload = None
        if h["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"the payload of {h['warc-record-id']} isn't the one that was written")
        return (number("x-record-key"), h["warc-target-uri"], h["warc-date"], h["warc-record-id"], h["warc-type"], number("x-refers-to-key"), size, digest, payload if with_payload else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row(fields, block) for batch in batches for content in batch.columns[0] for fields, block in warc_blocks(content.as_py()))
        return in_batches(rows, kinds, names, lambda r: len(r[-1] or b"") + 500)

    out = files_below(spark, path).mapInArrow(run, schema)
    return out if with_payload else out.drop("payload")


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> str:
    """Pages as legacy ARC files, those converted to WARC files; the folder of the latter."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc, id_col, url_col, html_col)
    write_warc(to_warc(read_arc(files_below(spark, arc))), warc)
    return warc
