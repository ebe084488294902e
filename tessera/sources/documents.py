"""Texts of uploaded documents by the kind of file: paragraphs and tables of docx, pages of PDF, and plain text in several
encodings.  A file that cannot be read gives a warning, never an error.

The parsers are small: docx is XML in a zip archive; of a PDF the pages' content streams (plain or deflated, objects in streams
too) and their text operators are read, with strings as Latin-1 or UTF-16.  Encrypted files and fonts with codes of their own
give what their strings hold as bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import html

# Pages of a PDF and characters of a text that are read, kinds of text and of markup.
PAGES, LONGEST = 500, 2_000_000
TEXTS, MARKUP = (".txt", ".md", ".csv", ".json", ".html", ".htm", ".xml", ""), (".html", ".htm", ".xml")

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\bT(?:\*|[dDmJj]\b)|['\"]|\bET\b", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def docx_text(content: bytes) -> str:
    """Paragraphs outside tables, and then the tables' rows with their cells between bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{_W}body")
    said = lambda p: "".join(x.text or "" if x.tag == f"{_W}t" else {f"{_W}tab": "\t", f"{_W}br": "\n"}.get(x.tag, "") for x in p.iter())
    out = [x for x in map(said, body.findall(f"{_W}p")) if x]
    for table in body.findall(f"{_W}tbl"):
        for row in table.findall(f"{_W}tr"):
            cells = ["\n".join(map(said, c.findall(f"{_W}p"))).strip() for c in row.findall(f"{_W}tc")]
            out += [" | ".join(c for c in cells if c)] if any(cells) else []
    return "\n".join(out)


def _data(raw: bytes) -> bytes:
    """The stream of an object, inflated where it says so."""
    m = _STREAM.search(raw)
    return b"" if not m else zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in raw[: m.start()] else m[1]


def _string(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        part = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] == b"\n" else m[1])
        data = re.sub(rb"\\([0-7]{1,3}|.)", part, raw[1:-1], flags=re.S)
    return data.decode("utf-16", "replace") if data[:2] in (b"\xfe\xff", b"\xff\xfe") else data.decode("latin-1")


def _page(content: bytes) -> str:
    """What the text operators of a content stream show, with a line for each move to another one."""
    out, held = [], []
    for token in _SHOWN.findall(content):
        if token[:1] in b"(<":
            held.append(_string(token))
            continue
        if token in (b"'", b'"', b"T*", b"Td", b"TD", b"Tm") and out and out[-1] != "\n":
            out.append("\n")
        if token in (b"Tj", b"TJ", b"'", b'"'):
            out += held
        held = []
    return "".join(out).strip("\n")


def pdf_text(content: bytes) -> str:
    if content[:5] != b"%PDF-":
        raise ValueError("no PDF header")
    objects = {int(k): raw for k, raw in _OBJECT.findall(content)}
    for raw in [x for x in objects.values() if b"/ObjStm" in x[:2000]]:
        data, first = _data(raw), int(re.search(rb"/First\s+(\d+)", raw)[1])
        head = [*map(int, data[:first].split())]
        starts = [*head[1::2], len(data) - first]
        objects |= {k: data[first + a : first + b] for k, a, b in zip(head[::2], starts, starts[1:], strict=False)}
    refs = lambda raw, name: [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", (re.search(rb"/" + name + rb"\s*(\[.*?\]|\d+\s+\d+\s+R)", raw, re.S) or [b"", b""])[1])]
    root = next((raw for raw in objects.values() if re.search(rb"/Type\s*/Catalog", raw)), b"")
    todo, seen, pages = refs(root, b"Pages"), set(), []
    while todo and len(pages) < PAGES:
        k = todo.pop(0)
        raw = objects.get(k, b"")
        if k in seen:
            continue
        seen.add(k)
        if re.search(rb"/Type\s*/Pages", raw):
            todo = refs(raw, b"Kids") + todo
        else:
            pages.append(_page(b"\n".join(_data(objects.get(x, b"")) for x in refs(raw, b"Contents"))))
    return "\n\n".join(pages)


def extracted(name: str | None, content: bytes | None) -> tuple[str, str | None]:
    """(text, warning) of a file."""
    suffix, content = re.search(r"(\.[^./\\]*)?$", name or "")[0].lower(), content or b""
    for kind, read in ((".pdf", pdf_text), (".docx", docx_text)):
        if suffix == kind:
            try:
                return read(content), None
            except Exception as e:  # whatever a broken file does to a parser
                return "", f"{kind[1:]}_extract_unavailable: {e}"
    if suffix not in TEXTS:
        return "", f"unsupported_file_type: {suffix}"
    text = html.decoded(content)[0]
    return (html.text_of(text)[1] if suffix in MARKUP else text)[:LONGEST], None


def texts(files: DataFrame, key: str, name: str, content: str) -> DataFrame:
    """(key, name, text, warning) of files; one at a time is held beside its batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, warning = extracted(batch.column(1)[k].as_py(), batch.column(2)[k].as_py())
                yield pa.record_batch([batch.columns[0].slice(k, 1), batch.columns[1].slice(k, 1), pa.array([text], pa.string()), pa.array([warning], pa.string())], names=[key, "name", "text", "warning"])

    kind = files.schema[key].dataType.simpleString()
    return files.selectExpr(f"`{key}`", f"CAST(`{name}` AS STRING) AS name", f"`{content}`").mapInArrow(run, f"`{key}` {kind}, name string, text string, warning string")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text, warning) of the files in a folder and those below it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return texts(files.selectExpr("path", "path AS _name", "content"), "path", "_name", "content")
