"""Files that arrive in numbered parts, tables of one archive written part by part, and documents written as files."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import json_lines


def progress(parts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(upload, received, uploaded_bytes, progress, status, missing) of tasks (upload, total_parts) from their parts (upload, part,
    content binary); a part that came twice counts once, parts beyond the total not at all.  ``missing`` has the first ten
    part numbers that have not come."""
    seen = parts.groupBy("upload", "part").agg(F.max(F.octet_length("content")).alias("size"))
    seen = seen.join(tasks, "upload").where("part >= 0 AND part < total_parts")
    got = seen.groupBy("upload").agg(F.count(F.lit(1)).alias("received"), F.sum("size").alias("uploaded_bytes"), F.sort_array(F.collect_list("part")).alias("_parts"))
    rows = tasks.join(got, "upload", "left")
    n, total = F.coalesce("received", F.lit(0)), F.col("total_parts")
    lacking = F.slice(F.array_except(F.sequence(F.lit(0).cast("long"), total.cast("long") - 1), F.coalesce(F.transform("_parts", lambda x: x.cast("long")), F.array().cast("array<bigint>"))), 1, 10)
    return rows.select(
        "upload", n.cast("long").alias("received"), F.coalesce("uploaded_bytes", F.lit(0)).cast("long").alias("uploaded_bytes"), F.least(F.lit(100), F.floor(n * 100 / total)).cast("long").alias("progress"),
        F.when(n >= total, "UPLOADED").otherwise("UPLOADING").alias("status"), F.when(n < total, lacking).otherwise(F.array().cast("array<bigint>")).alias("missing"),
    )


def assembled(parts: DataFrame, tasks: DataFrame) -> DataFrame:
    """(upload, content) of the complete uploads: the bytes of their parts in order.  Of a part that came twice, the last in
    ``arrival`` counts, of several at once the largest."""
    last = parts.groupBy("upload", "part").agg(F.max(F.struct("arrival", "content"))["content"].alias("content")).join(tasks, "upload").where("part >= 0 AND part < total_parts")
    hexes = F.transform(F.sort_array(F.collect_list(F.struct("part", F.hex("content").alias("h")))), lambda x: x["h"])
    whole = last.groupBy("upload", "total_parts").agg(hexes.alias("h")).where(F.size("h") == F.col("total_parts"))
    return whole.select("upload", F.unhex(F.array_join("h", "")).alias("content"))


def write_parts(rows: DataFrame, path: str, order: str, parts: int = 16) -> None:
    """An archive's rows as JSON Lines in ``parts`` files at most, each a range of ``order``, so that the files in order of name are
    the rows in order."""
    rows.repartitionByRange(parts, order).sortWithinPartitions(order).write.json(path)


def read_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return json_lines.read_jsonl(spark, path, schema)


def docx_file(paragraphs: list[str], cells: list[str]) -> bytes:
    """A small docx file of paragraphs and one row of a table."""
    said = lambda x: f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>'
    row = "".join(f"<w:tc>{said(c)}</w:tc>" for c in cells)
    body = "".join(map(said, paragraphs)) + f"<w:tbl><w:tr>{row}</w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def pdf_file(pages: list[list[str]]) -> bytes:
    """A small PDF file of pages of lines (Latin-1), each a deflated content stream."""
    n, parts = len(pages), []
    kids = " ".join(f"{3 + 2 * k} 0 R" for k in range(n))
    parts += [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj", f"2 0 obj << /Type /Pages /Kids [{kids}] /Count {n} >> endobj".encode()]
    for k, lines in enumerate(pages):
        shown = [x.translate({40: r"\(", 41: r"\)", 92: r"\\"}) for x in lines]
        raw = zlib.compress(("BT /F1 12 Tf 50 700 Td " + " ".join(f"({x}) Tj 0 -14 Td" for x in shown) + " ET").encode("latin-1", "replace"))
        parts.append(f"{3 + 2 * k} 0 obj << /Type /Page /Parent 2 0 R /Contents {4 + 2 * k} 0 R >> endobj".encode())
        parts.append(f"{4 + 2 * k} 0 obj << /Length {len(raw)} /Filter /FlateDecode >> stream\n".encode() + raw + b"\nendstream endobj")
    return b"%PDF-1.4\n" + b"\n".join(parts) + b"\n%%EOF"


def as_files(docs: DataFrame) -> DataFrame:
    """(doc_id, name, content) of documents as uploads: docx, text, an unknown kind, a broken docx and PDF in turn."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                kind, text = int(r.doc_id) % 5, r.text or ""
                name = f"{r.doc_id}{('.docx', '.TXT', '.exe', '.docx', '.pdf')[kind]}"
                content = docx_file(text.split("\n"), [r.lang, r.source]) if kind == 0 else pdf_file([[f"doc {r.doc_id}", f"({r.lang})"], [r.source]]) if kind == 4 else text.encode()
                out.append((r.doc_id, name, content))
            yield pd.DataFrame(out, columns=["doc_id", "name", "content"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", "lang", "source").mapInPandas(run, "doc_id long, name string, content binary")
