"""Text of HTML pages and of uploaded bytes, by Arrow-batched parsing in the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKIPPED = {"script", "style", "noscript", "svg", "canvas"}
BOILERPLATE = SKIPPED | {"nav", "header", "footer", "aside", "form"}
BLOCKS = {"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "table", "ul", "ol", "title"}
#: The order in which encodings are tried.
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "gbk", "latin-1")
#: Bytes of contents that a task holds as Python objects at once; a longer content is held alone.
SLICE = 4_000_000


class _Text(HTMLParser):
    def __init__(self, skipped: set[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.skipped, self.depth, self.parts, self.title, self.in_title, self.cells = skipped, 0, [], "", False, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.depth += tag in self.skipped
        self.in_title = tag == "title"
        if tag in ("td", "th"):
            self.parts.append(" | " if self.cells else "")
            self.cells += 1
        elif tag in BLOCKS:
            self.cells = 0
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag in self.skipped and self.depth > 0
        self.in_title &= tag != "title"
        if tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        elif not self.depth:
            self.parts.append(data)


def text_of(html: str | None, skipped: set[str] = SKIPPED) -> tuple[str, str]:
    """(title, text): lines without white space around them, blank ones left out."""
    parser = _Text(skipped)
    parser.feed(html or "")
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return " ".join(parser.title.split()), "\n".join(x for x in lines if x)


def each(rows: DataFrame, id_col: str, content_col: str, parse: Callable[[str | bytes | None], tuple], schema: str) -> DataFrame:
    """(id, what ``parse`` makes of the content) of every row, a slice of an Arrow batch after the other."""
    types = pa.schema([("id", pa.int64()), *[(c.split()[0], pa.list_(pa.string()) if c.split()[1] == "array<string>" else pa.string()) for c in schema.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = batch.column("_content")
            ends = np.cumsum(pc.fill_null(pc.binary_length(content), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            lo = 0
            while lo < len(content):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, side="right")))
                out = [parse(x) for x in content.slice(lo, hi - lo).to_pylist()]
                columns = [pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), [*types][1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *columns], schema=types)
                lo = hi

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).alias("_content")).mapInArrow(run, f"id long, {schema}")


def page_texts(pages: DataFrame, id_col: str, html_col: str, boilerplate: bool = False, least_line: int = 0) -> DataFrame:
    """(id, title, text) of whole pages; lines shorter than ``least_line`` go."""
    skipped = BOILERPLATE if boilerplate else SKIPPED

    def parse(page: str | None) -> tuple[str, str]:
        title, text = text_of(page, skipped)
        return title, "\n".join(x for x in text.split("\n") if len(x) >= least_line)

    return each(pages, id_col, html_col, parse, "title string, text string")


def decoded(data: bytes) -> tuple[str, str]:
    """(text, encoding) by the first encoding that fits."""
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise ValueError("latin-1 fits all bytes")


def decode_files(files: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """(id, text, encoding) of binary contents."""

    return each(files, id_col, content_col, lambda x: decoded(x) if x is not None else ("", "utf-8"), "text string, encoding string")


# Headings of an article and characters of one, a paragraph's least and the summary's most characters.
HEADINGS, HEADING, PARAGRAPH, SUMMARY = 15, 100, 40, 1500
EDIT = "[编辑]"


class _Article(HTMLParser):
    """Texts of headings and paragraphs; scripts, styles and tables are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.skip, self.open, self.found, self.rest = 0, [], [], []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "table")
        if tag in ("h2", "h3", "p"):
            if tag == "p":  # a paragraph ends where the next one begins
                self.open = [x for x in self.open if x[0] != "p"]
            self.found.append((tag, []))
            self.open.append(self.found[-1])

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style", "table") and self.skip > 0
        self.open = [x for x in self.open if x[0] != tag]

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.rest.append(data.strip())
            for _, parts in self.open:
                parts.append(data)


def article_of(html: str | None) -> tuple[list[str], str]:
    """(headings, summary) of an article: its first second- and third-level headings, and its longer paragraphs until they are long
    enough; without one, the beginning of all text."""
    if not html:
        return [], ""
    parser = _Article()
    parser.feed(html)
    parser.close()
    told = [(tag, "".join(parts).strip()) for tag, parts in parser.found]
    heads = [x.replace(EDIT, "").strip() for tag, x in told if tag != "p"]
    parts, size = [], 0
    for tag, text in told:
        if tag == "p" and size < SUMMARY and len(text) > PARAGRAPH:
            parts.append(text)
            size += len(text)
    summary = "\n\n".join(parts)
    if len(summary) > SUMMARY:
        summary = summary[:SUMMARY] + "..."
    return [x for x in heads if x and len(x) < HEADING][:HEADINGS], summary or " ".join(x for x in parser.rest if x)[:SUMMARY] + "..."


def articles(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, headings, summary) of pages."""

    return each(pages, id_col, html_col, article_of, "headings array<string>, summary string")
