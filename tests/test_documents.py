import io
import math
import re
import zipfile
import zlib
from collections import Counter
from html import unescape

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import text_index
from tessera.sources import documents, html, uploads

SMALL = "/root/testdata/sf0.001"


def test_docx_paragraphs_and_tables():
    data = uploads.docx_file(["one & two", "", "  三 "], ["a", " ", "b|c"])
    assert documents.docx_text(data) == "one & two\n  三 \na | b|c"
    text, warning = documents.extracted("x.DOCX", b"no zip")
    assert text == "" and warning.startswith("docx_extract_unavailable: ")


def test_pdf_pages_in_their_order():
    assert documents.pdf_text(uploads.pdf_file([["a (b) \\c", "é"], [], ["last"]])) == "a (b) \\c\né\n\n\n\nlast"
    # Objects in a stream, an array of strings with kerning, hexadecimal and UTF-16 strings, a nested tree of pages.
    inner = b"3 0 4 " + str(len(b"<< /Type /Pages /Kids [5 0 R] >> ")).encode() + b" "
    data = zlib.compress(inner + b"<< /Type /Pages /Kids [5 0 R] >> << /Type /Pages /Kids [3 0 R 6 0 R] >>")
    pdf = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 4 0 R >> endobj\n2 0 obj << /Type /ObjStm /N 2 /First " + str(len(inner)).encode() + b" /Filter /FlateDecode >> stream\n" + data + b"\nendstream endobj\n"
    pdf += b"5 0 obj << /Type /Page /Contents [7 0 R 8 0 R] >> endobj\n6 0 obj << /Type /Page /Contents 9 0 R >> endobj\n"
    pdf += b"7 0 obj << >> stream\nBT [(He) -20 (llo)] TJ ET\nendstream endobj\n8 0 obj << >> stream\nBT <FEFF4E2D6587> Tj T* (x\\051\\\ny) Tj ET\nendstream endobj\n9 0 obj << >> stream\nBT <48 69> ' ET\nendstream endobj"
    assert documents.pdf_text(pdf) == "Hello中文\nx)y\n\nHi"
    assert documents.extracted("a.pdf", b"%PDF") == ("", "pdf_extract_unavailable: no PDF header")
    loop = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [2 0 R] >> endobj"
    assert documents.pdf_text(loop) == ""
    many = uploads.pdf_file([[str(k)] for k in range(510)])
    assert documents.pdf_text(many).split("\n\n")[-1] == "499"


def test_files_of_any_kind_and_a_folder(spark, tmp_path):
    for name, data in (("a.txt", "中文".encode("gb18030")), ("b.html", b"<p>x<script>y</script><p>z"), ("c.xyz", b"?"), ("d", b"plain"), ("e.docx", uploads.docx_file(["p"], ["c"])), ("sub/f.pdf", uploads.pdf_file([["q"]]))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["warning"]) for r in documents.read(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("中文", None), "b.html": ("x\nz", None), "c.xyz": ("", "unsupported_file_type: .xyz"), "d": ("plain", None), "e.docx": ("p\nc", None), "f.pdf": ("q", None)}
    rows = spark.createDataFrame([(1, None, None), (2, "x.txt", None), (3, "x.pdf", b""), (4, "x.txt", b"a" * 2_100_000)], "k int, n string, c binary")
    out = documents.texts(rows, "k", "n", "c").orderBy("k").collect()
    assert [(len(r["text"]), r["warning"]) for r in out] == [(0, None), (0, None), (0, "pdf_extract_unavailable: no PDF header"), (2_000_000, None)]
    assert zipfile.is_zipfile(io.BytesIO(uploads.docx_file([], [])))


def plain_search(texts, words, k, phrase):
    split = {d: re.findall(r"[^\W_]+", t.lower()) for d, t in texts}
    n, mean = len(split), sum(map(len, split.values())) / len(split)
    counts = {d: Counter(x) for d, x in split.items()}
    df = {w: sum(c[w] > 0 for c in counts.values()) for w in words}
    out = []
    for d, c in counts.items():
        side = any(split[d][i : i + len(words)] == words for i in range(len(split[d])))
        score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(split[d]) / mean)) for w in set(words) if c[w])
        if score and (side or not phrase):
            out.append((-round(score, 9), d, sum(c[w] for w in set(words))))
    return [(d, -s, h, i) for i, (s, d, h) in enumerate(sorted(out)[:k], 1)]


@pytest.mark.parametrize(("words", "phrase"), [(["the", "of"], False), (["the"], False), (["nothing-such", "zzzz"], False), (["of", "the"], True)])
def test_search_equals_a_full_scan(spark, tmp_path, words, phrase):
    texts = [(r[0], r[1] or "") for r in duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()] + [(-1, "Of the of THE end"), (-2, "")]
    frame = spark.createDataFrame(texts, "doc long, term string")  # a clashing name
    index = text_index.build(frame, "doc", "term", f"{tmp_path}/index")
    got = [(r["doc"], r["relevance"], r["hits"], r["rank"]) for r in text_index.search(index, words, 20, phrase).orderBy("rank").collect()]
    want = plain_search(texts, words, 20, phrase)
    assert [x[0] for x in got] == [x[0] for x in want] and [x[2:] for x in got] == [x[2:] for x in want]
    assert all(abs(a[1] - b[1]) < 1e-6 for a, b in zip(got, want, strict=True))
    plan = index.lookup(words)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan) and "term" in plan.split("PushedFilters")[1][:200]
    assert text_index.search(index, [], 5).collect() == []


def test_articles_of_headings_and_long_paragraphs():
    long = "word " * 10
    page = f"<h1>T</h1><h2>One [编辑]</h2><p>short<p>{long}<b>bold</b></p><table><h2>no</h2><p>{long}</p></table><h3>{'x' * 100}</h3><script>s</script>" + "<h2>n</h2>" * 20
    heads, summary = html.article_of(page)
    assert heads == ["One", *["n"] * 14] and summary == (long + "bold")
    assert html.article_of(f"<p>{'y' * 1000}</p><p>{'z' * 1000}</p><p>{'w' * 90}</p>")[1] == "y" * 1000 + "\n\n" + "z" * 498 + "..."
    assert html.article_of("<div>only <i>this</i></div>") == ([], "only this...") and html.article_of(None) == ([], "")


BLOCKS = "p|div|br|li|tr|h[1-6]|article|section|table|ul|ol|title|td|th"


def plain_words(page):
    """Words of a page by patterns instead of a parser."""
    page = re.sub(r"(?s)<!--.*?-->|<![^>]*>", "", page)
    page = re.sub(r"(?is)<(script|style|noscript|svg|canvas)\b.*?</\1\s*>", "", page)
    page = re.sub(r"(?is)<title\b.*?</title\s*>", "\n", page)
    page = re.sub(rf"(?is)</?(?:{BLOCKS})\b[^>]*>", "\n", page)
    return unescape(re.sub(r"(?s)</?[a-zA-Z][^>]*>", "", page)).split()


def test_every_word_of_every_page_is_read(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").where(F.col("html").isNotNull())
    texts = {r["id"]: r["text"] for r in html.page_texts(pages, "page_id", "html").collect()}
    rows = pages.collect()
    for r in rows:
        assert Counter(w for w in plain_words(r["html"]) if w != "|") == Counter(w for w in texts[r["page_id"]].split() if w != "|")
    assert len(rows) >= 50
