import gzip
import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import archives, packing, pieces, queries, secrets
from tessera.llm.word_bpe import WordBpe

LONG = "gate and tower " * 3000
ADDED = ["<|endoftext|>", "<|endoftext|> hi<|startoftext|><|endoftext|>", "a <|ENDOFTEXT|> b", "x<|endoftext|", "Σ<|endoftext|>é", "<|<|endoftext|>|>  <|startoftext|>Ab"]
TEXTS = ["", None, "One small document.", "One small document.", LONG, "İstanbul ΑΣ ΑΣΣ'S <|endoftext|> don't", "\x1c\x85 x\n\ty", "ﬁ J̌ é é \U0001f600", "a" * 5000, *ADDED]
SCHEMA = "doc_id long, text string, id long, row long, packer long, length long"


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(k, t, 1, 2, 3, 4) for k, t in enumerate(texts)], SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))


def test_word_bpe_equals_the_tokenizer(tokenizer):
    fast = WordBpe(queries.tokenizer("word_bpe_49k.json"), limit=5)
    for _ in range(2):
        ids, counts = fast.encode([t or "" for t in TEXTS])
        ends = np.cumsum(counts)
        for t, end, n in zip(TEXTS, ends, counts, strict=True):
            assert ids[end - n : end].tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def test_packing_places_every_piece_once(spark, tokenizer):
    rows = packing.pack(docs(spark), queries.tokenizer("word_bpe_49k.json"), group=3).collect()
    whole = [np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in TEXTS]
    want = {(k, p): (p * 2048, len(w[p * 2048 : (p + 1) * 2048]), zlib.crc32(w[p * 2048 : (p + 1) * 2048])) for k, w in enumerate(whole) for p in range(-(-len(w) // 2048))}
    assert {(r["id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    by = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert by.get(r["sequence_id"], 0) == r["offset"]
        by[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(by.values()) <= 2048
    assert packing.pack(docs(spark, []), queries.tokenizer("word_bpe_49k.json")).count() == 0


def test_repeated_rows_and_rows_without_ids_are_dealt_apart(spark):
    large = (1 << 60) + 1
    docs = spark.createDataFrame([(large, "same text")] * 40 + [(None, "same text")] * 40 + [(None, None)] * 3, "doc_id long, text string").coalesce(2)
    path = queries.tokenizer("word_bpe_49k.json")
    deals = [r["deal"] for r in packing.pieces(docs, path, "doc_id", "text").collect()]
    assert len(set(deals)) > 75
    rows = packing.pack(docs, path, group=20).collect()
    assert Counter(r["id"] for r in rows) == {large: 40, None: 43} and len({(r["sequence_id"], r["offset"]) for r in rows}) == 83


def test_packing_is_near_the_lower_bound(spark):
    rows = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), queries.tokenizer("word_bpe_49k.json"), group=500).collect()
    fill = Counter()
    for r in rows:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= -(-sum(fill.values()) // 2048) + 3


def test_sum_of_squares_chooses_the_smallest_sum():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 13, 120)
    bins, offsets = packing.sum_of_squares(lengths, 12)
    fill = {}
    for n, b, at in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        squares = lambda f: sum(c * c for c in np.bincount([12 - x for x in f.values() if x < 12], minlength=1).tolist())
        options = {x: squares(fill | {x: fill[x] + n}) for x in fill if fill[x] + n <= 12} | {-1: squares(fill | {-1: n})}
        chosen = b if b in fill else -1
        assert options[chosen] == min(options.values()) and fill.get(b, 0) == at
        fill[b] = fill.get(b, 0) + n
    assert sum(fill.values()) == lengths.sum()


def test_secret_spans(spark):
    key = "AKIA" + "Q" * 16
    text = f'é password = "abc123" token:short api_key=abcdef {key}X tail {"0a1b" * 7} deadbeef'
    rows = {r["id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(docs(spark, [text, None, "", "plain words only", LONG, "ſecret=abcdef apiKkey=abcdef"]), *queries.secret_vocabulary()).collect()}
    base = [s for s in rows[0] if s[0] != "random"]
    assert [(k, text[a:b]) for k, a, b in base] == [("assign", 'password = "abc123'), ("assign", "api_key=abcdef"), ("access", key + "X"), ("hex", "0a1b" * 7)]
    assert not any(rows[k] for k in range(1, 6))
    masked = secrets.mask(docs(spark, [text, None]), *queries.secret_vocabulary()).collect()
    assert key not in masked[0]["text"] and masked[0]["text"].startswith("é [SECRET]") and masked[1]["text"] is None


def test_random_strings_and_known_digests():
    encode = secrets.encoder(*queries.secret_vocabulary()).encode_ordinary
    assert secrets.is_random("x9Kq2Zt7Lw4Vb8Rn3Yp6Mf1", encode)
    for known in (hashlib.sha1(b"x").hexdigest(), hashlib.sha256(b"x").hexdigest(), "123e4567-e89b-12d3-a456-426614174000", "my_long_identifier_name_42", "12345678901234567890123"):
        assert not secrets.is_random(known, encode)


def test_random_strings_behind_words_and_without_digits():
    encode = secrets.encoder(*queries.secret_vocabulary()).encode_ordinary
    found = lambda text: [(a, b) for kind, a, b in secrets.spans(text, encode) if kind == "random"]
    rng = np.random.default_rng(7)
    draw = lambda signs, n: "".join(rng.choice(list(signs), n))
    letters = "abcdefghijklmnopqrstuvwxyz"
    for path in ("", "documentation/reference/configuration/", "static/assets/images/products/", "user_profile-id="):
        for signs, n in ((letters + letters.upper() + "0123456789", 20), (letters + letters.upper() + "0123456789", 32), (letters + letters.upper(), 24), (letters, 32)):
            for _ in range(50):
                key = draw(signs, n)
                text = f"see {path}{key} there"
                at = text.index(key)
                assert any(a <= at and b >= at + n for a, b in found(text)), text
                assert key not in secrets.masked(text, encode)
    key = "x9Kq2Zt7Lw4Vb8R/n3Yp6Mf1Qs5"
    words = "documentation/reference/configuration/"
    assert found(words * 2 + key + "/" + words) == [(2 * len(words), 2 * len(words) + len(key))]
    sha = hashlib.sha256(b"x").hexdigest()
    long = (words, "internationalization", "Rechtsschutzversicherungsgesellschaften", "getElementsByTagNameAndClass")
    known = (words * 4 + sha, words * 2 + "123e4567-e89b-12d3-a456-426614174000", "static/assets/images/2024/01/02/12345678", "is_it_to_be_or_is_it_not_to_be_so")
    for text in (*long, *known, "a" * 5000):
        assert found(text) == [], text


def brute_spans(text):
    """The base kinds, character by character."""
    out = []
    value = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"

    def run(i, signs):
        j = i
        while j < len(text) and text[j] in signs:
            j += 1
        return j

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if len(text[i : i + len(word)]) == len(word) and all(x in (c, c.upper()) for x, c in zip(text[i : i + len(word)], word, strict=True)):
                j = i + len(word)
                j = run(j + (text[j : j + 1] in ("'", '"')), " ")
                if text[j : j + 1] in (":", "="):
                    j = run(j + 1, " ")
                    j += text[j : j + 1] in ("'", '"')
                    return j, run(j, value)
        return i, i

    i = 0
    while i < len(text):
        j, end = assign(i)
        if end > j and end - j >= 6:
            out.append((i, 0, end))
        i = max(end, i + 1)
    i = 0
    while i < len(text):
        end = run(i + 4, value[26:62]) if text[i : i + 4] == "AKIA" else i
        if end >= i + 20:
            out.append((i, 1, end))
        i = max(end, i + 1)
    i = 0
    while i < len(text):
        end = run(i, "0123456789abcdef")
        if end >= i + 24:
            out.append((i, 2, end))
        i = max(end, i + 1)
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_base_spans_match_brute_force(spark):
    rng = np.random.default_rng(12)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", '"', "'", " ", "  ", ":", "=", "abcdef", "ab.c/d+", "AKIA", "AKIAQ" + "7" * 14, "QZ09" * 4, "0a1b" * 3, "f" * 24, "deadbeef" * 3, "é", "ſ", "K", "\n", "\t", "x", "-", "_"]
    texts = ["".join(rng.choice(bits, int(rng.integers(1, 40)))) for _ in range(3000)]
    rows = {r["id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(docs(spark, texts), *queries.secret_vocabulary()).collect()}
    for k, text in enumerate(texts):
        assert [s for s in rows[k] if s[0] != "random"] == brute_spans(text), text


def test_random_kind_finds_secrets_and_leaves_prose_and_identifiers(spark):
    encode = secrets.encoder(*queries.secret_vocabulary()).encode_ordinary
    rng = np.random.default_rng(13)
    letters = "abcdefghijklmnopqrstuvwxyz"
    found = lambda text: [(a, b) for kind, a, b in secrets.spans(text, encode) if kind == "random"]
    signs = {"hex": "0123456789abcdef", "letters and digits": letters + letters.upper() + "0123456789", "base64": letters + letters.upper() + "0123456789+/"}
    for kind, alphabet in signs.items():
        hits = 0
        for k in range(300):
            key = "".join(rng.choice(list(alphabet), (24, 32, 40, 64)[k % 4]))
            text = f'the gate {("token = ", "key: ", "")[k % 3]}"{key}" is open'
            at = text.index(key)
            hits += any(a <= at + 4 and b >= at + len(key) - 4 for a, b in found(text))
        assert hits >= 285, kind
    sha1, sha256 = hashlib.sha1(b"a").hexdigest(), hashlib.sha256(b"a").hexdigest()
    for text in (f"sha256:{sha256}", f"commit {sha1}", f'ETag: "{sha1}"', f"http://h/objects/{sha1}", f"{sha256}  notes.txt", f"integrity = {sha1}", "id 123e4567-e89b-12d3-a456-426614174000"):
        assert found(text) == [], text
    assert found(f'token = "{sha1}"') == [(9, 49)]
    prose = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    assert not any(found(t or "") for t in prose)


def test_scan_of_odd_tables(spark):
    vocabulary = queries.secret_vocabulary()
    assert secrets.scan(docs(spark, []), *vocabulary).count() == 0 and secrets.mask(docs(spark, []), *vocabulary).count() == 0
    text = 'token="' + "0a1b2c3d" * 4 + '"'
    rows = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert len({str(r["spans"]) for r in secrets.scan(rows, *vocabulary).collect()}) == 1
    # Three overlapping spans are masked as one.
    assert {r["text"] for r in secrets.mask(rows, *vocabulary).collect()} == {'[SECRET]"'}


def test_space_signs_of_a_text_come_back(spark):
    path = queries.tokenizer("piece_bpe_32k.model")
    texts = ["▁", "a▁b", "▁▁ ▁", " ▁ a", "a b", "▁" * 5000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pieces.decode(pieces.encode(rows, path), path).orderBy("id").collect()
    assert [r["text"] for r in got] == texts
    assert got[0]["n_ids"] == 4  # the space in front and three bytes


def test_pieces_round_trip_and_are_optimal(spark):
    path = queries.tokenizer("piece_bpe_32k.model")
    model = pieces.Pieces(path, limit=3)
    for t in TEXTS:
        assert model.decode(model.encode(t or "")) == (t or "")
    for t in ["gate", "ab\U0001f600c", "  two  spaces ", "tower", "x" * 70]:
        text = pieces.SPACE + t.replace(" ", pieces.SPACE)
        ids = [i for part in model.stream(text) for i in part]
        assert ids == np.frombuffer(model.encode(t), "<u4").tolist()
        best = [0] + [pieces.WORST] * len(text)
        for j in range(1, len(text) + 1):
            for i in range(max(0, j - model.longest), j):
                found = model.scores.get(text[i:j])
                cost = found[0] if found else model.fallback(text[i])[0] if j == i + 1 else None
                if cost is not None:
                    best[j] = max(best[j], best[i] + cost)
        score = {i: s for s, i in model.scores.values()}
        assert sum(score.get(i, model.unknown) for i in ids) == best[-1]
    rows = pieces.decode(pieces.encode(docs(spark), path), path).collect()
    assert {r["id"]: r["text"] for r in rows} == {k: t or "" for k, t in enumerate(TEXTS)}
    assert pieces.encode(docs(spark, []), path).count() == 0


def test_every_character_is_streamed(spark, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    model, seen, stream = pieces.Pieces(queries.tokenizer("piece_bpe_32k.model"), limit=0), [], pieces.Pieces.stream
    monkeypatch.setattr(pieces.Pieces, "stream", lambda self, chars: seen.append(len(chars)) or stream(self, chars))
    monkeypatch.setattr(pieces, "KEPT", 0)
    for t in texts:
        model.encode(t or "")
    assert sum(seen) == sum(len(t) + 1 for t in texts if t)


def test_ids_are_null_safe(spark):
    path = queries.tokenizer("piece_bpe_32k.model")
    rows = spark.createDataFrame([(None, "gate"), (None, None), (1, "gate"), (1, "gate")], "doc_id long, text string")
    got = pieces.decode(pieces.encode(rows, path), path).collect()
    assert sorted((str(r["id"]), r["text"]) for r in got) == [("1", "gate"), ("1", "gate"), ("None", ""), ("None", "gate")]


def test_streaming_commits_before_the_end():
    model = pieces.Pieces(queries.tokenizer("piece_bpe_32k.model"))
    assert sum(1 for part in model.stream(pieces.SPACE.join(["gate"] * 50)) if part) > 10


PAGES = "page_id long, url string, html string, key long, payload_digest string"


def test_archives_round_trip(spark):
    big, odd = "<p>é</p>" * 200, "a\r\n\r\nWARC/1.1\r\n\r\nHTTP/1.0 200\n"
    html = [big, None, "", big, odd, odd, "x" * 999, "x" * 999, big + "!"]
    pages = spark.createDataFrame([(k * 3 % 9, f"http://h/{k} x" if k else None, h, 1, "c") for k, h in enumerate(html)] + [(50, "u", big, 1, "c"), (50, "u", big, 1, "c"), (None, "u", big, 1, "c")], PAGES)
    rows = pages.collect()
    got = archives.read_warc(spark, archives.archive(pages), with_payload=True).collect()
    assert len(got) == len(rows)
    of = {}
    for r in got:
        of.setdefault(r["key"], []).append(r)
    for p in rows:
        raw = (p["html"] or "").encode()
        match = [r for r in of[p["page_id"]] if r["payload_digest"] == hashlib.sha1(raw).hexdigest()]
        assert match and all(r["payload_bytes"] == len(raw) for r in match)
        if p["page_id"] is not None and raw == big.encode():
            assert {(r["record_type"], r["refers_to"]) for r in match} == {("response", None) if p["page_id"] == 50 else ("revisit", 50)}
        else:
            assert {r["record_type"] for r in match} == {"response"} and match[0]["payload"] == raw
    assert len({r["record_id"] for r in got}) == len(got) - 1


def test_archive_files_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(archives, "FILE_BYTES", 3000)
    pages = spark.createDataFrame([(k, "u", "x" * 1200 + str(k), 1, "c") for k in range(20)], PAGES).coalesce(1)
    path = archives.archive(pages)
    files = [[len(b) for _, b in archives.warc_blocks(r["content"])] for r in archives.files_below(spark, path).collect()]
    assert sum(map(len, files)) == 20 and len(files) >= 6 and max(map(len, files)) <= 3
    assert sorted(r["key"] for r in archives.read_warc(spark, path).collect()) == list(range(20))


def test_arc_versions_and_bad_bytes():
    for version in (1, 2):
        data = archives.arc_file([(1, "http://a b/", b"x\n\n"), (None, None, b"")], version)
        for raw in (data, gzip.compress(data)):
            assert [(r[0], r[1], r[5], r[6]) for r in archives.arc_records(raw)] == [(1, "http://a%20b/", 200, b"x\n\n"), (None, "about:blank", 200, b"")]
        with pytest.raises(ValueError, match="cut short"):
            list(archives.arc_records(data[:-5]))
    with pytest.raises(ValueError, match="checksum"):
        list(archives.arc_records(data.replace(b"x\n\n", b"y\n\n")))
    for bad in (b"what is this\n", b"no line feed 5"):
        with pytest.raises(ValueError, match="no ARC header"):
            list(archives.arc_records(bad))


def test_arc_headers_written_by_others():
    """Records as crawlers of the time wrote them: spaces in types and URLs, short dates, other checksums, other statuses."""
    about = b"1 0 Crawler\nURL IP-address Archive-date Content-type Archive-length\n"
    one = b"filedesc://a.arc 0.0.0.0 19990101 text/plain %d\n%s\n" % (len(about), about)
    page = b"HTTP/1.1 404 Not Found\r\nX: y\r\n\r\ngone"
    one += b"http://h/a b 10.0.0.1 19990203040506 text/html; charset=utf-8 %d\n%s\n" % (len(page), page) + b"dns:h 10.0.0.1 1999020304 text/dns 3\nabc\n"
    got = list(archives.arc_records(one))
    assert got == [(None, "http://h/a b", "10.0.0.1", "19990203040506", "text/html; charset=utf-8", 404, b"gone"), (None, "dns:h", "10.0.0.1", "1999020304", "text/dns", 0, b"abc")]
    about = b"2 0 Crawler\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    two = b"filedesc://a.arc 0.0.0.0 19990101 text/plain 200 - - 0 a.arc %d\n%s\n" % (len(about), about)
    two += b"http://h/ 10.0.0.1 19990203040506 text/html; x 301 0a1b2c http://i/ 123456789 a.arc 2\nhi\n"
    assert list(archives.arc_records(two)) == [(None, "http://h/", "10.0.0.1", "19990203040506", "text/html; x", 301, b"hi")]
    record = archives.warc_record(*got[0], len(got[0][-1]), hashlib.sha1(got[0][-1]).hexdigest(), None)
    assert b"HTTP/1.1 404" in record and b"WARC-Date: 1999-02-03T04:05:06Z" in record and archives.iso_date("1999020304") == "1999-02-03T04:00:00Z"


def test_empty_archives(spark):
    assert archives.read_warc(spark, archives.archive(spark.createDataFrame([], PAGES))).count() == 0
