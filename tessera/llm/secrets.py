"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A run of 20 or more characters of the usual encodings is random where a general vocabulary needs many tokens for it:
``MAX_RATIO`` characters a token or fewer.  Where a whole run is not, its parts between signs are judged: words, for which
the vocabulary has long tokens, and known digests divide it, and what lies between them is judged again.  Letters without
digits, and words with numbers, are judged by their letters alone.  Not tested are known digests, UUIDs and numbers.  A
digest is a hexadecimal string of the length of a common hash where the text before it names it as one ("sha256:", "commit",
"etag=") or it is a part of a path, or where a file name follows as in a list of checksums; elsewhere it is a string like
any other.

Defined results: a null or empty text has no spans.  Offsets are code points, the end exclusive; spans are ordered by
start and then by kind, and spans of different kinds may overlap.  Repeated rows are scanned each.  An empty table gives
an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: Kinds in their order; the first three are the fixed patterns.
KINDS = ("assign", "access", "hex", "random")
MAX_RATIO = 2.2
MASK = "[SECRET]"

#: The patterns of the base kinds.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Stretches in which an access, hex or random span can lie.
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z])", re.I)
#: What stands before a digest: a word for one, or the path or reference that it ends.
NAMED = re.compile(r"(?i:(?<![A-Za-z0-9])(?:md5|sha|sha-?[0-9]{1,3}|digest|checksum|hash|etag|commit|rev|revision|integrity|fingerprint|blob|tree|object)[^A-Za-z0-9]{1,4}|[/@])\Z")
#: What stands behind a digest in a list of checksums.
LISTED = re.compile(r" [ *]\S")
#: A part of a run: a UUID, or characters between signs.
PART = re.compile(rf"(?<![A-Za-z0-9])(?i:{UUID.pattern})|[A-Za-z0-9]+")
WORDS = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[+/_=-]*\Z")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):  # noqa: ANN201  (tiktoken's own class)
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_named(text: str, lo: int, hi: int) -> bool:
    """Whether what is around ``text[lo:hi]`` says that it is a digest."""
    return bool(NAMED.search(text[max(0, lo - 24) : lo]) or LISTED.match(text, hi))


def is_known(text: str, lo: int, hi: int) -> bool:
    """Whether ``text[lo:hi]`` is a UUID, or a digest that is named as one."""
    return bool(UUID.fullmatch(text, lo, hi) or DIGEST.match(text[lo:hi]) and is_named(text, lo, hi))


def is_random(run: str, encode, named: bool = True) -> bool:  # noqa: ANN001
    """``named``: whether a run of a digest's form is one."""
    if UUID.fullmatch(run) or named and DIGEST.match(run) or not re.search("[A-Za-z]", run):
        return False
    if WORDS.match(run) or not re.search("[0-9]", run):
        # Numbers, signs and words of one token say nothing; other letters must be half of the run.
        tokens = {m.start(): len(encode(m[0])) for m in re.finditer("[A-Za-z]+", run)}
        letters = sum(len(m[0]) for m in re.finditer("[A-Za-z]+", run) if tokens[m.start()] > 1)
        return 2 * letters >= len(run) and letters <= MAX_RATIO * sum(n for n in tokens.values() if n > 1)
    return len(run) <= MAX_RATIO * len(encode(run))


def random_strings(text: str, lo: int, hi: int, encode) -> Iterator[tuple[int, int]]:  # noqa: ANN001
    """(start, end) of the random strings in the run ``text[lo:hi]``."""
    parts = [m.span() for m in PART.finditer(text, lo, hi)]
    # Padding and joining signs at the ends are not part of a random string.
    if not parts or parts[-1][1] - parts[0][0] < 20:
        return
    judged = lambda a, b: is_random(text[a:b], encode, is_named(text, a, b))
    if not any(is_known(text, a, b) for a, b in parts) and judged(parts[0][0], parts[-1][1]):
        yield parts[0][0], parts[-1][1]
        return
    stretches: list[list[tuple[int, int]]] = [[]]
    for a, b in parts:
        if is_known(text, a, b) or b - a > MAX_RATIO * len(encode(text[a:b])):
            stretches.append([])
        else:
            stretches[-1].append((a, b))
    for held in stretches:
        i, j = 0, len(held)
        # Dates and counters at the ends do not count, nor do signs of one or two characters where the rest is long enough.
        while i < j and text[slice(*held[i])].isdigit():
            i += 1
        while i < j and text[slice(*held[j - 1])].isdigit():
            j -= 1
        while j - i > 1 and held[i][1] - held[i][0] <= 2 and held[j - 1][1] - held[i + 1][0] >= 20:
            i += 1
        while j - i > 1 and held[j - 1][1] - held[j - 1][0] <= 2 and held[j - 2][1] - held[i][0] >= 20:
            j -= 1
        if i < j and held[j - 1][1] - held[i][0] >= 20 and judged(held[i][0], held[j - 1][1]):
            yield held[i][0], held[j - 1][1]
        else:
            yield from ((a, b) for a, b in held[i:j] if b - a >= 20 and judged(a, b))


def spans(text: str | None, encode) -> list[tuple[str, int, int]]:  # noqa: ANN001
    """(kind, start, end) of every span of a text."""
    text = text or ""
    found: list[tuple[int, int, int]] = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    for run in RUN.finditer(text):
        lo, hi = run.span()
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, lo, hi)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, lo, hi)]
        found += [(a, 3, b) for a, b in random_strings(text, lo, hi, encode)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


def scan(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and spans, an array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode_ordinary
        for batch in batches:
            for lo, hi, texts in slices(batch.columns[1], 4_000_000):
                found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans(x, encode)] for x in texts]
                yield pa.record_batch([batch.columns[0].slice(lo, hi - lo), pa.array(found, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind:string, start:bigint, end:bigint>>")


def listed(found: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by ``MASK``; overlapping spans are masked as one.  A null text stays null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode_ordinary
        for batch in batches:
            for lo, hi, texts in slices(batch.columns[at], 4_000_000):
                clean = pa.array([None if x is None else masked(x, encode) for x in texts], pa.string())
                columns = [clean if k == at else c.slice(lo, hi - lo) for k, c in enumerate(batch.columns)]
                yield pa.record_batch(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def masked(text: str, encode) -> str:  # noqa: ANN001
    parts, done = [], 0
    for _, start, end in spans(text, encode):
        if start >= done:
            parts += [text[done:start], MASK]
        done = max(done, end)
    return "".join(parts) + text[done:] if parts else text
