"""Periodic runs of words, found by bit-parallel comparison of a text with itself at every lag.

The ids of a text's words are bit planes: bit i of plane k is bit k of the id of word i, in one big integer a plane.  For a
lag p the planes are XORed with themselves p places further and the mismatches ORed; a stretch of L words with period p is a
stretch of L - p zeros.  Shift-doubling AND of the matches leaves a bit only where a stretch is long enough, so a lag
without one is left after the first planes.  What is left is widened to maximal stretches, and one whose period is a
multiple of that of a run around it is that run, not another.

Texts of over ``DIRECT`` words are not compared at every lag: a run with period p in [P, 2P) and at least three periods holds
a whole block of P words, counted from the text's start, and that block again p further.  So lags of equal block hashes are
the only ones that can have a run; each of those is then compared as above.  The work grows with n log n instead of n^2.

Defined results: a null or empty text, and one without a run, has no runs and null figures.  Words are maximal stretches of
``[^\\x20\\x09-\\x0D]``, compared as they stand.  Runs of different periods may overlap.  Repeated rows are scanned each.  An
empty table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

#: A run has at least so many words and so many periods.
LEAST = 24
PERIODS = 3
#: Texts of at most so many words are compared at every lag.
DIRECT = 1500

#: (start, length, period)
Run = tuple[int, int, int]


def word_ids(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def planes(ids: np.ndarray) -> list[int]:
    """The bit planes of ``ids`` as big integers, the lowest bit first."""
    return [int.from_bytes(np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for k in range(max(1, int(ids.max()).bit_length()))]


def long_stretches(bits: int, width: int) -> int:
    """The first places of all stretches of ``width`` ones: ANDed with itself at doubling distances."""
    have = 1
    while bits and have < width:
        step = min(have, width - have)
        bits &= bits >> step
        have += step
    return bits


def stretches(starts: int, n: int) -> Iterator[tuple[int, int]]:
    """(first, last) of the stretches of ones among ``n`` bits."""
    bits = np.unpackbits(np.frombuffer(starts.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")
    edges = np.diff(bits.astype(np.int8), prepend=0, append=0)
    return zip(np.flatnonzero(edges > 0).tolist(), (np.flatnonzero(edges < 0) - 1).tolist(), strict=True)


def at_lag(bit_planes: list[int], n: int, p: int) -> Iterator[Run]:
    """The maximal stretches of period ``p`` (not always the smallest one) that are long enough for a run."""
    width = max(LEAST, PERIODS * p) - p
    if width > n - p:
        return
    every, off = (1 << (n - p)) - 1, 0
    for k, plane in enumerate(bit_planes):
        off |= plane ^ (plane >> p)
        # Few lags outlast the first planes.
        if k in (0, 2) and not long_stretches(~off & every, width):
            return
    for first, last in stretches(long_stretches(~off & every, width), n):
        yield first, last - first + width + p, p


def block_lags(ids: np.ndarray, size: int, known: list[Run]) -> list[int]:
    """The lags in [size, 2 * size) at which a block of ``size`` words, counted from the start, may come again; those are left
    out at which block and copy lie within one run of ``known`` whose period divides the lag."""
    n = len(ids)
    last = (n - size) // size
    if last < 1:
        return []
    # Polynomial hashes modulo 2^64 of all windows; equal windows have equal hashes.
    odd = np.uint64(0x9E3779B97F4A7C15)
    powers = np.full(n + 1, odd)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * powers[:n], dtype=np.uint64)])
    hashes = (sums[size:] - sums[:-size]) * powers[n - size :: -1][: n - size + 1]
    blocks = np.arange(last) * size
    ahead = np.concatenate([hashes[size:], np.zeros(2 * size, np.uint64)])[: last * size].reshape(last, size)
    same = ahead == hashes[blocks][:, None]
    same &= blocks[:, None] + size + np.arange(size) <= n - size
    for start, length, q in known:
        lo, hi = -(-start // size), (start + length - size) // size
        if hi > lo >= 0:
            # Lags up to the run's end; multiples of its period tell nothing new.
            for b in range(lo, min(hi, last)):
                room = start + length - (b + 1) * size
                first = -(-size // q) * q
                same[b, first - size : max(0, min(2 * size, room + 1) - size) : q] = False
    return (np.flatnonzero(same.any(axis=0)) + size).tolist()


def runs(ids: np.ndarray, direct: int = DIRECT) -> list[Run]:
    """All runs (start, length, smallest period), by start, then period."""
    n = len(ids)
    found: list[Run] = []
    if n < LEAST or int(ids.max()) == n - 1:
        return found
    bit_planes = planes(ids)
    most = n // PERIODS
    by_period: dict[int, tuple[list[int], list[int]]] = {}

    def within(start: int, end: int, q: int) -> bool:
        starts, ends = by_period[q]
        at = bisect_right(starts, start) - 1
        return at >= 0 and ends[at] >= end

    def look(lags: Iterable[int]) -> None:
        for p in lags:
            for start, length, _ in at_lag(bit_planes, n, p):
                if not any(within(start, start + length, q) for q in by_period if p % q == 0 and q < p):
                    found.append((start, length, p))
                    for side, place in zip(by_period.setdefault(p, ([], [])), (start, start + length), strict=True):
                        side.append(place)

    if n <= direct:
        look(range(1, most + 1))
    else:
        size = 1
        while size <= most:
            look(p for p in block_lags(ids, size, found) if p <= most)
            size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[Run]) -> Run | None:
    """The run with the greatest exact length / period; ties: the smallest start, then the smallest period."""
    best = None
    for run in found:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run holds behind its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        edge[start + q] += 1
        edge[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not d]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, n_runs, start, length, period, exponent_milli of its strongest run, runs (as lines
    ``start,length,period``) and, if wanted, the collapsed text."""
    names = ["id", "n_runs", "start", "length", "period", "exponent_milli", "runs", *["collapsed"] * with_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text").cast(pa.binary()), 4_000_000):
                out: list[list] = [[] for _ in names[1:]]
                for text in texts:
                    words = (text or b"").split()  # of bytes: at ASCII white space
                    found = runs(word_ids(words))
                    top = strongest(found)
                    figures = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
                    listed = "".join("%d,%d,%d\n" % r for r in found)
                    kept = [(b" ".join(collapsed(words, found) if found else words)).decode("utf-8", "replace")] * with_text
                    for column, value in zip(out, (len(found), *figures, listed, *kept), strict=True):
                        column.append(value)
                columns = [pa.array(c, pa.string() if n in ("runs", "collapsed") else pa.int64()) for n, c in zip(names[1:], out, strict=True)]
                yield pa.record_batch([batch.column("id").slice(lo, hi - lo), *columns], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_runs long, start long, length long, period long, exponent_milli long, runs string" + ", collapsed string" * with_text)
