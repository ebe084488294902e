"""SentencePiece encoding by streaming Viterbi, and decoding.

The pieces come from a SentencePiece model file and are never trained here.  A text gets a space in front, spaces become
the space sign, and the best segmentation under the pieces' log probabilities is found from left to right: only the
boundaries within the length of the longest piece are kept, and ids are committed as soon as the paths back from all of
them meet in one boundary.  Characters without a piece become byte pieces.

The model files at hand are of the BPE kind, whose scores are merge ranks, not probabilities.  Ranks are turned into
probabilities by Zipf's law (``1 / (rank + ZIPF)``, normalised), so ids are those of the most probable segmentation and
can differ from the library's, which merges by rank; decoding gives back the text in either case.

Where no piece has a space sign behind another character, no path crosses the place before such a space sign: all paths
meet there.  Stretches between such places are therefore streams of their own, whatever their length, and a worker keeps
the ids of short ones that it has streamed, up to ``limit`` of them.

Defined results: a null or empty text has no ids and decodes to the empty text.  The space sign itself in a text becomes
its byte pieces, so it comes back as it was.  Repeated rows are encoded each.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices

SPACE = "▁"
#: Stands for a space sign of the text itself: a lone surrogate, which no text in UTF-8 has.
SIGN = "\ud800"
ZIPF = 10.0
#: What an unknown character costs beyond the least probable piece.
UNKNOWN = 10.0
#: Steps of a score per unit of log probability.
UNIT = 1 << 20
WORST = -(1 << 62)
#: Characters of the longest stretch whose ids a worker keeps.
KEPT = 64


class Pieces:
    def __init__(self, path: str, limit: int = 700_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        plain = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        total = math.log(sum(1 / (rank + ZIPF) for rank in range(len(plain))))
        # Whole numbers, so that equal sums are equal in whatever order they are added.
        self.scores = {model.id_to_piece(i): (round((-math.log(rank + ZIPF) - total) * UNIT), i) for rank, i in enumerate(plain)}
        self.unknown = min(s for s, _ in self.scores.values()) - round(UNKNOWN * UNIT)
        self.longest = max(map(len, self.scores))
        #: Pieces by their characters: character -> (the same one character further, score and id of the piece that ends here or
        #: None).
        self.tree: dict = {}
        for piece, entry in self.scores.items():
            under = self.tree
            for char in piece[:-1]:
                under = under.setdefault(char, [{}, None])[0]
            under.setdefault(piece[-1], [{}, None])[1] = entry
        self.apart = not any(SPACE in p.lstrip(SPACE) for p in self.scores)
        self.out = {i: p.replace(SPACE, " ").encode() for p, (_, i) in self.scores.items()} | {i: bytes([b]) for b, i in self.bytes.items()}
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]*").findall
        self.limit, self.solved = limit, {}

    def fallback(self, char: str) -> tuple[int, tuple[int, ...]]:
        raw = (SPACE if char == SIGN else char).encode("utf-8", "surrogatepass")
        return self.unknown * len(raw), tuple(self.bytes[b] for b in raw)

    def stream(self, chars: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a stream of characters, in the order in which they are committed.

        ``score``, ``back`` and ``used`` (its last piece) are those of the best path to each boundary since the last commit;
        ``begun`` are the pieces that have begun at one of the last boundaries, the earliest first, and may go on.  Among equal
        scores the longest last piece wins."""
        score, back, used, n, longest, tree, scores, begun = [0], [0], [None], 0, self.longest, self.tree, self.scores, []
        for char in chars:
            begun.append((n, tree))
            n += 1
            top, step, last, on = WORST, 1, None, []
            for start, under in begun:
                if char in under:
                    under, found = under[char]
                    if found is not None and score[start] + found[0] > top:
                        top, step, last = score[start] + found[0], n - start, found
                    if under:
                        on.append((start, under))
            begun = on
            if char not in scores:
                found = self.fallback(char)
                if score[-1] + found[0] > top:
                    top, step, last = score[-1] + found[0], 1, found
            score.append(top)
            back.append(step)
            used.append(last)
            # The paths that can still be extended are those to the last ``longest`` boundaries.  While the beginning is one
            # of them, they can meet nowhere else.
            if n >= longest:
                at = set(range(n - longest + 1, n + 1))
                while len(at) > 1:
                    far = max(at)
                    at.discard(far)
                    at.add(far - back[far])
                meet = at.pop()
                if meet:
                    yield self.path(back, used, meet)
                    # No piece that may go on has begun before the place where they meet.
                    score, back, used, n = [x - score[meet] for x in score[meet:]], back[meet:], used[meet:], n - meet
                    begun = [(start - meet, under) for start, under in begun]
        yield self.path(back, used, n)

    @staticmethod
    def path(back: list[int], used: list, at: int) -> list[int]:
        """The ids of the path to boundary ``at``."""
        out: list[int] = []
        while at:
            ids = used[at][1]
            out += ids[::-1] if type(ids) is tuple else (ids,)
            at -= back[at]
        return out[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = SPACE + text.replace(SPACE, SIGN).replace(" ", SPACE)
        if not self.apart:
            return np.fromiter(chain.from_iterable(self.stream(text)), "<u4").tobytes()
        solved, out = self.solved, []
        for stretch in self.cut(text):
            raw = solved.get(stretch)
            if raw is None:
                ids = [*chain.from_iterable(self.stream(stretch))]
                raw = pack(f"<{len(ids)}I", *ids)
                if len(stretch) <= KEPT:
                    if len(solved) >= self.limit:
                        solved.clear()
                    solved[stretch] = raw
            out.append(raw)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw[1 if raw[:1] == b" " else 0 :].decode("utf-8", "replace")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One model for a Python worker, which keeps what it has solved from task to task."""
    return Pieces(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for lo, hi, texts in slices(batch.columns[1], 4_000_000):
                ids = [model.encode(x or "") for x in texts]
                yield pa.record_batch([batch.columns[0].slice(lo, hi - lo), pa.array(ids, pa.binary())], names=["id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, ids binary")


def decode(rows: DataFrame, model_path: str) -> DataFrame:
    """(id, n_ids, ids_crc32, text) of encoded rows (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for batch in batches:
            for lo, hi, raw in slices(batch.columns[1], 4_000_000):
                columns = [pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([model.decode(x) for x in raw], pa.string())]
                yield pa.record_batch([batch.columns[0].slice(lo, hi - lo), *columns], names=["id", "n_ids", "ids_crc32", "text"])

    return rows.select("id", "ids").mapInArrow(run, "id long, n_ids long, ids_crc32 long, text string")
