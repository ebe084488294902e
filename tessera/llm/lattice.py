"""Subword lattice likelihood: the log probability of a whole document, summed over all its segmentations.

The pieces come from a SentencePiece model file and are never trained here.  The probability of a text is the sum, over all
ways to cut it into pieces, of the product of the pieces' probabilities; a forward recursion in log space adds them up from
left to right and holds no more boundaries than the longest piece has characters.  The scores of the model files at hand are
merge ranks, so a piece has Zipf's weight ``1 / (rank + ZIPF)``; each byte piece has that of the last rank times
``exp(-UNKNOWN)``, the end of a document that of the first, and all together are normalised to one.

A text is its words (``[^\\x20\\x09-\\x0D]+``, A-Z in lower case), each behind one space sign, and an end.  No piece may have a
space sign behind another character (other files are refused), so every segmentation has a boundary before each word: the
forward sum of a document is the sum of those of its words, and each distinct word is solved once, where it is counted.

Where the model is learnt, the pieces' weights are the counts of the likeliest segmentations of the distinct training words,
under the file's own weights, and a whole word is one more piece: a token met c times in N training tokens of V kinds has the
probability ``(c - d) / N + d * V / N * lattice``, with the absolute discount ``d`` that the words met once and twice tell.  All
training documents count, and the pieces learn from all words: those of at most ``LONG`` bytes are in the table of counts, longer
ones, where there are any, are read from the texts again.  Without training documents the file's
weights stand alone.

Beside it stands an additive baseline of word counts over the training documents.  Counts are over all documents and are
shuffled by word.  Words with at least one token in ``COMMON``, at most that many and of at most ``LONG`` bytes each, are
broadcast with their figures; the others travel as (row, word, count) and meet their counts by a join.  None of them has
more than that share of the tokens, so no task gets a hot word.

Defined results: a null or empty text is an end alone.  A null id counts as the empty text in the choice of the fold, which
makes it a held-out row.  Repeated rows are counted and scored each.  Without training documents every count is 0 and a
token's base score is log10(0.1 / 0.1).  A character without a piece, and the space sign itself, costs its byte pieces.  An
empty table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .pieces import SPACE, UNKNOWN, ZIPF
from .shared import slices, stage_table

#: A word is broadcast where it makes up at least one in so many tokens, so there are at most so many of them.
COMMON = 1 << 19
#: Longer words (in bytes) are counted by their digest and are never broadcast.
LONG = 64
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: What a piece that no training word has counts.
UNSEEN = 0.1
#: The discount where no words are met once or none twice.
DISCOUNT = 0.5
#: The end of a document, as a key; no word is empty.
END = b""
#: Stands for a space sign within a word: no character, so no piece has it, and as many bytes.
FOREIGN = "\uffff"
#: Stands for the bytes of characters without a piece; no piece is empty.
BYTES = ""


class Lattice:
    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        plain = [model.id_to_piece(i) for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError(f"{path}: has pieces that go over the space between words")
        weights = [1 / (rank + ZIPF) for rank in range(len(plain))]
        byte = weights[-1] * math.exp(-UNKNOWN)
        total = math.log(math.fsum(weights) + 256 * byte + weights[0])
        #: Natural logarithms of the probabilities.
        self.pieces = {p: math.log(w) - total for p, w in zip(plain, weights, strict=True)}
        self.byte, self.end = math.log(byte) - total, math.log(weights[0]) - total
        self._plant()

    def _plant(self) -> None:
        #: Pieces by their characters: character -> (the same one character further, the piece's log probability or None).
        self.tree: dict = {}
        for piece, score in self.pieces.items():
            under = self.tree
            for char in piece[:-1]:
                under = under.setdefault(char, [{}, None])[0]
            under.setdefault(piece[-1], [{}, None])[1] = score

    def learnt(self, counts: dict[str, int]) -> Lattice:
        """The same pieces weighted by how often each was used (``BYTES``: bytes without a piece)."""
        out = object.__new__(Lattice)
        total = math.log(sum(counts.values()) + UNSEEN * (len(self.pieces) + 2))
        out.pieces = {p: math.log(counts.get(p, 0) + UNSEEN) - total for p in self.pieces}
        out.byte, out.end = math.log((counts.get(BYTES, 0) + UNSEEN) / 256) - total, math.log(UNSEEN) - total
        out._plant()
        return out

    def likeliest(self, text: str) -> Iterator[str]:
        """The pieces of the likeliest segmentation, the last one first; for each byte without a piece ``BYTES``."""
        pieces, tree, n = self.pieces, self.tree, len(text)
        best, back = array("d", [-math.inf]) * (n + 1), array("q", [0]) * (n + 1)
        best[0] = 0.0
        for i, char in enumerate(text):
            alpha = best[i]
            if char not in pieces and (s := alpha + self.byte * len(char.encode("utf-8", "surrogatepass"))) > best[i + 1]:
                best[i + 1], back[i + 1] = s, i
            under, j = tree, i
            while char in under:
                under, score = under[char]
                j += 1
                if score is not None and alpha + score > best[j]:
                    best[j], back[j] = alpha + score, i
                if j == n:
                    break
                char = text[j]
        while n:
            piece = text[back[n] : n]
            if piece in pieces:
                yield piece
            else:
                yield from [BYTES] * len(piece.encode("utf-8", "surrogatepass"))
            n = back[n]

    def forward(self, text: str) -> float:
        """Natural log of the sum over all segmentations of ``text``.  ``ahead`` has, by boundary, the logs of the paths that
        end there and have been met so far."""
        ahead: dict[int, list[float]] = {}
        alpha, pieces, tree, n, exp, log = 0.0, self.pieces, self.tree, len(text), math.exp, math.log
        for i, char in enumerate(text):
            if i:
                terms = ahead.pop(i)
                alpha = terms[0]
                if len(terms) > 1:
                    top = max(terms)
                    alpha = top + log(sum([exp(x - top) for x in terms]))
            if char not in pieces:
                ahead.setdefault(i + 1, []).append(alpha + self.byte * len(char.encode("utf-8", "surrogatepass")))
            under, j = tree, i
            while char in under:
                under, score = under[char]
                j += 1
                if score is not None:
                    if j in ahead:
                        ahead[j].append(alpha + score)
                    else:
                        ahead[j] = [alpha + score]
                if j == n:
                    break
                char = text[j]
        terms = ahead.pop(n, [0.0])
        top = max(terms)
        return top + log(sum([exp(x - top) for x in terms]))

    def log10(self, word: bytes) -> float:
        """Of a word in UTF-8, or of the end."""
        return (self.forward(signs(word)) if word else self.end) / math.log(10)

    def document(self, text: str | None) -> float:
        """log10 of the probability of a whole text."""
        return math.fsum(map(self.log10, [*tokens((text or "").encode())]))


def signs(word: bytes) -> str:
    """A word as the lattice reads it."""
    return SPACE + word.decode("utf-8", "replace").replace(SPACE, FOREIGN)


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def weighted(path: str, counts: Broadcast[dict[str, int]] | None) -> Lattice:
    """The file's lattice, or the one learnt from ``counts``."""
    return lattice(path) if counts is None else lattice(path).learnt(counts.value)


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, and the end.  On bytes, lower() and split() know ASCII alone."""
    return [*(text or b"").lower().split(), END]


def key(word: bytes) -> bytes:
    """The word, or where it is long its digest behind a space, which no word has."""
    return word if len(word) <= LONG else b" " + sha256(word).digest()


def keys(words: list[bytes]) -> list[bytes]:
    return [*map(key, words)] if max(map(len, words)) > LONG else words


def word_counts(rows: DataFrame) -> DataFrame:
    """(key, train, uses) of rows (held_out, text): tokens in training rows and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counter(), Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for held, c in enumerate(counts):
                n = pa.array(c.values(), pa.int64())
                yield pa.record_batch([pa.array(c.keys(), pa.binary()), pa.array([0] * len(c), pa.int64()) if held else n, n], names=["key", "train", "uses"])
                c.clear()

        for batch in batches:
            for lo, _, texts in slices(batch.column("text").cast(pa.binary())):
                for k, text in enumerate(texts, lo):
                    counts[batch.column("held_out")[k].as_py()].update(keys(tokens(text)))
                    if sum(map(len, counts)) > HELD:
                        yield from out()
        yield from out()

    parts = rows.select("held_out", "text").mapInArrow(run, "key binary, train long, uses long")
    return parts.groupBy("key").agg(F.sum("train").alias("train"), F.sum("uses").alias("uses"))


def long_words(rows: DataFrame) -> DataFrame:
    """(key): the distinct training words of more than LONG bytes of rows (held_out, text), as they are."""
    long = re.compile(rb"[^\x20\x09-\x0D]{%d,}" % (LONG + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column("text").cast(pa.binary())):
                found = {word for text in texts if text for word in long.findall(text.lower())}
                if found:
                    yield pa.record_batch([pa.array([*found], pa.binary())], names=["key"])

    return rows.where("NOT held_out").select("text").mapInArrow(run, "key binary").distinct()


def piece_counts(words: DataFrame, model_path: str, rows: DataFrame) -> DataFrame:
    """(piece, n): uses of each piece in the likeliest segmentations of the distinct training words of ``words`` (key, train), which
    are staged; the long ones are those of ``rows`` (held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = lattice(model_path), Counter()
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for word in batch.column("key").slice(lo, 64).to_pylist():
                    counts.update(model.likeliest(signs(word)))
        yield pa.record_batch([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["piece", "n"])

    met, digest = words.where((F.col("train") > 0) & (F.length("key") > 0)), (F.length("key") == 33) & F.startswith("key", F.lit(b" "))
    whole = met.where(~digest).select("key")
    if not met.where(digest).isEmpty():
        whole = whole.unionByName(long_words(rows))
    return whole.mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def with_lattice(words: DataFrame, model_path: str, counts: Broadcast[dict[str, int]] | None = None) -> DataFrame:
    """``words`` (key, train, uses) with ``score``, the log10 marginal of the word; null for a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = weighted(model_path, counts)
        for batch in batches:
            scores = [None if len(w) > 32 and w[:1] == b" " else model.log10(w) for w in batch.column("key").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return words.mapInArrow(run, "key binary, train long, uses long, score double")


HEAD = "row long, id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, key binary, n long"


def partial_scores(rows: DataFrame, model_path: str, common: dict[bytes, tuple[int, float, float]], counts: Broadcast[dict[str, int]] | None = None) -> DataFrame:
    """Of each row (id, held_out, text) one row with what its common tokens give, key null, and one with (row, key, n) for each
    of its other distinct tokens, with the lattice score of a long one.  ``common`` has (1 if known, base score, lattice score)."""
    shared = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, at = weighted(model_path, counts), shared.value, TaskContext.get().partitionId() << 33
        schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("held_out", pa.bool_()), *[(c, pa.int64()) for c in ("n_tokens", "n_known")], *[(c, pa.float64()) for c in ("base_score", "score")], ("key", pa.binary()), ("n", pa.int64())])
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text").cast(pa.binary()), 4_000_000):
                heads, rare_row, rare_key, rare_n, rare_score = [], [], [], [], []
                for text in texts:
                    words = tokens(text)
                    n_known, base, score = 0, 0.0, 0.0
                    for word, n in Counter(words).items():
                        found = known.get(word)
                        if found:
                            n_known, base, score = n_known + found[0] * n, base + found[1] * n, score + found[2] * n
                        else:
                            long = len(word) > LONG
                            rare_score.append(model.log10(word) if long else None)
                            if long:
                                word = key(word)
                            rare_row.append(at)
                            rare_key.append(word)
                            rare_n.append(n)
                    heads.append((at, len(words), n_known, base, score))
                    at += 1
                row, n_tokens, n_known, base, score = zip(*heads, strict=True)
                own = [pa.array(row), batch.column("id").slice(lo, hi - lo), batch.column("held_out").slice(lo, hi - lo), pa.array(n_tokens), pa.array(n_known), pa.array(base), pa.array(score), pa.nulls(hi - lo, pa.binary()), pa.nulls(hi - lo, pa.int64())]
                yield pa.record_batch(own, schema=schema)
                if rare_row:
                    none = [pa.nulls(len(rare_row), f.type) for f in list(schema)[1:6]]
                    yield pa.record_batch([pa.array(rare_row), *none, pa.array(rare_score, pa.float64()), pa.array(rare_key, pa.binary()), pa.array(rare_n)], schema=schema)

    return rows.select("id", "held_out", "text").mapInArrow(run, HEAD)


def token_score(train: Column, lattice_score: Column, total: Row) -> Column:
    """log10 of a token's probability where the whole word is one more piece, with ``total`` of the training tokens."""
    once, twice, n, v = total["once"], total["twice"], total["n"], total["v"]
    discount = once / (once + 2 * twice) if once and twice else DISCOUNT
    whole = F.log10((train - discount) / n)
    parts = lattice_score + math.log10(discount * v / n)
    top = F.greatest(whole, parts)
    both = top + F.log10(F.pow(F.lit(10.0), whole - top) + F.pow(F.lit(10.0), parts - top))
    return F.when(train > 0, both).otherwise(parts)


def score(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, common: int = COMMON, learn: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10).  Rows whose id has
    a CRC-32 divisible by ``folds`` are held out of the counts.  The score is that of the model file as it is, or where
    ``learn`` of its pieces and whole words as the training documents weight them."""
    fold = F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold == 0).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    words, counts = word_counts(rows), None
    if learn:
        words = stage_table(words, "lattice-counts")
        # As many rows as the model has pieces, at most.
        uses = dict(piece_counts(words, model_path, rows).toLocalIterator())
        counts = docs.sparkSession.sparkContext.broadcast(uses) if uses else None
    words = stage_table(with_lattice(words, model_path, counts), "lattice-words")
    met = lambda k: F.count_if(F.col("train") == k)
    total = words.agg(F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count_if(F.col("train") > 0).alias("v"), F.coalesce(F.sum("uses"), F.lit(0)).alias("uses"), met(1).alias("once"), met(2).alias("twice")).first()
    below = total["n"] + 0.1 * (total["v"] + 1)
    base = F.log10((F.col("train") + 0.1) / F.lit(below))
    known = (F.col("train") > 0).cast("long")
    of_token = lambda c: token_score(F.col("train"), c, total) if learn and total["n"] else c
    usual = words.where((F.col("uses") * common >= total["uses"]) & (F.length("key") <= LONG) & F.col("score").isNotNull())
    # At most ``common`` words of at most LONG bytes.
    table = {bytes(k): (n, b, s) for k, n, b, s in usual.select("key", known, base, of_token(F.col("score"))).toLocalIterator()}
    parts = stage_table(partial_scores(rows, model_path, table, counts), "lattice-rows")
    heads = parts.where("key IS NULL").drop("key", "n")
    n = F.col("n")
    rare = parts.where("key IS NOT NULL").select("row", "key", "n", F.col("score").alias("own")).join(words.select("key", "train", "score"), "key")
    rare = rare.select("row", (n * known).alias("n_known"), (n * base).alias("base_score"), (n * of_token(F.coalesce("score", "own"))).alias("score"))
    sums = [F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")]
    every = heads.unionByName(rare, allowMissingColumns=True).groupBy("row").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), *sums)
    return every.select("id", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score")
