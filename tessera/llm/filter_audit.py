"""Filter interaction audit: what each of several filters removes, in every order of application.

A row's failures are bits.  Where the rows lie, each batch is a packed bitmap index in numpy: one bitset for each filter and
each label, rows of a part side by side in whole bytes.  For every subset of the filters, the rows that none of them fails
are the AND-NOT of their bitsets, counted by popcount, alone and under each label.  Counts of 2^k subsets are summed over
the batches and tasks, a part at a time; every order and step is then a difference of two of them.

Five filters of documents come with it (``document_failures``): few words, repeated words, many capitals, odd signs, and
texts that a row with a smaller id has too.  The last is by SHA-256 over the whole table: smallest ids are aggregated before
the shuffle, those of very common texts (at least one row in COMMON, so at most that many) are broadcast, the others joined.

Defined results: a null or empty text has no words and no code points; it fails A alone, and E where a smaller id has an
empty text too.  A row without an id, and rows that repeat an id and its text, fail E only if a smaller id has the text; a
null id is no smaller id.  A null part is the empty string.  Of several labels of one id, one that is 1 counts; rows
without an id or a label count as unlabelled.  A part whose rows all stay has rows with zeros; an empty table gives an
empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import COMMON, slices, stage_table

#: The filters of documents, by letter.
LETTERS = "ABCDE"
#: Fixed values of the filters.
FEWEST_WORDS = 200
LEAST_DISTINCT = 50
MOST_CAPITALS = 2
SIGNS = re.compile(rb"[#$%&*|]")

CAPITALS = bytes(range(65, 91))
FOLLOWING = bytes(range(128, 192))


def text_failures(text: bytes | None) -> int:
    """Bits of the filters A to D for a text in UTF-8."""
    text = text or b""
    words = text.split()  # of bytes: at ASCII white space
    points = len(text) if text.isascii() else len(text.translate(None, FOLLOWING))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    fails = (len(words) < FEWEST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * points, bool(SIGNS.search(text)))
    return sum(f << k for k, f in enumerate(fails))


def text_marks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, bits, digest) of each row, digest the SHA-256 of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text").cast(pa.binary())):
                bits, digests = [text_failures(x) for x in texts], [sha256(x or b"").digest() for x in texts]
                own = [batch.column(c).slice(lo, hi - lo) for c in ("id", "part")]
                yield pa.record_batch([*own, pa.array(bits, pa.int32()), pa.array(digests, pa.binary())], names=["id", "part", "bits", "digest"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), part.alias("part"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, part string, bits int, digest binary")


def document_failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, bits) of each row of ``docs``; the bits of ``LETTERS`` from the lowest one."""
    rows = stage_table(text_marks(docs, id_col, text_col, part_col), "filter-marks")
    firsts = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1 AND least IS NOT NULL")
    firsts = stage_table(firsts, "filter-firsts")
    # Texts that occur once have no row in ``firsts``.
    usual = F.broadcast(firsts.where(F.col("copies") * COMMON >= rows.count()).select("digest", "least"))
    hot = rows.join(usual, "digest")
    cold = rows.join(usual, "digest", "left_anti").join(firsts.select("digest", "least"), "digest", "left")
    later = F.coalesce(F.col("id") > F.col("least"), F.lit(False)).cast("int")
    return hot.unionByName(cold).select("id", "part", F.col("bits").bitwiseOR(later * 16).alias("bits"))


def with_labels(rows: DataFrame, labels: DataFrame, label_cols: Sequence[str], n_filters: int, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (id, part, bits) with a bit behind those of the filters for each label that is 1."""
    bits = sum((F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")) * (1 << (n_filters + k)) for k, c in enumerate(label_cols)), F.lit(0))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(bits.cast("int").alias("more"))
    found = rows.where("id IS NOT NULL").join(marks, "id", "left").withColumn("bits", F.col("bits").bitwiseOR(F.coalesce("more", F.lit(0)))).drop("more")
    return found.unionByName(rows.where("id IS NULL"))


def bitmap_counts(parts: pa.Array, bits: np.ndarray, n_filters: int, n_labels: int) -> tuple[pa.Array, np.ndarray]:
    """(parts, counts[part, subset of the filters, all or label]) of the rows that no filter of the subset fails."""
    coded = pc.dictionary_encode(parts)
    code = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.bincount(code, minlength=len(coded.dictionary))
    # Each part begins with a new byte; what fills its last one is no row.
    wide = -(-rows // 8)
    start = np.concatenate([[0], np.cumsum(wide)])
    order = np.argsort(code, kind="stable")
    place = np.repeat(8 * start[:-1] - (np.cumsum(rows) - rows), rows) + np.arange(len(code))
    index = np.zeros((1 + n_filters + n_labels, 8 * start[-1]), bool)
    index[0, place] = True
    for k in range(n_filters + n_labels):
        index[1 + k, place] = (bits[order] >> k) & 1
    rows_in, *sets = np.packbits(index, axis=1)
    filters, labels = sets[:n_filters], [rows_in, *sets[n_filters:]]
    counts = np.empty((len(rows), 1 << n_filters, 1 + n_labels), np.int64)
    gone = [np.zeros_like(rows_in)]
    for subset in range(1 << n_filters):
        if subset:
            top = subset.bit_length() - 1
            gone.append(gone[subset ^ (1 << top)] | filters[top])
        for k, label in enumerate(labels):
            counts[:, subset, k] = np.add.reduceat(np.bitwise_count(label & ~gone[subset]), start[:-1], dtype=np.int64)
    return coded.dictionary, counts


def subset_counts(rows: DataFrame, n_filters: int, label_names: Sequence[str]) -> DataFrame:
    """(part, subset, n, and a count for each label) from rows (part, bits): the rows that no filter of ``subset`` fails."""
    names = ["part", "subset", "n", *label_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts, counts = bitmap_counts(batch.column("part"), batch.column("bits").to_numpy(), n_filters, len(label_names))
            n = len(parts)
            own = parts.take(pa.array(np.repeat(np.arange(n), 1 << n_filters)))
            subsets = np.tile(np.arange(1 << n_filters, dtype=np.int32), n)
            yield pa.record_batch([own, pa.array(subsets), *[pa.array(counts[:, :, k].ravel()) for k in range(counts.shape[2])]], names=names)

    parts = rows.select("part", "bits").mapInArrow(run, "part string, subset int, " + ", ".join(f"{c} long" for c in names[2:]))
    return parts.groupBy("part", "subset").agg(*[F.sum(c).alias(c) for c in names[2:]])


def interactions(rows: DataFrame, letters: str, label_names: Sequence[str]) -> DataFrame:
    """From rows (part, bits), the bits of the filters first and those of the labels behind: one row per part, order of the
    filters (filter_order) and step, with kept, removed, redundant, unique_fails, ``<label>_lost`` and shapley."""
    k = len(letters)
    names = ["n", *label_names]
    counts = subset_counts(rows, k, label_names).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", *names))).alias("c"))  # 2^k each
    steps = [
        {"o": "".join(letters[f] for f in order), "step": s + 1, "f": f, "was": sum(1 << x for x in order[:s])} for order in permutations(range(k)) for s, f in enumerate(order)
    ]
    # Orders in which the members of a subset come before a filter and all others behind it, by the size of the subset.
    orders = ", ".join(f"{math.factorial(s) * math.factorial(k - 1 - s)}L" for s in range(k))
    removed = "c[x.subset].n - c[x.subset | shiftleft(1, f)].n"
    shapley = f"transform(sequence(0, {k - 1}), f -> aggregate(filter(c, x -> getbit(x.subset, f) = 0), 0L, (a, x) -> a + array({orders})[CAST(bit_count(x.subset) AS INT)] * ({removed})))"
    each = counts.select("part", "c", F.expr(shapley).alias("every"), F.inline(F.from_json(F.lit(json.dumps(steps)), "array<struct<o string, step int, f int, was int>>")))
    now, after = "c[was]", "c[was | shiftleft(1, f)]"
    fails, rest = "c[0].n - c[shiftleft(1, f)].n", f"{(1 << k) - 1} - shiftleft(1, f)"
    return each.selectExpr(
        "part", "o AS filter_order", "step", f"{after}.n AS kept", f"{now}.n - {after}.n AS removed", f"{fails} - ({now}.n - {after}.n) AS redundant",
        f"c[{rest}].n - c[{(1 << k) - 1}].n AS unique_fails", *[f"{now}.{x} - {after}.{x} AS {x}_lost" for x in label_names], "every[f] AS shapley",
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The five filters of documents, with the labels quality (good) and toxic."""
    rows = with_labels(document_failures(docs, id_col, text_col, part_col), labels, ["quality", "toxic"], len(LETTERS), id_col)
    return interactions(rows, LETTERS, ["good", "toxic"])
