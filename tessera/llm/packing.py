"""Best-fit packing of documents into fixed-length sequences by the sum-of-squares rule.

Documents are tokenised where they are read; only (document, piece, length, checksum) goes on.  Pieces are dealt to packers
by a hash, about ``GROUP`` to each, so packers grow in number with the input and all have like work.  A packer takes its
pieces from long to short and puts each where the sum, over residual gaps, of the squared number of open bins with that gap
becomes smallest; a full bin is closed and counts no more.  Sequences that are short of ``SLACK`` ids or more are then
taken apart, and their pieces are dealt and packed once more by the same rule, so the ends of many packers share bins.

Defined results: a null or empty text has the end id alone, so it is one piece of length 1.  Documents of at most
``capacity`` ids are never cut; longer ones are cut into pieces of ``capacity``, the last of which may be shorter.
A text's ids are those that the tokenizer gives it without special tokens around it; the string of an added token within a
text is that token.  Repeated rows, and rows without an id, are packed each on their own and dealt apart.  An empty table
gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import slices, stage_table
from .word_bpe import word_bpe

#: Ids of a sequence.
CAPACITY = 2048
#: Pieces that a packer gets, about.
GROUP = 5_000
#: A sequence that is short of so many ids is packed again.
SLACK = 32

PIECES = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("deal", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
DDL = "id long, row long, deal long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: id, row (a hash of id and text), deal (a number to deal the document by), piece, start, length,
    ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        end = np.array([end_id], "<u4")
        # Equal rows of a task are told apart by number, so that they go to different packers, on a rerun to the same ones.
        part, nth = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            doc_ids, row_ids = (c.to_pylist() for c in batch.columns[:2])
            for lo, hi, texts in slices(batch.columns[2], 4_000_000):
                ids, counts = bpe.encode([x or "" for x in texts])
                rows: list[tuple] = []
                for i, last, n in zip(range(lo, hi), np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    whole = np.concatenate([ids[last - n : last], end])
                    nth[row_ids[i]] += 1
                    deal = zlib.crc32(b"%d %d %d" % (row_ids[i], part, nth[row_ids[i]]))
                    for k, at in enumerate(range(0, n + 1, capacity)):
                        piece = whole[at : at + capacity]
                        rows.append((doc_ids[i], row_ids[i], deal, k, at, len(piece), zlib.crc32(piece)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, DDL)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, taken in the order given."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        # Placing n in a bin of gap g changes the sum by 2 * (count[g - n] - count[g]) + 2, a full bin (gap 0) leaving it
        # by -2 * count[g] + 1, and a new bin by 2 * count[capacity - n] + 1.
        gaps = np.flatnonzero(count[n:]) + n
        rest = count[gaps - n]
        change = np.where(gaps == n, 1 - 2 * count[gaps], 2 * (rest - count[gaps]) + 2)
        fresh = 2 * count[capacity - n] + 1 if n < capacity else 0
        if len(gaps) and (change.min() <= fresh):
            g = int(gaps[np.argmin(change)])
            b = open_bins[g].pop()
            count[g] -= 1
        else:
            g, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - g
        if g > n:
            open_bins[g - n].append(b)
            count[g - n] += 1
    return bins, offsets


def packed(rows: DataFrame, packers: int, first: int, capacity: int) -> DataFrame:
    """``rows`` with sequence_id, offset and ``gap``, the ids that the sequence is short of; packers are numbered from
    ``first``."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        # Long to short; the rest of the order only makes a rerun give the same sequences.
        frame = frame.sort_values(["length", "id", "row", "piece", "deal"], ascending=[False, True, True, True, True], kind="stable")
        lengths = frame["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, capacity)
        gaps = capacity - np.bincount(bins, lengths).astype(np.int64)
        return frame.assign(sequence_id=frame["packer"].to_numpy() * (1 << 32) + bins, offset=offsets, gap=gaps[bins])[[*PIECES.names, "unnamed", "sequence_id", "offset", "gap"]]

    # A null would make all ids of a frame floating-point numbers.
    dealt = rows.withColumns({"packer": F.pmod(F.xxhash64("deal", "piece"), F.lit(packers)) + first, "unnamed": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0))})
    out = dealt.groupBy("packer").applyInPandas(one, f"{DDL}, unnamed boolean, sequence_id long, offset long, gap long")
    return out.withColumn("id", F.when(~F.col("unnamed"), F.col("id"))).drop("unnamed")


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = stage_table(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    packers = max(1, round(rows.count() / group))
    once = stage_table(packed(rows, packers, 0, capacity), "packed")
    loose = once.where(F.col("gap") >= SLACK).select(*PIECES.names)
    again = packed(loose, max(1, round(loose.count() / group)), packers, capacity)
    out = once.where(F.col("gap") < SLACK).unionByName(again)
    return out.select("id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
