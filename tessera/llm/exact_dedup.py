"""Exact dedup by digest with a heavy-hitter split (DataFrame operations only).

Misra-Gries counters (``freqItems``) name every digest that makes up more than ``support`` of the rows, and at most
``1/support`` digests in all.  Those are counted exactly; the verified winners, a table of at most ``1/support`` rows,
are broadcast, so copies of a hot text are settled where they are read.  All other digests are shuffled; none of them
has more than ``support`` of the rows, so no task gets a hot group.

Defined results: a null text counts as empty; all empty texts are equal.  Rows without an id come last in their group
and get the group's smallest id (null if there is none).  Rows that repeat an id and its text count in ``group_size``
and are all flagged alike.  An empty table gives an empty result.  Other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stage_table

#: The smallest share of the rows that Misra-Gries must find; also bounds the broadcast to 1/SUPPORT rows.
SUPPORT = 1 / 1024


def plain_digest(text_col: str) -> Column:
    plain = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(plain, 256)


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): lower-case hex SHA-256 of the text in which every run of white space is one space."""
    return docs.select(F.col(id_col).cast("long").alias("id"), plain_digest(text_col).alias("digest"))


def heavy_digests(rows: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that Misra-Gries finds and an exact count confirms."""
    suspects = rows.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    return (
        rows.join(F.broadcast(suspects), "digest")
        .groupBy("digest")
        .agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: id, digest, keep_id, group_size, kept."""
    rows = stage_table(text_digests(docs, id_col, text_col), "digests")
    heavy = stage_table(heavy_digests(rows, support), "heavy-digests")
    hot = rows.join(F.broadcast(heavy), "digest").select("id", "digest", "keep_id", "group_size")
    group = W.partitionBy("digest")
    cold = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti").select(
        "id", "digest", F.min("id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return hot.unionByName(cold).withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each text, with the smallest id and all its columns; of rows that repeat an id and its text, the first
    by text.  Rows without an id stay: nothing can name them."""
    pairs = exact_groups(docs, id_col, text_col).where("id IS NOT NULL").groupBy("id", "digest", "kept").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.where(~F.col("kept") | (F.col("n") > 1)).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("kept").alias("_kept"))
    pairs = stage_table(pairs, "copies")
    keyed = docs.withColumns({"_id": F.col(id_col).cast("long"), "_digest": plain_digest(text_col)})
    out = keyed.join(pairs.drop("_kept").hint("shuffle_hash"), ["_id", "_digest"], "left_anti").select(*docs.columns)
    repeated = pairs.where("_kept").drop("_kept")
    if repeated.isEmpty():
        return out
    number = F.row_number().over(W.partitionBy("_id", "_digest").orderBy(text_col))
    first = keyed.join(repeated, ["_id", "_digest"], "left_semi").withColumn("_n", number).where("_n = 1")
    return out.unionByName(first.select(*docs.columns))
