"""Joins of sets by their overlap, exact, by prefix filters.

The tokens of a set are ordered from the rarest on.  Two sets of sizes m and n that share at least t tokens share k of them among
the first m - t + k of the one and the first n - t + k of the other, so only prefixes are joined, and very common tokens stand
at the end of all sets.  Pairs that share fewer than k there, or whose first shared token leaves too few behind it, are left
out before the sets are compared.

A prefix carries a mark of its set: bits that each token flips.  Two sets differ in at least as many tokens as their marks do
in bits, so most pairs that share a token by chance are left out where they meet and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources import stages


#: Tokens that two prefixes must share (fewer where the sets need not share so many).
SHARED = 3
#: Columns of 64 bits that make up a mark.
MARKS = ("_m0", "_m1", "_m2", "_m3")


def ordered(sets: DataFrame, item: str, token: str, least: Column, unique: bool = False) -> DataFrame:
    """(item, token, pos from 0, size, *MARKS) of (item, token), a set's rarest token first and ties by a hash; marks are null behind
    the prefix.  ``least`` is the smallest overlap of a set of ``size`` with any partner; ``unique``: no row repeats another one or
    has a null.

    Rows are shuffled twice, by token, where they become distinct and are counted in place, and by item; what is made of them is
    added behind that."""
    one = sets.select(item, token).repartition(F.col(token)) if unique else sets.select(item, token).dropna().repartition(F.col(token)).distinct()
    rows = one.withColumn("_often", F.count(F.lit(1)).over(W.partitionBy(token))).repartition(F.col(item))
    order = W.partitionBy(item).orderBy("_often", F.xxhash64(token), token)
    whole, hashed = W.partitionBy(item), F.xxhash64(token, F.lit(1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(hashed, 8), F.lit(64)).cast("int"))
    flips = {m: F.bit_xor(F.when(F.pmod(hashed, F.lit(len(MARKS))) == k, bit).otherwise(F.lit(0).cast("long"))).over(whole) for k, m in enumerate(MARKS)}
    rows = rows.withColumns({"pos": F.row_number().over(order) - 1, "size": F.count(F.lit(1)).over(whole)} | flips)
    in_prefix = F.col("pos") < F.col("size") - least + SHARED
    return stages.stage(rows.select(item, token, "pos", "size", *[F.when(in_prefix, F.col(m)).alias(m) for m in MARKS]), "ordered")


def candidates(rows: DataFrame, item: str, token: str, need: Column) -> DataFrame:
    """(x, y), x < y: pairs of ordered sets that share tokens of their prefixes.  ``need`` is the smallest overlap of sets of
    ``x_size`` and ``y_size`` (null: sizes too far apart)."""
    prefix = rows.where(F.col(MARKS[0]).isNotNull())
    side = lambda s: prefix.select(F.col(item).alias(s), token, *[F.col(c).alias(f"{s}_{c}") for c in ("pos", "size", *MARKS)])
    differ = sum(F.bit_count(F.col(f"x_{m}").bitwiseXOR(F.col(f"y_{m}"))) for m in MARKS)
    pairs = side("x").join(side("y"), token).where("x < y").where(F.col("x_size") + F.col("y_size") - differ >= 2 * need)
    pairs = pairs.groupBy("x", "y", "x_size", "y_size").agg(F.count(F.lit(1)).alias("_n"), F.min("x_pos").alias("x_pos"), F.min("y_pos").alias("y_pos"))
    # For the first token that both have, no more than what is left behind it can be shared.
    possible = F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos")) >= need
    return pairs.where(possible & (F.col("_n") >= F.least(F.lit(SHARED), need))).select("x", "y")


def similar_sets(sets: DataFrame, item: str, token: str, cutoff: float, unique: bool = False, tokens: bool = False) -> DataFrame:
    """(x, y, common, similarity), x < y: all pairs of items whose sets (item, token) have a Jaccard similarity of at least
    ``cutoff`` > 0; ``unique`` as in ``ordered``.  With ``tokens`` also the tokens of x and those in common (x_t, shared)."""
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    # Rounded off a little, so that no float makes a needed overlap one too large.
    up = lambda c: F.ceil(c - 1e-9)
    rows = ordered(sets, item, token, up(cutoff * F.col("size")), unique)
    m, n = F.col("x_size"), F.col("y_size")
    need = F.when((m >= cutoff * n - 1e-9) & (n >= cutoff * m - 1e-9), up(cutoff / (1 + cutoff) * (m + n)))
    pairs = stages.stage(candidates(rows, item, token, need), "candidates")
    # Only sets that have a partner are gathered.
    met = pairs.select(F.col("x").alias(item)).unionByName(pairs.select(F.col("y").alias(item))).distinct()
    whole = rows.join(met, item, "left_semi").groupBy(item).agg(F.collect_list(token).alias("t"))
    side = lambda s: whole.select(F.col(item).alias(s), F.col("t").alias(f"{s}_t"))
    found = pairs.join(side("x"), "x").join(side("y"), "y").withColumn("shared", F.array_intersect("x_t", "y_t"))
    found = found.withColumn("common", F.size("shared").cast("long"))
    found = found.withColumn("similarity", F.col("common") / (F.size("x_t") + F.size("y_t") - F.col("common")))
    return found.where(F.col("similarity") >= cutoff).select("x", "y", "common", "similarity", *(["x_t", "shared"] if tokens else []))
