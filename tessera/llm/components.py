"""Connected components of a graph given as pairs, by joins and aggregations only.

Each round links every node's larger neighbours to its smallest neighbour, then its smaller ones ("large star, small
star"); rounds are logarithmic in number, and each is cut off from its predecessor's lineage by a staged table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage_table


def contracted(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(a, b), b < a: edges of the same components as those of ``edges`` (a, b), brought nearer to stars around the
    smallest ids by so many rounds, or all the way.

    Repeated edges and loops change nothing; edges with a null end are left out; no edges give no rows."""
    now = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before, done = None, 0
    while rounds is None or done < rounds:
        # Large star: the larger neighbours of a node go to the smallest of the node and its neighbours.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # Small star: a node and its smaller neighbours go to the smallest of these.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        now = stage_table(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        done += 1
        if rounds is None:
            after = _fingerprint(now)
            if after == before:
                break
            before = after
    return now


def components(edges: DataFrame) -> DataFrame:
    """(id, component): of every id in ``edges`` (a, b), the smallest id that it is connected with."""
    now = contracted(edges)
    roots = now.select("b").distinct().select(F.col("b").alias("id"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
