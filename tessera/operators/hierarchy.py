"""Chains of parents of any depth by pointer doubling: a round joins the ancestors found so far with themselves, so the number
of rounds is the logarithm of the depth.

A parent that is no node ends a chain, and so does a node that is met again: a circle's nodes are each other's ancestors, none
its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.stages import stage


def ancestors(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(below, above, steps): every node with each of its ancestors and the number of steps to it, fewest first met."""
    up = nodes.where(F.col(key).isNotNull()).select(F.col(key).alias("below"), F.col(parent).alias("above")).distinct()
    known = nodes.select(F.col(key).alias("above")).distinct()
    pairs = stage(up.where("above IS NOT NULL AND above <> below").join(known, "above", "left_semi").select("below", "above", F.lit(1).cast("long").alias("steps")), "ancestors")
    count = pairs.count()
    while True:
        further = pairs.select(F.col("below").alias("above"), F.col("above").alias("_top"), F.col("steps").alias("_more"))
        joined = pairs.join(further, "above").where(F.col("below") != F.col("_top")).select("below", F.col("_top").alias("above"), (F.col("steps") + F.col("_more")).alias("steps"))
        pairs = stage(pairs.unionByName(joined).groupBy("below", "above").agg(F.min("steps").alias("steps")), "ancestors")
        before, count = count, pairs.count()
        if count == before:
            return pairs


def chains(nodes: DataFrame, key: str, parent: str, value: Column) -> DataFrame:
    """(key, chain, depth): ``value`` of a node's ancestors and of itself, the farthest first; blank ones are left out of the
    chain.  A chain is as long as the hierarchy is deep."""
    values = nodes.select(F.col(key).alias("above"), value.alias("_value"))
    every = ancestors(nodes, key, parent).unionByName(nodes.select(F.col(key).alias("below"), F.col(key).alias("above"), F.lit(0).cast("long").alias("steps")))
    rows = every.join(values, "above")
    listed = F.sort_array(F.collect_list(F.when(F.trim("_value") != "", F.struct((-F.col("steps")).alias("s"), F.col("_value").alias("v")))))
    return rows.groupBy(F.col("below").alias(key)).agg(F.transform(listed, lambda x: x["v"]).alias("chain"), F.max("steps").alias("depth"))


def ends(nodes: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, end): the last node of each chain; null where it leaves the nodes or runs in a circle."""
    pairs = ancestors(nodes, key, parent)
    every = pairs.select(F.col("below").alias(key), F.col("above").alias("end")).unionByName(nodes.select(key, F.col(key).alias("end")))
    last = nodes.where(F.col(parent).isNull()).select(F.col(key).alias("end"))
    return nodes.select(key).join(every.join(last, "end", "left_semi"), key, "left").select(key, "end")
