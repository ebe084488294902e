"""Dataset splits that keep clusters whole, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stratified(rows: DataFrame, stratum: str, cluster: str, share: float, order: Column) -> DataFrame:
    """``rows`` with ``role``: in each stratum, round(share * clusters) of the clusters, but one at least and not all, are
    queries, those that come first in ``order`` (a hash of the cluster); a single cluster is gallery."""
    names = rows.select(stratum, cluster).distinct()
    n = F.count(F.lit(1)).over(W.partitionBy(stratum))
    place = F.row_number().over(W.partitionBy(stratum).orderBy(order, cluster))
    names = names.withColumns({"_n": n, "_k": place})
    take = F.least(F.col("_n") - 1, F.greatest(F.lit(1), F.floor(F.col("_n") * share + 0.5)))
    names = names.select(stratum, cluster, F.when(F.col("_k") <= take, "query").otherwise("gallery").alias("role"))
    return rows.join(names, [stratum, cluster])


def sample_with_top_up(rows: DataFrame, stratum: str, n: int, order: Column, row_id: str) -> DataFrame:
    """``n`` rows: as many of each stratum as fit evenly, the rest from what is left, both in ``order``.

    Only a stratum's first ``n`` rows can be among them, so each task keeps that many of it before they meet."""
    kinds = rows.select(F.countDistinct(stratum).alias("_kinds"))
    each = F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("_kinds")))
    first = rows.withColumns({"_o": order, "_k": F.row_number().over(W.partitionBy(stratum).orderBy(order, row_id))}).where(F.col("_k") <= n)
    rows = first.crossJoin(F.broadcast(kinds))
    return rows.orderBy((F.col("_k") > each).cast("int"), "_o", row_id).limit(n).drop("_o", "_k", "_kinds")


def complete_roles(rows: DataFrame, node: str, role: str) -> DataFrame:
    """Rows of nodes that have both roles."""
    whole = rows.groupBy(node).agg(F.countDistinct(role).alias("_n")).where("_n >= 2").select(node)
    return rows.join(whole, node, "left_semi")


def leaks(rows: DataFrame, cluster: str, role: str) -> DataFrame:
    """Clusters that are in several roles."""
    return rows.groupBy(cluster).agg(F.countDistinct(role).alias("roles")).where("roles > 1")
