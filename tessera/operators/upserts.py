"""Snapshot upserts, property aggregation and cascading deletes, as rewrites of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Precedence of a property's status.
STATUS_RANK = {"accepted": 3, "disputed": 2, "proposed": 1, "rejected": 0, "replaced": 0}


def latest(old: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Old and new rows by key; a new row replaces an old one, the last of several in ``order`` wins."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    place = W.partitionBy(*key).orderBy(F.desc("_new"), *order)
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n", "_new")


def status_rank(status: Column) -> Column:
    rank = F.lit(1)
    for name, k in STATUS_RANK.items():
        rank = F.when(status == name, k).otherwise(rank)
    return rank


def best_properties(rows: DataFrame, node: str, name: str, value: str, status: str, ordinal: str) -> DataFrame:
    """(node, properties): for each name the value of the best status, the later of equal ones."""
    best = rows.groupBy(node, name).agg(F.max_by(value, F.struct(status_rank(F.col(status)), F.col(ordinal))).alias("_v"))
    return best.groupBy(node).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("key"), F.col("_v").alias("value")))).alias("properties"))


def cascade_counts(tables: dict[str, DataFrame], key: str, gone: DataFrame) -> DataFrame:
    """(table_name, deleted, kept) if the keys in ``gone`` went from every table."""
    out = None
    for name, rows in tables.items():
        mark = rows.join(gone.select(key).distinct().withColumn("_gone", F.lit(1)), key, "left")
        one = mark.agg(F.lit(name).alias("table_name"), F.count("_gone").alias("deleted"), F.count_if(F.col("_gone").isNull()).alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out
