"""Small tools over catalogues, registries, topic trees and the graph, each a function that gives a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import graph, hierarchy, retrieval

#: Fixed value: rows of a page of a table's preview.
PAGE = 50


def columns(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, place) of tables, from their schemas alone."""
    rows = [(name, column, k) for name, table in tables.items() for k, column in enumerate(table.columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, place int")


def preview(table: DataFrame, order: str, page: int = 1) -> DataFrame:
    """A page of a table."""
    return table.orderBy(order).offset(PAGE * (max(1, page) - 1)).limit(PAGE)


def topics(items: DataFrame, tree: DataFrame, default: str) -> DataFrame:
    """(id, topic) of items (id): the domain that lists it in a tree of (domain, concepts (concept, item_ids)), the first of several."""
    listed = tree.select("domain", F.explode("concepts").alias("c")).select("domain", F.explode("c.item_ids").alias("id"))
    first = listed.groupBy("id").agg(F.min("domain").alias("topic"))
    return items.join(first, "id", "left").select("id", F.coalesce("topic", F.lit(default)).alias("topic"))


def resolved_aliases(registry: DataFrame) -> DataFrame:
    """(key, resolved) of a registry (key, alias_for): the entry at the end of a chain of aliases of any length, null where the
    chain leaves the registry or is a circle."""
    return hierarchy.ends(registry, "key", "alias_for").withColumnRenamed("end", "resolved")


def search(nodes: DataFrame, degrees: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The nodes (id, name, is_root) that fit a query best: by tier, then degree (id, degree), name and id."""
    tier = retrieval.relevance_tier(F.col("name"), query, F.col("is_root"))
    rows = nodes.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("tier", tier)
    if query.strip():
        rows = rows.where(F.contains(F.lower("name"), F.lit(query.strip().lower())))
    return rows.orderBy(F.desc("tier"), F.desc("degree"), "name", "id").limit(limit)


def detail(nodes: DataFrame, edges: DataFrame, node: int) -> DataFrame:
    """One node with the edges (a, b) that touch it."""
    touching = edges.where((F.col("a") == node) | (F.col("b") == node))
    near = touching.agg(F.count(F.lit(1)).alias("relations"), F.sort_array(F.collect_set(F.when(F.col("a") == node, F.col("b")).otherwise(F.col("a")))).alias("neighbours"))
    return nodes.where(F.col("id") == node).crossJoin(F.broadcast(near))


def explore(edges: DataFrame, roots: DataFrame, depth: int = 2) -> DataFrame:
    """(id, depth): what is within ``depth`` steps of the roots (id)."""
    return graph.hops(edges, roots, depth)
