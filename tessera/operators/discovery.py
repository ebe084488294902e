"""Search, overview and detail of a published graph: nodes (id, name, kind, description, parent), facts (node, key, value) and
directed relations (src, dst, relation, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.sources.stages import stage

from . import graph

# The longest query, nodes and relations of an overview, relations of a detail.
LONGEST_QUERY, NODES, RELATIONS, INCIDENT = 100, 500, 3000, 2000


def _holds(column: str, query: str):  # noqa: ANN202
    return F.contains(F.lower(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(query))


def degrees(relations: DataFrame) -> DataFrame:
    """(id, degree): the number of different relations at a node; a loop counts once."""
    rows = relations.select("src", "dst", "relation", "label")
    one = graph.dealt(rows, rows.count(), "src", "dst").distinct()
    ends = F.when(F.col("src") != F.col("dst"), F.array("src", "dst")).otherwise(F.array("src"))
    return one.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def search(nodes: DataFrame, facts: DataFrame, relations: DataFrame, query: str, kind: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of the nodes whose name, description or facts (a key or value) hold the query in lower case, all nodes for an empty
    one: id, name, kind, degree, match_score, total, has_more.

    The name itself scores 100, its beginning 80, a part of it 60, anything else 30; without a query a root has 20, others 0."""
    q = query.strip().lower()
    if len(query.strip()) > LONGEST_QUERY:
        raise ValueError(f"query exceeds {LONGEST_QUERY} characters")
    rows = nodes if not kind else nodes.where(F.col("kind") == kind)
    if q:
        # Nodes by facts are found from the facts; only their ids meet the nodes.
        told = facts.where(_holds("key", q) | _holds("value", q)).select(F.col("node").alias("id")).distinct().withColumn("_fact", F.lit(True))
        rows = rows.join(told, "id", "left").where(_holds("name", q) | _holds("description", q) | F.coalesce("_fact", F.lit(False))).drop("_fact")
        low = F.lower(F.coalesce("name", F.lit("")))
        score = F.when(low == q, 100).when(low.startswith(q), 80).when(F.contains(low, F.lit(q)), 60).otherwise(30)
    else:
        score = F.when(F.coalesce(F.col("parent").cast("string"), F.lit("")) == "", 20).otherwise(0)
    rows = rows.join(degrees(relations), "id", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "match_score": score})
    found = rows.select("id", "name", "kind", "degree", "match_score")
    return graph.page(found, [F.desc("match_score"), F.desc("degree"), "name", "id"], max(0, offset), max(1, min(limit, 100)))


def overview(nodes: DataFrame, facts: DataFrame, relations: DataFrame, most_nodes: int = NODES, most_relations: int = RELATIONS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relations, totals) of a domain: its first nodes, roots before others and then by name and id, with their facts by key
    and value; the relations among them, by relation, label and the names of both ends; one row with the totals and whether
    either was cut."""
    root = F.when(F.coalesce(F.col("parent").cast("string"), F.lit("")) == "", 0).otherwise(1)
    some = stage(nodes.orderBy(root, "name", "id").limit(most_nodes), "overview-nodes")
    told = facts.join(F.broadcast(some.select(F.col("id").alias("node"))), "node").groupBy(F.col("node").alias("id"))
    listed = told.agg(F.sort_array(F.collect_set(F.struct("key", "value"))).alias("facts"))
    rows = some.join(listed, "id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<struct<key:string,value:string>>")))
    rows = rows.withColumn("fact_count", F.size("facts"))
    names = some.select("id", "name")
    within = relations.join(F.broadcast(names.withColumnsRenamed({"id": "src", "name": "source_name"})), "src").join(F.broadcast(names.withColumnsRenamed({"id": "dst", "name": "target_name"})), "dst")
    within = stage(within.select("src", "source_name", "dst", "target_name", "relation", "label").orderBy("relation", "label", "source_name", "target_name", "src", "dst").limit(most_relations + 1), "overview-relations")
    count = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    totals = count(nodes, "total_nodes").crossJoin(count(relations, "total_relations")).crossJoin(count(facts, "total_facts")).crossJoin(count(within, "_within"))
    totals = totals.select("total_nodes", "total_relations", "total_facts", (F.col("total_nodes") > most_nodes).alias("node_truncated"), (F.col("_within") > most_relations).alias("relation_truncated"))
    return rows, within.orderBy("relation", "label", "source_name", "target_name", "src", "dst").limit(most_relations), totals


def detail(nodes: DataFrame, relations: DataFrame, node: int, most: int = INCIDENT) -> DataFrame:
    """The relations at a node in their own direction, by relation, label and names, with the neighbour's id, name and kind, the
    number of all of them and whether they were cut; no rows for a node that is not there."""
    ends = nodes.select("id", "name", "kind")
    at = relations.where((F.col("src") == node) | (F.col("dst") == node)).select("src", "dst", "relation", "label").distinct()
    at = at.withColumn("neighbour", F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")))
    rows = at.join(ends.select(F.col("id").alias("src"), F.col("name").alias("source_name")), "src").join(ends.select(F.col("id").alias("dst"), F.col("name").alias("target_name")), "dst")
    rows = rows.join(ends.select(F.col("id").alias("neighbour"), F.col("name").alias("neighbour_name"), F.col("kind").alias("neighbour_kind")), "neighbour")
    rows = graph.page(rows, ["relation", "label", "source_name", "target_name", "src", "dst"], 0, most)
    return rows.withColumnsRenamed({"total": "total_relations", "has_more": "truncated"})
