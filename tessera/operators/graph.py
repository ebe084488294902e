"""Property-graph operators on two tables: nodes (id, name, kind, ...) and undirected edges (a, b), a < b.

Traversals go by joins of a frontier with the edges in both directions; each hop aggregates to one row per node, so a
frontier never holds more rows than there are nodes.  Distances, not paths, are what is carried; a path is read back from
them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.stages import stage

from . import set_join

#: Rows that a task of a join or an aggregation by pairs takes, whatever the size of the table.
TASK_ROWS = 1 << 18


def dealt(rows: DataFrame, count: int, *columns: str) -> DataFrame:
    """``rows``, ``count`` in number, dealt by columns to so many tasks that each has about TASK_ROWS."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS)), *columns)


def co_occurrence(rows: DataFrame, page: str, entity: str) -> DataFrame:
    """(a, b, pages): every two different entities on a page, with the number of pages they share.

    Pages are dealt once, to tasks of about TASK_ROWS rows: their entities become distinct and meet in place."""
    some = rows.select(page, F.col(entity).alias("a")).dropna()
    one = dealt(some, rows.count(), page).distinct()
    two = one.withColumnRenamed("a", "b")
    return one.join(two, page).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("pages"))


def both_ways(edges: DataFrame, unique: bool = False) -> DataFrame:
    """(src, dst) of each edge and its reverse.  ``unique`` edges are known to be there once, a < b, as those of
    ``co_occurrence`` are; nothing is shuffled then."""
    if unique:
        ends = F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
        return edges.select(ends)
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct()


def _staged_ways(edges: DataFrame, unique: bool) -> DataFrame:
    """``both_ways`` for several readings; unique edges are stored one way."""
    return both_ways(stage(edges.select("a", "b"), "edges"), True) if unique else stage(both_ways(edges), "edges")


def degrees(edges: DataFrame, unique: bool = False) -> DataFrame:
    return both_ways(edges, unique).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def statistics(nodes: DataFrame, edges: DataFrame, unique: bool = False) -> DataFrame:
    """One row: number of nodes and edges, density, largest and mean degree."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = edges.agg(F.count(F.lit(1)).alias("edges"))
    d = degrees(edges, unique).agg(F.max("degree").alias("max_degree"))
    rows = n.crossJoin(m).crossJoin(d)
    possible = F.col("nodes") * (F.col("nodes") - 1)
    return rows.withColumns({"density": F.coalesce(2 * F.col("edges") / F.nullif(possible, F.lit(0)), F.lit(0.0)), "mean_degree": 2 * F.col("edges") / F.nullif(F.col("nodes"), F.lit(0))})


def hops(edges: DataFrame, roots: DataFrame, most: int, unique: bool = False) -> DataFrame:
    """(id, depth): nodes within ``most`` hops of the roots (id), the roots at 0."""
    way = _staged_ways(edges, unique)
    seen = roots.select(F.col("id").cast("long").alias("id"), F.lit(0).alias("depth")).distinct()
    front = seen
    for k in range(1, most + 1):
        front = way.join(front.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        front = stage(front.join(seen, "id", "left_anti").withColumn("depth", F.lit(k)), "hop")
        seen = seen.unionByName(front)
    return seen


def neighbourhood(nodes: DataFrame, edges: DataFrame, root: int, most: int = 3, least: int = 1, relations: list[str] | None = None, offset: int = 0, limit: int = 50, unique: bool = False) -> DataFrame:
    """A page of the nodes at ``least`` to ``most`` steps from a root, over edges (a, b, relation) of the given relations alone:
    id, name, kind, depth, total (of all pages) and has_more, by depth, name and id."""
    way = edges if relations is None else edges.where(F.col("relation").isin(*relations))
    near = hops(way, edges.sparkSession.createDataFrame([(root,)], "id long"), most, unique).where((F.col("depth") >= least) & (F.col("id") != root))
    return page(near.join(nodes, "id"), ["depth", "name", "id"], offset, limit)


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on, with the number of all rows and whether more follow."""
    rows = stage(rows, "found")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    some = rows.orderBy(*order).offset(offset).limit(limit)
    return some.crossJoin(F.broadcast(total)).withColumn("has_more", F.col("total") > offset + limit)


def shortest_path(edges: DataFrame, source: int, target: int, most: int = 10, unique: bool = False) -> DataFrame:
    """(step, id, from): the shortest path, of several the one that is smallest step by step, and the node before each; no rows
    beyond ``most`` hops.

    Frontiers grow from both ends, the smaller one next, until they meet.  Nodes on shortest paths are then read back from the
    meeting, layer by layer on either side; the path itself takes one of them a step."""
    spark = edges.sparkSession
    way = _staged_ways(edges, unique)
    layers = [[spark.createDataFrame([(x,)], "id long")] for x in (source, target)]
    seen, sizes, met = [x[0] for x in layers], [1, 1], None
    nothing = spark.createDataFrame([], "step int, id long, from long")
    if source == target:
        met = layers[0][0]
    while met is None:
        if len(layers[0]) + len(layers[1]) - 2 >= most or 0 in sizes:
            return nothing
        k = 0 if sizes[0] <= sizes[1] else 1
        front = way.join(layers[k][-1].withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen[k], "id", "left_anti")
        front = stage(front, "frontier")
        layers[k].append(front)
        seen[k], sizes[k] = seen[k].unionByName(front), front.count()
        both = front.join(layers[1 - k][-1], "id", "left_semi")
        met = None if both.isEmpty() else stage(both, "meeting")
    on = [met]  # nodes on shortest paths, a step at a time
    for layer in layers[0][-2::-1]:
        on.insert(0, stage(layer.join(way.join(on[0].withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id")), "id", "left_semi"), "on-path"))
    for layer in layers[1][-2::-1]:
        on.append(stage(layer.join(way.join(on[-1].withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id")), "id", "left_semi"), "on-path"))
    path = [source]
    for step in on[1:]:
        near = way.where(F.col("src") == path[-1]).select(F.col("dst").alias("id")).join(step, "id")
        path.append(near.agg(F.min("id")).first()[0])
    return spark.createDataFrame([(k, x, path[k - 1] if k else None) for k, x in enumerate(path)], "step int, id long, from long")


def _walks(way: DataFrame, start: int, steps: int) -> list[DataFrame]:
    """(path, end) of all walks without repeated nodes from a node, by length from 0 on."""
    out = [way.sparkSession.createDataFrame([([start], start)], "path array<long>, end long")]
    for _ in range(steps):
        step = out[-1].join(way.select(F.col("src").alias("end"), "dst"), "end").where(~F.array_contains("path", F.col("dst")))
        out.append(stage(step.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("end")), "walks"))
    return out


def simple_paths(edges: DataFrame, source: int, target: int, most: int = 3, unique: bool = False) -> DataFrame:
    """(path, length): all paths without repeated nodes of at most ``most`` edges.

    A path is two halves that meet in its middle and share nothing else, so walks go half as far from either end."""
    way = _staged_ways(edges, unique)
    ahead, behind = _walks(way, source, (most + 1) // 2), _walks(way, target, most // 2)
    done = None
    for k in range(1, most + 1):
        back = behind[k // 2].select(F.reverse("path").alias("rest"), "end")
        both = ahead[(k + 1) // 2].join(back, "end").where(F.size(F.array_intersect("path", "rest")) == 1)
        found = both.select(F.concat("path", F.slice("rest", F.lit(2), F.size("rest"))).alias("path"), F.lit(k).alias("length"))
        done = found if done is None else done.unionByName(found)
    return done


def common_neighbours(edges: DataFrame, root: int, unique: bool = False) -> DataFrame:
    """(id, bridges): nodes not adjacent to the root that share neighbours with it."""
    way = both_ways(edges, unique)
    near = way.where(F.col("src") == root).select(F.col("dst").alias("src"))
    far = way.join(near, "src").where(F.col("dst") != root).groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("bridges"))
    return far.join(near.withColumnRenamed("src", "id"), "id", "left_anti")


def similar_nodes(nodes: DataFrame, edges: DataFrame, k: int = 10, cutoff: float = 0.75, selected: DataFrame | None = None, names: int = 8) -> DataFrame:
    """(source, target, similarity, common, names): of each node's ``k`` most similar ones by shared neighbours (ties by id), at
    least ``cutoff``, those with a greater id, the same kind and no edge to it; with the number of neighbours in common and
    the first of their names.

    Where nodes are ``selected`` (id), pairs have one of them, as the source if the target is none."""
    # The sets of a pair tell whether it is an edge and what both have; the edges are not read again.
    ways = both_ways(edges.dropna(subset=["a", "b"]), unique=True)
    pairs = set_join.similar_sets(ways, "src", "dst", cutoff, tokens=True).withColumn("adjacent", F.array_contains("x_t", F.col("y"))).drop("x_t")
    found = stage(pairs, "similar")
    pairs = found.drop("shared")
    both = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), "common", "similarity", "adjacent"))
    best = W.partitionBy("x").orderBy(F.desc("similarity"), "y")
    rows = both.withColumn("_n", F.row_number().over(best)).where((F.col("_n") <= k) & (F.col("x") < F.col("y")) & ~F.col("adjacent")).drop("_n", "adjacent")
    kinds = nodes.select("id", "kind")
    rows = rows.join(kinds.withColumnsRenamed({"id": "x", "kind": "_k"}), "x").join(kinds.withColumnsRenamed({"id": "y", "kind": "_l"}), "y").where(F.col("_k") == F.col("_l"))
    swap = F.lit(False)
    if selected is not None:
        one = selected.select("id").distinct().withColumn("_in", F.lit(True))
        rows = rows.join(one.withColumnsRenamed({"id": "x", "_in": "_a"}), "x", "left").join(one.withColumnsRenamed({"id": "y", "_in": "_b"}), "y", "left").where("_a OR _b")
        swap = F.col("_a").isNull()
    rows = stage(rows, "kept-pairs")
    shared = found.select("x", "y", "shared").join(rows.select("x", "y"), ["x", "y"], "left_semi").select("x", "y", F.explode("shared").alias("id"))
    named = shared.join(nodes.select("id", "name"), "id").groupBy("x", "y").agg(F.slice(F.sort_array(F.collect_set("name")), 1, names).alias("names"))
    rows = rows.join(named, ["x", "y"], "left")
    pick = lambda a, b: F.when(swap, F.col(a)).otherwise(F.col(b))
    return rows.select(pick("y", "x").alias("source"), pick("x", "y").alias("target"), "similarity", "common", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends in ids (id)."""
    return edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi").select(*edges.columns)


def entity_search(nodes: DataFrame, edges: DataFrame, text: str, offset: int = 0, limit: int = 20, unique: bool = False) -> DataFrame:
    """Nodes whose name holds the text, by tier (exact 100, beginning 80, within 60), degree, name and id, as a page."""
    low, q = F.lower("name"), text.lower()
    tier = F.when(low == q, 100).when(low.startswith(q), 80).when(low.contains(q), 60)
    rows = nodes.withColumn("tier", tier).where("tier IS NOT NULL").join(degrees(edges, unique), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return rows.orderBy(F.desc("tier"), F.desc("degree"), "name", "id").offset(offset).limit(limit)


def merged(old: DataFrame, new: DataFrame, key: list, order: str) -> DataFrame:
    """Old rows, and the new ones whose key is unseen; of equal keys the first wins."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = W.partitionBy(*key).orderBy("_new", order)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_new")
