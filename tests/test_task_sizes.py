"""Plans whose tasks keep their size as tables grow."""

from pyspark.sql import functions as F

from tessera.operators import claims as C
from tessera.operators import discovery as D
from tessera.operators import graph as G
from tessera.plans import graphs, rollups

SMALL = "/root/testdata/sf0.001"


def plan(df):
    # A new frame, whose plan has not run yet.
    return df.select("*")._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_pages_are_dealt_once_in_tasks_of_a_fixed_size(spark, monkeypatch):
    table = spark.createDataFrame([(1, 7), (1, 8), (1, 8), (2, 7), (2, 8), (2, None), (None, 7), (None, 8)], "page long, x long")
    pairs = G.co_occurrence(table, "page", "x")
    assert rows(pairs) == [(7, 8, 2)]
    # One exchange of the rows for each side, which is the same one, and one of the pairs.
    assert plan(pairs).count("hashpartitioning(page") == 2 and plan(pairs).count("hashpartitioning(a") == 1
    monkeypatch.setattr(G, "TASK_ROWS", 1)
    assert "hashpartitioning(page#" in plan(G.co_occurrence(table, "page", "x")) and ", 8), REPARTITION_BY_NUM" in plan(G.co_occurrence(table, "page", "x"))
    assert rows(G.co_occurrence(table, "page", "x")) == [(7, 8, 2)]


def test_unique_edges_go_both_ways_without_a_shuffle(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert "Exchange" not in plan(G.both_ways(edges, unique=True))
    assert rows(G.both_ways(edges, unique=True)) == rows(G.both_ways(edges))
    assert rows(G.degrees(edges, unique=True)) == rows(G.degrees(edges)) == [(1, 2), (2, 2), (3, 2)]
    root = spark.createDataFrame([(1,)], "id long")
    assert rows(G.hops(edges, root, 2, unique=True)) == rows(G.hops(edges, root, 2))
    assert rows(G.shortest_path(edges, 1, 3, unique=True)) == [(0, 1, None), (1, 3, 1)]


def test_upserted_pairs_are_not_aggregated_again(spark):
    assert plan(graphs.g8_discovery_upsert(spark, SMALL)).count("Exchange hashpartitioning(a#") == 1


def test_relation_categories_aggregate_nodes_before_kinds(spark):
    found = plan(graphs.a22_relation_categories(spark, SMALL))
    assert found.count("REPARTITION_BY_NUM") == 1
    # What is dealt by node and kind is aggregated where it lies.
    dealt = [x for x in found.splitlines() if "REPARTITION_BY_NUM" in x]
    assert "hashpartitioning(a#" in dealt[0] and "kind_b#" in dealt[0]


def test_degrees_count_different_relations_and_loops_once(spark):
    relations = spark.createDataFrame([(1, 2, "r", "x"), (1, 2, "r", "x"), (1, 2, "r", "y"), (3, 3, "r", "x"), (4, None, "r", "x")], "src long, dst long, relation string, label string")
    found = D.degrees(relations)
    assert rows(found) == [(1, 2), (2, 2), (3, 1), (4, 1)]
    # Relations are dealt by their ends to tasks of a fixed size before they become distinct.
    assert "REPARTITION_BY_NUM" in plan(found)


def test_counts_of_different_values_repeat_no_row(spark):
    table = spark.createDataFrame(
        [("a", "x", "s", 0.9), ("a", "y", "s", 0.9), ("a", None, None, 0.95), ("b", None, None, None), (None, "x", "s", 0.5), (None, "x", "t", 0.4)], "g string, value string, source string, confidence double"
    )
    found = C.classified(table, ["g"], F.lit(True), F.lit(False))
    assert {r["g"]: tuple(r)[1:] for r in found.collect()} == {
        "a": (2, 1, 0.95, None, "exclusive"), "b": (0, 0, None, None, "same_value"), None: (1, 2, 0.5, "x", "same_value")
    }
    claims = table.withColumn("claim_id", F.when(F.col("value") == "y", 1).otherwise(2))
    found = {r["g"]: tuple(r)[1:] for r in C.canonical(claims, ["g"]).collect()}
    assert found == {"a": (None, [1, 2, 2], 1, 0.95), "b": (None, [2], 0, None), None: ("x", [2, 2], 2, 0.5)}
    for df in (C.classified(table, ["g"], F.lit(True), F.lit(False)), C.canonical(claims, ["g"])):
        assert "Expand" not in plan(df)


def test_fan_out_counts_do_not_repeat_rows(spark):
    assert "Expand" not in plan(rollups.j8_fan_out_audit(spark, SMALL))
