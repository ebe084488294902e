import random
from difflib import SequenceMatcher

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, set_join, values
from tessera.plans import conflicts

from . import oracle


def plain_same(a, b):
    """The rule, with the ratio of difflib alone."""
    if not a or not b:
        return False
    if a == b:
        return True
    short, long = sorted((a, b), key=len)
    return len(short) >= 16 and ((short in long and len(short) / len(long) >= 0.9) or SequenceMatcher(None, a, b).ratio() >= 0.96)


def plain_distinct(items):
    kept = []
    for at, value in items:
        value = (value or "").strip(" ")
        if value and not any(plain_same(values.plain_key(value), values.plain_key(v)) for _, v in kept):
            kept.append((at, value))
    return kept


def varied(rng, base):
    out = list(base)
    for _ in range(rng.randrange(5)):
        i = rng.randrange(len(out))
        rng.choice([lambda: out.insert(i, rng.choice("abcé")), lambda: out.pop(i), lambda: out.__setitem__(i, "z"), lambda: out.extend("xy")])()  # noqa: B023
    return "".join(out)


def test_keys_and_ratios():
    assert values.plain_key(" Ｏpen—１９０２年 ß") == "open1902年ss" and values.plain_key(None) == ""
    assert values.same("a", "a") and not values.same("", "") and not values.same("a" * 15, "a" * 14)
    assert values.same("ab" * 10, "ab" * 10 + "c") and not values.same("abcdefghijklmnopqrst", "abcdefghijZZnopqrstu")


@pytest.mark.parametrize("seed", range(3))
def test_distinct_values_equal_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.choice([14, 17, 30, 60, 150, 260]))) + "q" for _ in range(6)]
    rows = []
    for at in range(260):
        value = varied(rng, rng.choice(bases)) if rng.random() < 0.85 else rng.choice(["—", "", None, " x ", "X", "…"])
        rows.append((rng.choice([None, "g", "h"]), at, value, "clash", "clash"))
    frame = spark.createDataFrame(rows, "group string, at long, v string, value string, node string").repartition(3)
    got = {}
    for r in values.distinct_values(frame, ["group"], "v", "at").orderBy("at").collect():
        got.setdefault(r["group"], []).append((r["at"], r["value"]))
    for g in (None, "g", "h"):
        assert got.get(g, []) == plain_distinct([(at, v) for k, at, v, *_ in rows if k == g])
    assert values.distinct_values(frame.limit(0), ["group"], "v", "at").collect() == []


def test_meanings_of_the_fixture_are_those_of_the_rule():
    keys = [values.plain_key(x) for x in conflicts.TEXTS]
    for i, a in enumerate(keys):
        for j, b in enumerate(keys):
            m, n = conflicts.MEANINGS[i], conflicts.MEANINGS[j]
            assert plain_same(a, b) == (m is not None and m >= 0 and m == n)


CLAIM = "g string, claim long, claim_type string, predicate string, temporal_role string, value string, source string, score double, evidence_status string, entity_status string, scope_mismatch boolean"


def classes(spark, *rows):
    full = [("g", k, r.get("kind", "property"), r.get("p", "始建年代"), r.get("role"), r["v"], r.get("s", "d1"), r.get("score", 0.5), r.get("e", "supported"), r.get("entity"), r.get("scope")) for k, r in enumerate(rows)]
    return values.classified_groups(spark.createDataFrame(full, CLAIM), ["g"]).first()


def test_classes_in_order(spark):
    one, two = {"v": "明代"}, {"v": "清代", "s": "d2", "score": 0.5}
    assert classes(spark, one, {"v": "明 代"})["conflict_class"] == "same_value"
    r = classes(spark, one, two)
    assert (r["conflict_class"], r["gap_status"], r["distinct_value_count"], r["source_count"], r["best_claim"]) == ("conflicting", "conflicted", 2, 2, 0)
    assert classes(spark, one, two | {"scope": True, "entity": "AMBIGUOUS"})["conflict_class"] == "scope_mismatch"
    assert classes(spark, one, two | {"entity": "AMBIGUOUS"})["conflict_class"] == "entity_ambiguity"
    assert classes(spark, one | {"e": None}, two | {"e": "none"})["conflict_class"] == "unsupported"
    assert classes(spark, one | {"e": "weak"}, two | {"e": "none"})["conflict_class"] == "weak_evidence"
    assert classes(spark, one | {"role": "legend_time"}, two)["conflict_class"] == "compatible"
    assert classes(spark, one | {"p": "简介"}, two)["conflict_class"] == "multi_value"
    assert classes(spark, one | {"kind": "relation", "p": "隶属"}, two)["conflict_class"] == "conflicting"
    assert classes(spark, one | {"kind": "relation", "p": "毗邻"}, two)["conflict_class"] == "multi_value"
    assert classes(spark, one | {"kind": "fact"}, two)["conflict_class"] == "compatible"


@pytest.mark.parametrize("cutoff", [0.05, 0.5, 0.75, 1.0])
def test_similar_sets_equal_all_pairs(spark, cutoff):
    rng = random.Random(int(cutoff * 100))
    sets = {i: {min(int(rng.expovariate(0.2)), 30) for _ in range(rng.randrange(1, 14))} for i in range(90)}
    frame = spark.createDataFrame([(i, x) for i, s in sets.items() for x in s] * 2 + [(None, 1), (1, None)], "item long, token long")
    want = {(a, b): (len(sets[a] & sets[b]), len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in sets for b in sets if a < b}
    got = {(r["x"], r["y"]): (r["common"], r["similarity"]) for r in set_join.similar_sets(frame, "item", "token", cutoff).collect()}
    assert got == {k: v for k, v in want.items() if v[1] >= cutoff and v[0]}


def test_similar_nodes_are_of_one_kind_and_not_adjacent(spark):
    edges = [(1, 10), (2, 10), (3, 10), (1, 11), (2, 11), (3, 11), (1, 3), (4, 10), (4, 11)]
    nodes = spark.createDataFrame([(1, "a", "k"), (2, "b", "k"), (3, "c", "k"), (4, "d", "l"), (10, "x", "k"), (11, "y", "k")], "id long, name string, kind string")
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {(r["source"], r["target"]): (round(r["similarity"], 3), r["common"], r["names"]) for r in graph.similar_nodes(nodes, frame, cutoff=0.5).collect()}
    assert got == {(1, 2): (0.667, 2, ["x", "y"]), (2, 3): (0.667, 2, ["x", "y"]), (10, 11): (1.0, 4, ["a", "b", "c", "d"])}
    some = graph.similar_nodes(nodes, frame, cutoff=0.5, selected=nodes.where("id = 3")).collect()
    assert [(r["source"], r["target"]) for r in some] == [(3, 2)]


@pytest.mark.parametrize("few", [1, 32])
def test_small_and_large_groups_settle_alike(spark, monkeypatch, few):
    monkeypatch.setattr(values, "FEW", few)
    rng = random.Random(few)
    bases = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(3)]
    rows = [(g, at, varied(rng, rng.choice(bases))) for at in range(60) for g in (None, "g")]
    got = values.distinct_values(spark.createDataFrame(rows, "g string, at long, v string"), ["g"], "v", "at").orderBy("at").collect()
    for g in (None, "g"):
        assert [(r["at"], r["value"]) for r in got if r["g"] == g] == plain_distinct([(at, v) for k, at, v in rows if k == g])


def test_pairs_of_few_shared_tokens_end_where_they_meet(spark):
    """Sets that share a few rare tokens are left out by their marks, before a pair is shuffled."""
    rows = [(i, t) for i in range(30) for t in [*range(4), *range(1000 * (i + 1), 1000 * (i + 1) + 60)]]
    rows += [(100, t) for t in range(60)] + [(101, t) for t in range(59)]
    need = F.ceil(0.75 / 1.75 * (F.col("x_size") + F.col("y_size")) - 1e-9)
    sets = set_join.ordered(spark.createDataFrame(rows, "i long, t long"), "i", "t", F.lit(1))
    assert [tuple(r) for r in set_join.candidates(sets, "i", "t", need).collect()] == [(100, 101)]
    assert sets.where("_m0 IS NULL AND pos < size").isEmpty()


def test_of_one_claims_values_the_tables_first_one_counts(spark, tmp_path):
    rng = random.Random(3)
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"]
    rows = [(rng.randrange(20), 1 + rng.randrange(7), rng.randrange(4), rng.randrange(1000), 0.1) for _ in range(4000)]
    frame = pd.DataFrame(rows, columns=names).astype({"l_linenumber": "int32"})
    frame.to_parquet(tmp_path / "lineitem.parquet", index=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    got, want = conflicts.a12_distinct_values(spark, str(tmp_path)).toPandas(), con.execute(conflicts.ORACLES["a12_distinct_values"]).fetchdf()
    assert oracle.rows(got) == oracle.rows(want)


def test_sets_are_shuffled_twice_and_edges_read_once(spark, monkeypatch):
    edges = [(1, 10), (2, 10), (3, 10), (1, 11), (2, 11), (3, 11), (1, 3), (4, 10), (4, 11)]
    nodes = spark.createDataFrame([(i, f"n{i}", "k") for i in (1, 2, 3, 4, 10, 11)], "id long, name string, kind string")
    frame = spark.createDataFrame([*edges, *edges[:4], *[(b, a) for a, b in edges]], "a long, b long")
    plans, stage = {}, set_join.stages.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(set_join.stages, "stage", noted)
    monkeypatch.setattr(graph, "stage", noted)
    got = {(r["source"], r["target"]): (round(r["similarity"], 3), r["common"], r["names"]) for r in graph.similar_nodes(nodes, frame, cutoff=0.5).collect()}
    some = {(a, b): (0.667, 2, ["n10", "n11"]) for a in (1, 3) for b in (2, 4)}
    assert got == {tuple(sorted(k)): v for k, v in some.items()} | {(2, 4): (1.0, 2, ["n10", "n11"]), (10, 11): (1.0, 4, ["n1", "n2", "n3", "n4"])}
    assert [x for x in plans if x in ("edges", "sets")] == [] and plans["ordered"].count("Exchange hashpartitioning") == 2
