import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, hierarchy, resolution, retrieval, source_rules, variants


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def anchored(items, tolerance):
    """(node, rank, status, group), one by one."""
    items, out, i = sorted(items, key=lambda x: (-x[1], str(x[0]))), [], 0
    while i < len(items):
        j = i + 1
        while j < len(items) and abs(items[j][1] - items[i][1]) <= tolerance:
            j += 1
        group = [n for n, _ in items[i:j]]
        out += [(n, i + 1, "tied" if j - i > 1 else "unique", group) for n in group]
        i = j
    return sorted(out)


@pytest.mark.parametrize("tolerance", [1e-9, 0.1])
def test_ties_are_anchored_on_their_first_score(spark, tolerance):
    rng = random.Random(1)
    rows = [("a", n, round(rng.choice([0.5, 0.9]) + rng.randrange(12) * tolerance * 0.4, 12)) for n in range(60)]
    # On either side of a rounding edge, and a chain wider than the tolerance.
    rows += [("b", 1, 0.1234567895), ("b", 2, 0.1234567895 - 1e-10), ("c", 10, 1.0), ("c", 9, 1.0), ("d", 1, None)][:4]
    frame = spark.createDataFrame(rows, "q string, node long, score double")
    for q in "abc":
        got = retrieval.tolerant_ranks(frame.where(F.col("q") == q), ["q"], "score", "node", tolerance).collect()
        assert sorted((r["node"], r["rank"], r["tie_status"], r["tie_group"]) for r in got) == anchored([(n, s) for k, n, s in rows if k == q], tolerance)
    both = retrieval.tolerant_ranks(frame, ["q"], "score", "node").where("q = 'b'").collect()
    assert {r["tie_status"] for r in both} == {"tied"}


def test_types_of_entities_have_names_of_their_own(spark):
    kinds = [resolution.entity_type(F.lit(x)) for x in ("School", " ＬＯＣＡＴＩＯＮ", "文物", "artifact", "entity", "Unknown", None, "type_a1=学校", "x" * 70, "景点")]
    assert list(one(spark, *kinds)) == ["organization", "region", "object", "object", "", "", "", "type_a1", "x" * 64, "景点"]
    assert list(one(spark, resolution.type_code(F.lit("景点")), resolution.type_code(F.lit("entity")))) == ["poi", "entity"]
    x = one(spark, resolution.inferred_type(F.lit("unresolved"), F.lit(""), F.lit("太原理工大学 ")))[0]
    assert (x["kind"], x["confidence"]) == ("organization", 0.86)


def plain_values(raw):
    import re

    try:
        v = json.loads(raw)
    except (TypeError, ValueError):
        v = raw

    def values(v):
        if isinstance(v, dict):
            v = v.get("value") or v.get("values") or v.get("display_value")
        if isinstance(v, list):
            return [x for item in v for x in values(item)]
        return [x.strip() for x in re.split(r"[,，、;/；|]", str(v or "")) if x.strip()]

    return values(v)


def test_values_of_any_shape(spark):
    raws = ["a,b", None, "", " x / y ", "12", '"p; q"', '["a","b,c",["d",["e"]]]', '{"value":"v|w"}', '{"value":"","values":["a",{"display_value":"z"}]}', "{}", "[]", "null", "0", '{"value":null,"values":0,"display_value":"d"}', "{broken", '[{"value":["x",{"value":"y"}]}, 3, 1.5]']
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(raws)], "k int, raw string").select("k", variants.values(F.col("raw")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in rows] == [plain_values(x) for x in raws]


def test_objects_are_merged_and_set(spark):
    a, b = '{"a": 1, "b": {"c": [1]}}', '{"b": null, "z": "q"}'
    got = one(spark, variants.merged(F.lit(a), F.lit(b)), variants.with_value(F.lit(a), ["b", "c"], F.lit("2")), variants.with_value(F.lit(a), ["b", "new"], F.lit('"n"')), variants.with_value(F.lit(a), ["x", "y"], F.lit("1")), variants.with_value(F.lit(a), ["x"], F.lit("1"), create=False), variants.merged(F.lit("[1]"), F.lit(b)))
    want = [{"a": 1, "b": None, "z": "q"}, {"a": 1, "b": {"c": 2}}, {"a": 1, "b": {"c": [1], "new": "n"}}, json.loads(a), json.loads(a), json.loads(b)]
    assert [json.loads(x) for x in got] == want


def test_wrapped_properties_fill_what_is_empty(spark):
    now = {n: F.lit(x).cast("string") for n, x in (("value", ""), ("source_text", "kept"), ("source_url", None), ("confidence", ""), ("status", None))}
    full = variants.wrapped(F.lit(' {"value": 3, "source_text": "t", "source_url": "u", "confidence": 0.5, "status": ""} '), now)
    assert list(one(spark, *full.values())) == ["3", "kept", "u", "0.5", None]
    for raw in ('{"value"', "[1]", "text", None):
        assert list(one(spark, *variants.wrapped(F.lit(raw).cast("string"), now).values())) == ["", "kept", None, "", None]


def test_replies_are_found_in_fences_and_texts(spark):
    got = [one(spark, variants.reply(F.lit(x).cast("string"), "k int"))[0] for x in ('a ```json\n{"k": 1}\n``` b', '[{"k": 2}]', 'x {"k": 3} y', "none", None, "[]", '{"k":')]
    assert [(r["valid"], r["data"] and r["data"]["k"]) for r in got] == [(True, 1), (True, 2), (True, 3), *[(False, None)] * 4]


def test_relevance_counts_a_term_once(spark):
    terms = {"node": F.array(F.lit("Old Gate"), F.lit("x")), "scenic": F.array(F.lit("oldgate"), F.lit("park")), "target": F.array(F.lit("park"), F.lit("year"), F.lit("YEAR"))}
    rows = spark.createDataFrame([("The old-gate? no, Old Gate park", "http://a.people.com.cn/x", 1), ("park year", "", 9), (None, None, None)], "t string, u string, r int")
    got = [r["relevance"] for r in source_rules.with_relevance(rows, [F.col("t")], F.col("u"), terms, F.col("r")).collect()]
    assert (got[0]["score"], got[0]["matched"], got[0]["reasons"]) == (5.8, ["oldgate", "park"], ["node:1", "scenic:1", "authority_domain", "top_rank"])
    assert (got[1]["score"], got[1]["reasons"], got[2]["score"]) == (1.95, ["scenic:1", "target:1"], 0.0)


def test_weights_of_sources(spark):
    w = lambda *x: one(spark, source_rules.weight(*[F.lit(v).cast("boolean" if k == 5 else "string") for k, v in enumerate(x)]))[0]
    assert tuple(w(None, "web_search", "https://www.moe.gov.cn/x", "", "", None)) == ("web", "web_search", "government", 0.92, 0.92)
    assert tuple(w(None, "domain_kb_vector", None, "notes", "", True)) == ("local_kb", "vector", "official", 0.95, 1.0)
    assert tuple(w("Self_Media", "graph_x", "http://x.edu", "大学", "", None)) == ("web", "graph_lookup", "self_media", 0.35, 0.3)
    assert tuple(w(None, "", "https://you.ctrip.com", "guide", "", None)) == ("web", "unknown", "travel_platform", 0.55, 0.55)


def test_chains_of_any_depth_and_circles(spark):
    n = 300
    rows = [(k, k - 1 if k else None, f"n{k}") for k in range(n)] + [(1000, 1001, "a"), (1001, 1002, "b"), (1002, 1000, ""), (1003, 1000, "d"), (2000, 5555, "lost"), (3000, 3000, "self")]
    frame = spark.createDataFrame(rows, "id long, up long, name string")
    got = {r["id"]: (r["chain"], r["depth"]) for r in hierarchy.chains(frame, "id", "up", F.col("name")).collect()}
    assert got[n - 1] == ([f"n{k}" for k in range(n)], n - 1) and got[2000] == (["lost"], 0) and got[3000] == (["self"], 0)
    assert got[1000] == (["b", "a"], 2) and got[1003] == (["b", "a", "d"], 3)
    ends = {r["id"]: r["end"] for r in hierarchy.ends(frame, "id", "up").collect()}
    assert ends[n - 1] == 0 and ends[1003] is None and ends[2000] is None and ends[0] == 0


def plain_paths(edges, a, b, most):
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    out, todo = [], [[a]]
    while todo:
        p = todo.pop()
        if p[-1] == b and len(p) > 1:
            out.append(p)
        elif len(p) <= most:
            todo += [[*p, y] for y in near.get(p[-1], ()) if y not in p]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_paths_of_five_hops_and_shortest_ones(spark, seed):
    rng = random.Random(seed)
    edges = sorted({tuple(sorted(rng.sample(range(14), 2))) for _ in range(20)})
    frame = spark.createDataFrame(edges, "a long, b long")
    want = plain_paths(edges, 0, 13, 5)
    assert sorted(r["path"] for r in graph.simple_paths(frame, 0, 13, 5).collect()) == want
    every = plain_paths(edges, 0, 13, 13)
    short = min(every, key=lambda p: (len(p), p), default=None)
    got = [r["id"] for r in graph.shortest_path(frame, 0, 13).orderBy("step").collect()]
    assert got == (short or [])
    if short and len(short) > 2:
        assert graph.shortest_path(frame, 0, 13, len(short) - 2).collect() == []
    assert [r["id"] for r in graph.shortest_path(frame, 3, 3).collect()] == [3]


def test_a_page_tells_what_follows(spark):
    edges = spark.createDataFrame([(1, k, "r" if k < 8 else "s") for k in range(2, 12)], "a long, b long, relation string")
    nodes = spark.createDataFrame([(k, f"n{k}", "k") for k in range(1, 12)], "id long, name string, kind string")
    rows = graph.neighbourhood(nodes, edges, 1, relations=["r"], offset=4, limit=3).collect()
    assert [(r["id"], r["depth"], r["total"], r["has_more"]) for r in rows] == [(6, 1, 6, False), (7, 1, 6, False)]
    assert graph.neighbourhood(nodes, edges, 1, offset=0, limit=3).first()["has_more"]


def test_times_are_normalized(spark):
    from tessera.functions import temporal
    from tessera.plans import conflicts

    told = [x[0] for x in conflicts.TIMES] + ["100年到", "1900—1910", "疑为唐王朝"]
    want = [tuple(x[1:]) for x in conflicts.TIMES] + [("100年", 100, 100, "year", "certain"), ("1900-1910年", 1900, 1910, "year_range", "certain"), ("唐代", None, None, "period", "uncertain")]
    rows = spark.createDataFrame(list(enumerate(told)), "k int, x string").select("k", temporal.normalized(F.col("x")).alias("t")).orderBy("k").collect()
    assert [tuple(r["t"]) for r in rows] == want


def test_a_claim_that_is_known_exists_whatever_its_quote(spark):
    from tessera.operators import deltas

    schema = "id int, claim_type string, subject long, subject_status string, target string, target_status string, predicate string, temporal_role string, value string, quote string"
    rows = [
        (0, "property", 1, "EXACT", None, None, "始建年代", None, " A ", "updated"), (1, "property", 1, "EXACT", None, None, "始建年代", None, "b", "no longer"), (2, "property", 1, "EXACT", None, None, "始建年代", None, "b", "改为"),
        (3, "property", 1, "EXACT", None, None, "始建年代", None, "b", None), (4, "property", 1, "EXACT", None, None, "始建年代", "legend_time", "b", None), (5, "property", 2, "EXACT", None, None, "始建年代", None, "b", None),
        (6, "relation", 1, "EXACT", "t", None, "隶属", None, None, "now"), (7, "relation", 1, "EXACT", "u", None, "隶属", None, None, "now"), (8, "relation", 1, "EXACT", "u", None, "隶属", None, None, ""),
        (9, "relation", 1, "EXACT", "u", None, "毗邻", None, None, ""), (10, "relation", 1, "EXACT", "u", "NEW_ENTITY", "隶属", None, None, ""), (11, "property", 1, "AMBIGUOUS", None, "NEW_ENTITY", "x", None, "b", None), (12, "property", 1, None, None, None, "始建年代", None, "", None),
    ]
    properties = spark.createDataFrame([(1, "始建年代", "a"), (1, "始建年代", " A"), (1, "始建年代", " ")], "subject long, predicate string, value string")
    relations = spark.createDataFrame([(1, "隶属", "t"), (1, "毗邻", "t")], "subject long, predicate string, target string")
    got = deltas.knowledge_deltas(spark.createDataFrame(rows, schema), properties, relations).orderBy("id").collect()
    assert [r["operation"] for r in got] == ["EXISTS", "DEPRECATE", "UPDATE", "CONFLICT", "ADD", "ADD", "EXISTS", "UPDATE", "CONFLICT", "ADD", "MINT_ADD", "CONFLICT", "CONFLICT"]


def test_a_published_graph_is_searched_by_its_facts(spark):
    from tessera.operators import discovery

    nodes = spark.createDataFrame([(1, "Old Gate", "poi", None, None), (2, "gate", "poi", "x", 1), (3, "Hall", "building", "by the GATE", 1), (4, "Tower", "poi", None, 1), (5, None, "poi", None, None)], "id long, name string, kind string, description string, parent long")
    facts = spark.createDataFrame([(4, "named for", "Gates"), (4, "named for", "Gates"), (4, "x", None), (99, "gate", "y")], "node long, key string, value string")
    relations = spark.createDataFrame([(1, 2, "PARENT_OF", "w"), (1, 2, "PARENT_OF", "w"), (2, 1, "NEAR", "w"), (3, 3, "NEAR", "w"), (1, 77, "NEAR", "w")], "src long, dst long, relation string, label string")
    got = [(r["id"], r["match_score"], r["degree"], r["total"], r["has_more"]) for r in discovery.search(nodes, facts, relations, " GATE ", limit=3).orderBy(F.desc("match_score"), "id").collect()]
    assert got == [(2, 100, 2, 4, True), (1, 60, 3, 4, True), (3, 30, 1, 4, True)]
    assert {r["id"]: r["match_score"] for r in discovery.search(nodes, facts, relations, "", "poi").collect()} == {1: 20, 5: 20, 2: 0, 4: 0}
    with pytest.raises(ValueError):
        discovery.search(nodes, facts, relations, "x" * 101)
    some, within, totals = discovery.overview(nodes, facts, relations, 3, 1)
    assert [r["id"] for r in some.collect()] == [5, 1, 3] and within.count() == 1 and tuple(totals.first()) == (5, 5, 4, True, False)
    assert [r["facts"] for r in discovery.overview(nodes, facts, relations)[0].where("id = 4").collect()] == [[("named for", "Gates"), ("x", None)]]
    rows = discovery.detail(nodes, relations, 1, 1).collect()
    assert [(r["src"], r["dst"], r["neighbour_name"], r["total_relations"], r["truncated"]) for r in rows] == [(2, 1, "gate", 2, True)]
    assert discovery.detail(nodes, relations, 1234).collect() == []


def test_text_behind_a_json_value_is_no_json(spark):
    raws = ["7100 with. That, and; more", "[1], 2", '{"value": 1} {"value": 2}', '"a" b', "true story", "1] x"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(raws)], "k int, raw string").select("k", variants.values(F.col("raw")).alias("x")).orderBy("k").collect()
    assert [r["x"] for r in rows] == [[y.strip() for y in x.replace(";", ",").split(",")] for x in raws]
