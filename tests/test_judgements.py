"""Numeric expectations of claim checks, resolution, mentions, assets and scopes."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import assets, claim_checks, dialogue, duplicates, evidence, resolution, retrieval, spaces, tools
from tessera.sources import html, uploads


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(x):
    return F.lit(x)


def lane(spark, kind, predicate, value, schema=False):
    return one(spark, claim_checks.lane(lit(kind), lit(predicate), lit(value), lit(schema)))


def test_lanes_of_claims(spark):
    assert lane(spark, "relation", "位于", "太原") == "RELATION"
    assert lane(spark, "property", "高度", "30米") == "PROPERTY" and lane(spark, None, "高度", "30米") == "PROPERTY"
    assert lane(spark, "property", "是否开放", "是") == "PROPERTY" and lane(spark, "property", "落实保护政策", "是") == "BACKGROUND"
    assert lane(spark, "property", "一个相当长而没有任何提示词的谓词", "是") == "BACKGROUND" and lane(spark, "property", "一个相当长而没有任何提示词的谓词", "是", True) == "PROPERTY"
    assert lane(spark, "fact", "高度", "30米") == "BACKGROUND"
    role = lambda p, raw="": one(spark, claim_checks.background_role(lit(p), lit(raw)))
    assert [role("建设目标"), role("保护方针"), role("始建年代"), role("开展活动"), role("颜色"), role("颜色", "成立于1902年")] == ["GOAL", "POLICY", "EVENT", "ACTION", "OTHER", "EVENT"]


def test_malformed_claims(spark):
    reason = lambda p, v, kind="property": one(spark, claim_checks.malformed(lit(kind), lit(p), lit(v)))
    assert reason("承担省级实验室建设", "是") == "CLAUSE_AS_PREDICATE_BOOLEAN_VALUE" and reason("推动“双一流”", "是") == "MALFORMED_PREDICATE_BOOLEAN_VALUE"
    assert reason("是否入选名录", "是") is None and reason("开放", "否") is None and reason("十三个字以上的一个很长的谓词啊", "否") == "CLAUSE_AS_PREDICATE_BOOLEAN_VALUE"
    assert reason("建成", "建成") == "CLAUSE_AS_PROPERTY_SELF_VALUE" and reason("打造文旅融合示范区", "文旅融合示范区") == "CLAUSE_AS_PROPERTY_SELF_VALUE"
    assert reason("建成", "很久以前") == "ACTION_CLAUSE_AS_PROPERTY" and reason("建成", "1902年") is None and reason("建成", "很久以前", "relation") is None


def test_trust_components_of_a_claim(spark):
    rows = [("c", "二郎庙", "高度", "30米", 1.0, None, "NEW", False, False, "f1", "web", "二郎庙高度30米", "高度30米", 5.0, True, 0.8, None, 0.9), ("c", "二郎庙", "高度", "30米", 1.0, None, "NEW", False, False, "f2", "image", "别的", "没有", 1.0, False, None, 0.5, 0.4)]
    ddl = "claim string, subject string, predicate string, value string, subject_score double, target_score double, operation string, ambiguous boolean, image_only boolean, family string, kind string, content string, quote string, retrieval double, located boolean, authority double, entailment double, confidence double"
    got = claim_checks.trust_components(spark.createDataFrame(rows, ddl), "claim").first()
    a = 0.2 * 0.8 + 0.1 + 0.15 + 0.1 + 0.25 * 0.9 + 0.1 * 0.9 + 0.1
    b = 0.2 * 0.5 + 0.1 * 0.2 + 0.15 * 0.45 + 0.1 * 0.65 + 0.25 * 0.5 + 0.1 * 0.4 + 0.1
    support = round(1 - (1 - round(a, 4)) * (1 - round(b, 4)), 4)
    assert (got["evidence"], got["families"], got["quality"], got["confidence"], got["risk"]) == (2, 2, 0.8, 0.9, 0.0)
    assert math.isclose(got["support"], support, abs_tol=1e-4) and math.isclose(got["cross_source"], 2 / 3 + 0.1, abs_tol=1e-4)
    assert math.isclose(got["trust"], 0.55 * got["support"] + 0.2 + 0.15 * 0.8 + 0.1 * got["cross_source"], abs_tol=1e-4)
    risk = lambda op, amb=False, image=False: one(spark, claim_checks.conflict_risk(lit(op), [F.when(lit(amb), "AMBIGUOUS")], lit(image)))
    assert [risk("CONFLICT"), risk("NEW", True), risk("UPDATE"), risk("NEW"), risk("NEW", image=True), risk("DEPRECATE", image=True)] == [1.0, 0.75, 0.55, 0.0, 0.35, 0.55]


def resolve(spark, decision, scores):
    recall = spark.createDataFrame([(1, decision, 9 if decision.startswith("AUTO") else None, 1)], "mention long, decision string, node long, candidates long")
    ranked = spark.createDataFrame([(1, k, s) for k, s in enumerate(scores)], "mention long, node long, score double")
    return resolution.resolved(recall, ranked).first()


def test_entity_resolution_by_name_score_and_margin(spark):
    exact = resolve(spark, "AUTO_EXACT_RECALL", [0.99])
    assert (exact["status"], exact["node"], exact["top1"]) == ("EXACT", 9, None)
    match = resolve(spark, "NO_GRAPH_MATCH", [0.92, 0.70])
    assert (match["status"], match["node"], match["margin"]) == ("SEMANTIC_MATCH", 0, 0.22)
    tie = resolve(spark, "NO_GRAPH_MATCH", [0.82, 0.79])
    assert (tie["status"], tie["node"]) == ("AMBIGUOUS", None)
    assert resolve(spark, "NO_GRAPH_MATCH", [0.55])["status"] == "NEW_ENTITY" and resolve(spark, "NO_GRAPH_MATCH", [])["status"] == "NEW_ENTITY"
    assert resolve(spark, "REVIEW_REQUIRED", [0.99])["status"] == "AMBIGUOUS" and resolve(spark, "NO_GRAPH_MATCH", [0.9, 0.89])["status"] == "AMBIGUOUS"


def test_name_recall_leaves_ambiguous_names_to_a_review(spark):
    nodes = spark.createDataFrame([(1, "TA"), (2, "甲"), (3, "甲"), (4, None)], "node long, name string")
    aliases = spark.createDataFrame([(2, "ta"), (5, "乙")], "node long, name string")
    asked = spark.createDataFrame([(1, " Ta "), (2, "甲"), (3, "乙!"), (4, "丙"), (5, None)], "mention long, name string")
    got = {r["mention"]: (r["decision"], r["node"], r["candidates"]) for r in resolution.name_recall(asked, nodes, aliases).collect()}
    assert got == {1: ("AUTO_EXACT_RECALL", 1, 1), 2: ("REVIEW_REQUIRED", None, 2), 3: ("AUTO_ALIAS_RECALL", 5, 1), 4: ("NO_GRAPH_MATCH", None, 0), 5: ("NO_GRAPH_MATCH", None, 0)}


def test_joint_scores(spark):
    score = lambda d, ev, cx, dist: one(spark, resolution.joint_score(lit(d), lit(ev), lit(cx), lit(dist).cast("double")))
    assert score("AUTO_EXACT_RECALL", 0.9, 1.0, None) == 0.83 and score("NO_GRAPH_MATCH", 0.9, 0.0, 0.1) == 0.316
    review = lambda d, s, dist: one(spark, resolution.review_decision(lit(d), lit(s), lit(dist).cast("double")))
    assert [review("AUTO_EXACT_RECALL", 0.83, None), review("NO_GRAPH_MATCH", 0.5, 0.1), review("NO_GRAPH_MATCH", 0.316, 0.1)] == ["REVIEW_READY_DETERMINISTIC", "REVIEW_REQUIRED_VECTOR_SUPPORT", "REVIEW_REQUIRED"]
    context = lambda *x: one(spark, resolution.context_score(*(lit(v).cast("long") for v in x)))
    assert [context(1, 2, 2, None), context(1, None, 2, 1), context(1, 5, 2, 5), context(1, 5, 2, 6), context(1, None, 2, None), context(1, 2, None, None)] == [1.0, 1.0, 0.55, 0.25, 0.25, 0.0]
    sure = lambda s, t=None, m=None: one(spark, resolution.certainty(lit(s), lit(t).cast("double"), lit(m).cast("double")))
    assert [sure("EXACT"), sure("ambiguous"), sure(None), sure("SEMANTIC_MATCH")] == [1.0, 0.25, 0.35, 0.82] and math.isclose(sure("SEMANTIC_MATCH", 0.9, 0.1), 0.6 * 0.82 + 0.27 + 0.05)


def test_types(spark):
    fits = lambda a, b, c=None: one(spark, resolution.type_compatible(lit(a), lit(b), lit(c)))
    assert fits("", "poi") and fits("景点", "POI") and fits("学校", "type_a1", "学校") and not fits("人物", "poi") and fits("type_a1=学校", "type_a1")
    kind = lambda raw, p, name: one(spark, resolution.inferred_type(lit(raw), lit(p), lit(name)))["kind"]
    assert [kind("poi", "", "太原理工大学"), kind("", "设计者", "张三"), kind(None, None, "二郎庙"), kind("person", "", "钟楼"), kind("poi", "", "东门")] == ["organization", "person", "building", "person", "poi"]


def test_mentions_prefer_long_unique_names(spark):
    texts = spark.createDataFrame([(1, "太原理工大学东门位于校园东侧。"), (2, "实验室正在建设。"), (3, "030600"), (4, "号 306。"), (5, None)], "k long, text string")
    nodes = spark.createDataFrame([(1, "东门"), (2, "太原理工大学"), (3, "实验室"), (4, "实验室"), (5, "306"), (6, "侧"), (7, None)], "id long, name string")
    got = evidence.mentions(texts, nodes, "k", "text").orderBy("k", "place").collect()
    assert [(r["k"], r["id"], r["place"]) for r in got] == [(1, 2, 1), (1, 1, 2), (4, 5, 1)]
    assert [r["id"] for r in evidence.mentions(texts, nodes, "k", "text", 1).where("k = 1").collect()] == [2]


def test_batches_keep_their_budgets(spark):
    units = spark.createDataFrame([(r, k, k % 4 == 0, float(k % 3)) for r in (1, 2) for k in range(50)], "run long, unit long, is_image boolean, priority double")
    rows = evidence.claim_batches(units, 7, 2).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault((r["run"], r["is_image"], r["batch"]), []).append((r["priority"], r["unit"]))
    assert len(rows) == 100 and all(len(v) <= (2 if k[1] else 7) for k, v in sizes.items())
    for run, image in itertools.product((1, 2), (True, False)):
        flat = [x for b in range(1, 99) for x in sorted(sizes.get((run, image, b), []))]
        assert flat == sorted(flat)


def test_numbers_go_on_over_tasks(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("o"))
    got = evidence.numbered(rows, ["g"], ["o"], 8).orderBy("g", "o").collect()
    assert [r["place"] for r in got] == [k for g in range(3) for k in range(1, 1 + sum(1 for i in range(1000) if i % 3 == g))]


def test_source_scopes():
    assert evidence.source_scope() == {"provided_evidence", "domain_kb"} and evidence.source_scope(depth=0, web_search=True) == {"provided_evidence", "web_search"}
    assert evidence.source_scope("kb, web;extractor") == {"domain_kb", "web_search", "web_extractor"} and evidence.source_scope(["KB"], depth=0) == {"provided_evidence"}
    assert evidence.source_scope("kb", retrieval="node", web_extractor=True) == {"web_extractor"}
    assert evidence.planned_sources({"provided_evidence", "domain_kb"}, True, {}) == ["provided_evidence", "domain_kb"] and evidence.planned_sources({"web_search"}, False, {}) == ["none"]


def test_asset_bindings(spark):
    rows = [("a", " 1 ", None), ("", "1", "node"), (None, "1", None), ("a", "", None), ("a", "7", "node"), ("a", "1", "edge")]
    got = assets.binding_reasons(spark.createDataFrame(rows, "asset string, target string, object_type string"), spark.createDataFrame([("1",), (None,), (" ",)], "target string")).collect()
    assert sorted(r["reason"] for r in got) == sorted(["OK", "ASSET_ID_REQUIRED", "ASSET_ID_REQUIRED", "TARGET_NODE_ID_REQUIRED", "TARGET_NODE_NOT_FOUND", "UNSUPPORTED_OBJECT_TYPE"])


def test_pair_actions(spark):
    action = lambda *x: one(spark, assets.pair_action(*(lit(v).cast(t) for v, t in zip(x, ("boolean", "boolean", "boolean", "double", "int"), strict=True))))
    assert action(True, True, True, 0.0, 0) == "same_node_duplicate_keep_one" and action(False, False, True, None, None) == "cross_node_exact_duplicate_manual_review"
    assert action(False, None, None, 1e-7, 9) == "cross_node_simclr_identical_manual_review" and action(False, None, None, 0.5, 5) == "cross_node_near_duplicate_manual_review"
    assert action(False, False, False, None, None) == "no_action" == action(False, False, False, 0.5, 6)


def test_cluster_decisions(spark):
    cases = {
        "auto_hard_negative": ["exact_node_match", "alias_match"], "mixed": ["exact_node_match", "unresolved"], "possible_wrong_binding": ["conflicting_node_match", "multi_node_match"],
        "possible_shared_image": ["multi_node_match", "exact_node_match"], "unresolved": ["parent_only_match"], "unresolved ": ["no_effective_text", "low_confidence"],
    }
    rows = spark.createDataFrame([(c, s) for c, x in cases.items() for s in x], "cluster string, status string")
    assert all(r["decision"] == r["cluster"].strip() for r in assets.cluster_decision(rows).collect())


def test_image_evidence_within_budgets(spark):
    claims = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1), (2, 13, 3)], "run long, claim long, node long")
    rows = spark.createDataFrame([(k, 1, "u", k) for k in range(6)] + [(20, 2, "u", 1), (21, 2, " ", 9), (30, 3, None, 1)], "asset long, node long, url string, updated long")
    scores = spark.createDataFrame([(10, 5, 0.2), (10, 4, 0.9), (10, 0, 1.0), (11, 20, 0.5)], "claim long, asset long, score double")
    got = {r["claim"]: (r["status"], r["asset_count"], r["support"], r["assets"]) for r in assets.ranked_evidence(claims, rows, scores).collect()}
    assert got == {10: ("SCORED", 3, 0.9, [4, 5]), 11: ("SCORED", 1, 0.5, [20]), 12: ("UNAVAILABLE", 3, None, [])}
    assert {r["claim"] for r in assets.ranked_evidence(claims, rows, scores, per_run=3).collect()} == {10, 12}


def test_places_raise_scores(spark):
    tree = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 0)], "space long, parent long")
    pairs = spaces.closure(tree)
    assert sorted(tuple(r) for r in pairs.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2)]
    where = {r["space"]: r["where"] for r in spaces.relation(pairs, spark.createDataFrame([(7, 1)], "question long, here long")).collect()}
    assert where == {1: "same", 0: "above", 2: "below"}
    score = lambda w, named, topic=None: one(spark, spaces.unit_score(lit("钟楼在哪"), lit("钟楼高"), lit(w), lit(named), lit(topic), lit("历史")))
    assert [score(None, False), score("same", False), score("above", True), score("below", False, "历史")] == pytest.approx([0.5, 1.0, 1.8, 1.35])
    boost = lambda c, words, same, topic, unit: one(spark, spaces.boosted(lit(c), lit("钟楼"), F.array(*map(lit, words)).cast("array<string>"), lit(same), lit(topic), lit(unit)))
    assert [boost(0.4, ["钟楼"], True, "路线", "设施"), boost(0.4, ["楼"], True, "路线", "历史"), boost(0.2, [], True, "历史", "历史"), boost(0.4, [], True, "建筑", "")] == pytest.approx([0.94, 0.44, 0.2, 0.48])


def test_replies(spark):
    got = [one(spark, dialogue.reply(lit(x))) for x in ("是的", "还没完成", "OK!", "", None, "hmm", "不对")]
    assert got == ["affirmative", "negative", "affirmative", "none", "none", "none", "negative"]
    turns = spark.createDataFrame([(1, 0, "assistant", "? " + dialogue.PENDING), (1, 1, "user", "好的"), (2, 0, "user", "好的"), (3, 0, "assistant", None)], "c long, t long, role string, text string")
    assert {r["c"]: r["confirmed"] for r in dialogue.confirmed(turns, "c", "t").collect()} == {1: True, 2: False, 3: False}


def test_first_hits_and_label_scores_match_a_full_ranking(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"), F.col("label").alias("q_label"))
    g = e.select(F.col("vec_id").alias("gid"), F.col("embedding").alias("vec"), F.col("label").alias("g_label"))
    rows = retrieval.scored_pairs(q, g, None).join(q.drop("vec"), "qid").join(g.drop("vec"), "gid").collect()
    assert all(r["gid"] != r["qid"] for r in rows)
    best = {}
    for r in rows:
        if r["q_label"] == r["g_label"]:
            best[r["qid"]] = min(best.get(r["qid"], 10**9), r["rank"])
    assert {r["qid"]: r["hit"] for r in retrieval.first_hits(q, g).collect()} == best
    for r in retrieval.label_scores(q, g).collect():
        s = sorted((x["score"] for x in rows if x["qid"] == r["qid"] and x["g_label"] == r["g_label"]), reverse=True)
        assert math.isclose(r["max_score"], s[0]) and math.isclose(r["mean_score"], sum(s) / len(s), abs_tol=1e-9) and math.isclose(r["top3_mean"], sum(s[:3]) / len(s[:3]))


def test_passages_of_any_length(spark):
    docs = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz" * 3), (2, "xy"), (3, ""), (4, None)], "d long, t string")
    passages = spark.createDataFrame([(1, "cdefghijklmnop"), (2, "xy"), (3, "y"), (4, ""), (5, "mnopqrstuvwxyz!"), (6, "fghij")], "i long, p string")
    got = sorted((r["d"], r["i"], r["whole"]) for r in retrieval.held_beginnings(docs, passages, "d", "t", "i", "p", 12).collect())
    assert got == [(1, 1, True), (1, 2, True), (1, 3, True), (1, 5, False), (1, 6, True), (2, 2, True), (2, 3, True)]


def test_more_rows_take_longer_keys():
    assert [duplicates.bands_for(n, 64, 5) for n in (10, 10**5, 10**7, 10**9)] == [1, 2, 2, 3]


def test_uploads_and_archives(spark, tmp_path):
    parts = spark.createDataFrame([(1, 1, b"b", 0), (1, 0, b"a", 0), (1, 1, b"B", 1), (2, 2, b"x", 0), (2, 9, b"y", 0)], "upload long, part int, content binary, arrival int")
    tasks = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "upload long, total_parts int")
    got = {r["upload"]: (r["received"], r["uploaded_bytes"], r["progress"], r["status"], r["missing"]) for r in uploads.progress(parts, tasks).collect()}
    assert got == {1: (2, 2, 100, "UPLOADED", []), 2: (1, 1, 33, "UPLOADING", [0, 1]), 3: (0, 0, 0, "UPLOADING", [0])}
    assert [(r["upload"], bytes(r["content"])) for r in uploads.assembled(parts, tasks).collect()] == [(1, b"aB")]
    uploads.write_parts(spark.range(100).select((F.col("id") * 37 % 100).alias("k")), str(tmp_path / "a"), "k", 4)
    lines = [line for f in sorted((tmp_path / "a").glob("part-*")) for line in f.read_text().split()]
    assert lines == [f'{{"k":{k}}}' for k in range(100)]


def test_registries_topics_and_graph_tools(spark):
    registry = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("l", "m"), ("m", "l")], "key string, alias_for string")
    assert {r["key"]: r["resolved"] for r in tools.resolved_aliases(registry).collect()} == {"a": "c", "b": "c", "c": "c", "x": None, "l": None, "m": None}
    nodes = spark.createDataFrame([(1, "Red ring", False), (2, "red ring box", False), (3, "a red ring", True), (4, "blue", True)], "id long, name string, is_root boolean")
    degrees = spark.createDataFrame([(2, 5), (3, 9)], "id long, degree long")
    assert [(r["id"], r["tier"]) for r in tools.search(nodes, degrees, " RED ring").collect()] == [(1, 100), (2, 80), (3, 60)] and [r["id"] for r in tools.search(nodes, degrees, "").collect()] == [3, 4, 2, 1]
    edges = spark.createDataFrame([(1, 2), (1, 3), (3, 4)], "a long, b long")
    assert tools.detail(nodes, edges, 1).first()["neighbours"] == [2, 3] and {r["id"]: r["depth"] for r in tools.explore(edges, nodes.where("id = 2").select("id")).collect()} == {2: 0, 1: 1, 3: 2}


def test_decoded_files_and_archive_search_match_plain_python(spark):
    files = [(1, "héllo 中文".encode()), (2, "中文网页".encode("gb18030")), (3, b"\xef\xbb\xbfbom"), (4, b""), (5, None)]
    rows = html.decode_files(spark.createDataFrame(files, "id long, content binary"), "id", "content").collect()
    assert {r["id"]: r["text"] for r in rows} == {1: "héllo 中文", 2: "中文网页", 3: "\ufeffbom", 4: "", 5: ""}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    from tessera.plans import more

    want = {}
    for r in pages.collect():
        low = html.text_of(r["html"])[1].lower()
        if hits := ("the" in low) + ("article" in low):
            want[r["page_id"]] = (hits, hits + 0.8)
    assert {r["id"]: (r["hits"], float(r["score"])) for r in more.s10_archive_search(spark, "/root/testdata/sf0.001").collect()} == want
