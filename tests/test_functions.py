import math

from pyspark.sql import functions as F

from tessera.functions import keys, scoring, texts, vectors
from tessera.operators import claims, duplicates, graph, queues, retrieval
from tessera.plans import texts as texts_plan
from tessera.sources import html


def one(spark, column, **values):
    names, row = list(values), tuple(values.values())
    frame = spark.createDataFrame([row], names) if names else spark.range(1)
    return frame.select(column.alias("x")).first()["x"]


def bindings(spark, rows):
    return claims.fused(spark.createDataFrame(rows, "claim string, family string, kind string, score double"), ["claim"], "family", "kind", "score").first()


def test_one_source_family_counts_once(spark):
    assert bindings(spark, [("c", "a", "web", 0.5), ("c", "a", "web", 0.5)])["support"] == 0.5


def test_independent_families_combine(spark):
    row = bindings(spark, [("c", "a", "web", 0.5), ("c", "b", "web", 0.5)])
    assert row["support"] == 0.75 and row["families"] == 2


def test_several_kinds_of_sources_raise_agreement(spark):
    row = bindings(spark, [("c", "a", "web", 0.5), ("c", "b", "document", 0.5), ("c", "b", "document", 0.4)])
    assert row["evidence"] == 3 and math.isclose(row["cross_source"], 2 / 3 + 0.1)


def test_a_certain_source_makes_a_claim_certain(spark):
    assert bindings(spark, [("c", "a", "web", 1.0), ("c", "b", "web", 0.3)])["support"] == 1.0


def test_number_in_a_longer_number_is_no_match(spark):
    assert one(spark, texts.name_occurs(F.lit("306"), F.lit("030600"))) is False
    assert one(spark, texts.name_occurs(F.lit("306"), F.lit("room 306."))) is True
    assert one(spark, texts.name_occurs(F.lit("东门"), F.lit("东门小学"))) is True


def test_value_keys_ignore_brackets_and_spaces(spark):
    assert one(spark, texts.name_key(F.lit("(Main) Gate "))) == one(spark, texts.name_key(F.lit("main gate")))
    assert one(spark, texts.name_key(F.lit("1902"))) != one(spark, texts.name_key(F.lit("1903")))


def test_chunks_overlap_and_cover(spark):
    got = one(spark, texts.chunks(F.lit("x" * 2300)))
    assert [len(c) for c in got] == [1200, 1200, 260]
    assert one(spark, texts.chunks(F.lit(None).cast("string"))) == []


def test_claim_keys_differ_by_value_and_scopes_agree(spark):
    key = lambda v: one(spark, keys.claim_key(F.lit("s"), F.lit("p"), F.lit(v)))
    assert key("a") != key("b")
    assert one(spark, keys.pair_key(F.lit(1), F.lit(2))) == one(spark, keys.pair_key(F.lit(2), F.lit(1)))


def test_weighted_mean_leaves_nulls_out(spark):
    frame = spark.createDataFrame([(0.5, None), (None, None)], "a double, b double")
    assert [r[0] for r in frame.select(scoring.weighted_mean({"a": 1.0, "b": 3.0})).collect()] == [0.5, 0.0]


def test_dependencies_and_cursors(spark):
    assert [one(spark, claims.dependent_status(F.lit(s))) for s in ("PENDING", "ADOPTED", "REJECTED")] == ["BLOCKED_BY_DEPENDENCY", "PENDING", "INVALIDATED"]
    assert [one(spark, queues.cursor_state(F.lit(n), F.lit(d))) for n, d in ((0, 0), (2, 1), (2, 2))] == ["OPEN", "OPEN", "ADVANCED"]


def test_grounding_reasons(spark):
    reason = lambda e, q, v: one(spark, claims.grounded(F.lit(e), F.lit(q), F.lit(v)))
    assert reason("The Gate was built", "gate was", "built") is None
    assert reason("The Gate", "tower", "") == "QUOTE_NOT_FOUND" and reason("The Gate", "gate", "1902") == "VALUE_NOT_FOUND" and reason(" ", "", "") == "EMPTY_EVIDENCE"


def test_forty_entities_on_a_page_make_780_edges(spark):
    rows = spark.range(40).select(F.lit(1).alias("page"), F.col("id").alias("entity"))
    assert graph.co_occurrence(rows, "page", "entity").count() == 780


def test_recall_channels_keep_the_best_score_and_all_methods(spark):
    rows = spark.createDataFrame([("n1", 0.81, "TEXT"), ("n1", 0.88, "IMAGE"), ("n2", 0.70, "TEXT")], "node string, score double, method string")
    got = {r["node"]: (r["score"], r["methods"]) for r in retrieval.recall_channels(rows, "node", "score", "method").collect()}
    assert got == {"n1": (0.88, ["IMAGE", "TEXT"]), "n2": (0.70, ["TEXT"])}


def test_metrics_of_no_cases_are_zero(spark):
    row = retrieval.topk_metrics(spark.createDataFrame([], "hit int"), [], "hit", [1]).first()
    assert (row["cases"], row["recall_1"], row["mrr"]) == (0, 0.0, 0.0)


def test_vectors(spark):
    a, b = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, a)) == 1.0 and one(spark, vectors.cosine(a, b)) is None and one(spark, vectors.l2(a, b)) == 5.0
    assert one(spark, vectors.hamming(F.lit("1010"), F.lit("10011"))) == 3 and one(spark, vectors.average_hash(a)) == "01"


def test_components_take_the_smallest_id(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (7, 8), (8, 8)], "a long, b long")
    assert {r["id"]: r["component"] for r in duplicates.components(edges).collect()} == {3: 3, 4: 3, 5: 3, 9: 3, 7: 7, 8: 7}


def test_hamming_pairs_match_brute_force(spark):
    bits = ["".join("01"[(i * 7 + k * k * (i % 5)) % 3 == 0] for k in range(32)) for i in range(60)]
    frame = spark.createDataFrame(list(enumerate(bits)), "id long, bits string")
    want = {(i, j, d) for i in range(60) for j in range(i + 1, 60) if (d := sum(x != y for x, y in zip(bits[i], bits[j]))) <= 6}
    assert {tuple(r) for r in duplicates.hamming_pairs(frame, 6).select("a", "b", "distance").collect()} == want


def test_html_text_and_encodings():
    title, text = html.text_of("<title>T</title><style>p{}</style><p>one <b>two</b></p><script>x</script><table><tr><td>a<td>b</tr></table>")
    assert title == "T" and text == "one two\na | b"
    assert html.text_of(None) == ("", "")
    assert html.decoded("中文".encode("gb18030"))[0] == "中文" and html.decoded(b"")[0] == ""


def test_literals_round_the_exact_value(spark):
    rows = spark.createDataFrame([(1, [-0.0703125, 0.0234375, 1.0]), (2, [0.1, None]), (3, None), (4, [])], "k int, v array<float>")
    got = [r["x"] for r in rows.select("k", vectors.literal(F.col("v")).alias("x")).orderBy("k").collect()]
    assert got == ["[-0.070312,0.023438,1.000000]", "[0.100000]", None, "[]"]


def test_pages_are_parsed_slice_by_slice(spark, monkeypatch):
    """No more than a slice of a batch is held as Python strings, and every row comes back."""
    monkeypatch.setattr(html, "SLICE", 50)
    rows = [(i, None if i % 7 == 0 else f"<title>t{i}</title><p>{'word ' * (i % 30)}</p>") for i in range(60)]
    frame = spark.createDataFrame(rows, "page int, body string").coalesce(1)
    got = {r["id"]: (r["title"], r["text"]) for r in html.page_texts(frame, "page", "body").collect()}
    assert got == {i: html.text_of(x) for i, x in rows}
    files = frame.select("page", F.encode("body", "UTF-8").alias("body"))
    assert {r["id"]: (r["text"], r["encoding"]) for r in html.decode_files(files, "page", "body").collect()} == {i: (x or "", "utf-8") for i, x in rows}
    assert {r["id"]: (r["headings"], r["summary"]) for r in html.articles(frame, "page", "body").collect()} == {i: html.article_of(x) for i, x in rows}


def test_page_texts_and_titles_are_whole(spark, tmp_path):
    words, title = " ".join(f"word{i}" for i in range(300_000)), "t" * 300
    page = f"<title>{title}</title><nav>left out of it</nav><p>short</p><p>{words}</p>"
    spark.createDataFrame([(1, page)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [tuple(r) for r in texts_plan.s12_web_page_extraction(spark, str(tmp_path)).collect()] == [(1, title, words)]
    assert [tuple(r) for r in html.page_texts(spark.createDataFrame([(1, page)], "i long, h string"), "i", "h").collect()] == [(1, *html.text_of(page))]


def test_bands_of_hashes_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, f"{i * 2654435761 % (1 << 32):032b}") for i in range(40)], "id long, bits string")
    pairs = duplicates.hamming_pairs(rows, 6)
    pairs.collect()
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
