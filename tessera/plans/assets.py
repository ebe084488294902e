"""Queries of image assets, uploads, topic trees, registries and graph tools."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import assets as A
from tessera.operators import evidence, tools
from tessera.sources import stages, uploads

from .fixtures import pick, pick_sql
from .registry import Registry
from .shared import t
from .vectors import PAIRS, ranked

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

OBJECTS = ["node", None, "edge", "node", "node"]


@register(f"""WITH b AS (SELECT l_orderkey * 8 + l_linenumber AS binding, CASE WHEN l_linenumber = 3 THEN ' ' WHEN l_linenumber = 6 THEN NULL ELSE 'a' || l_orderkey END AS asset, CASE WHEN l_linenumber = 4 THEN '' WHEN l_quantity > 45 THEN 'x' || l_partkey ELSE ' ' || l_partkey || ' ' END AS target, {pick_sql(OBJECTS, 'l_orderkey')} AS o FROM lineitem)
    SELECT binding, CASE WHEN o <> 'node' THEN 'UNSUPPORTED_OBJECT_TYPE' WHEN trim(coalesce(asset, '')) = '' THEN 'ASSET_ID_REQUIRED' WHEN trim(target) = '' THEN 'TARGET_NODE_ID_REQUIRED' WHEN trim(target) NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 5) THEN 'TARGET_NODE_NOT_FOUND' ELSE 'OK' END AS reason FROM b""")
def f15_asset_binding_guard(spark, sf_dir):
    o, n, p = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey"))
    asset = F.when(n == 3, " ").when(n == 6, None).otherwise(F.concat(F.lit("a"), o.cast("string")))
    target = F.when(n == 4, "").when(F.col("l_quantity") > 45, F.concat(F.lit("x"), p.cast("string"))).otherwise(F.concat(F.lit(" "), p.cast("string"), F.lit(" ")))
    rows = t(spark, sf_dir, "lineitem").select((o * 8 + n).alias("binding"), asset.alias("asset"), target.alias("target"), pick(OBJECTS, o).alias("object_type"))
    return A.binding_reasons(rows, t(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("target"))).select("binding", "reason")


@register("""WITH p AS (SELECT a.vec_id, a.label = b.label AS node, a.vec_id % 7 = 0 AS url, CASE WHEN a.vec_id % 11 = 0 THEN true END AS sha, CASE WHEN a.vec_id % 5 = 0 THEN NULL WHEN a.vec_id % 13 = 0 THEN 0 ELSE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END AS d, CASE WHEN a.vec_id % 3 = 0 THEN (a.vec_id // 3) % 9 END AS h FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT vec_id, CASE WHEN node THEN 'same_node_duplicate_keep_one' WHEN url OR coalesce(sha, false) THEN 'cross_node_exact_duplicate_manual_review' WHEN d <= 0.000001 THEN 'cross_node_simclr_identical_manual_review' WHEN h <= 5 THEN 'cross_node_near_duplicate_manual_review' ELSE 'no_action' END AS action FROM p""")
def h25_pair_actions(spark, sf_dir):
    e, v = t(spark, sf_dir, "embeddings"), F.col("vec_id")
    rows = e.join(e.select((v - 1).alias("vec_id"), F.col("label").alias("other"), F.col("embedding").alias("y")), "vec_id")
    distance = F.when(v % 5 == 0, None).when(v % 13 == 0, 0.0).otherwise(V.l2(F.col("embedding"), F.col("y")))
    action = A.pair_action(F.col("label") == F.col("other"), v % 7 == 0, F.when(v % 11 == 0, True), distance, F.when(v % 3 == 0, F.floor(v / 3) % 9))
    return rows.select("vec_id", action.alias("action"))


@register("""WITH x AS (SELECT vec_id AS id, 'u' || (vec_id // 3) AS url, CASE WHEN vec_id % 4 > 0 THEN 's' || (vec_id % 50) END AS sha FROM embeddings), p AS (SELECT min(id) OVER (PARTITION BY url) AS a, id AS b FROM x UNION SELECT min(id) OVER (PARTITION BY sha), id FROM x WHERE sha IS NOT NULL) SELECT a, b FROM p WHERE a < b""")
def j12_exact_pairs(spark, sf_dir):
    v = F.col("vec_id")
    rows = t(spark, sf_dir, "embeddings").select(v.alias("id"), F.concat(F.lit("u"), F.floor(v / 3).cast("string")).alias("url"), F.when(v % 4 > 0, F.concat(F.lit("s"), (v % 50).cast("string"))).alias("sha"))
    return A.exact_pairs(rows, ["url", "sha"])


#: A cluster is 40 parts in a row; an image of each shows letters that name its node, others, its parent, or nothing.
LETTERS = """a AS (SELECT p_partkey // 40 AS cluster, p_partkey AS asset, p_partkey AS node, CASE p_partkey % 7 WHEN 0 THEN 'N' || p_partkey || ' gate' WHEN 1 THEN upper(p_brand) || '/' || p_partkey WHEN 2 THEN 'N' || p_partkey || ' and N' || (p_partkey // 40 * 40 + 5) || ' x' WHEN 3 THEN '' WHEN 4 THEN p_type || ' wing' WHEN 5 THEN 'N' || (p_partkey // 40 * 40 + 9) || ' y' ELSE '??' END AS text,
    CASE WHEN p_partkey % 17 = 0 THEN 'error' ELSE 'ok' END AS state, (p_partkey % 20) / 20.0 + 0.3 AS score FROM part),
    t AS (SELECT p_partkey // 40 AS cluster, p_partkey AS other, lower('N' || p_partkey || CASE WHEN p_partkey % 7 IN (0, 2) THEN 'gate' ELSE '' END) AS term, true AS is_name FROM part UNION ALL SELECT p_partkey // 40, p_partkey, lower(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || p_partkey), false FROM part UNION ALL SELECT p_partkey // 40, p_partkey, lower('N' || p_partkey || 'and'), false FROM part),
    k AS (SELECT *, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS key FROM a), h AS (SELECT k.asset, list_sort(list(DISTINCT other)) AS matched, bool_or(other = node AND is_name) AS by_name, bool_or(other = node) AS own FROM k JOIN t USING (cluster) WHERE contains(key, term) GROUP BY ALL),
    s AS (SELECT k.*, matched, CASE WHEN state <> 'ok' THEN 'unresolved' WHEN key = '' THEN 'no_effective_text' WHEN score < 0.55 THEN 'low_confidence' WHEN own AND len(matched) = 1 THEN CASE WHEN by_name THEN 'exact_node_match' ELSE 'alias_match' END WHEN own THEN 'multi_node_match' WHEN len(matched) > 0 THEN 'conflicting_node_match'
        WHEN contains(key, lower(p_type)) THEN 'parent_only_match' ELSE 'no_effective_text' END AS status FROM k LEFT JOIN h USING (asset) JOIN part ON p_partkey = k.node)"""


def letters(spark, sf_dir):
    p = F.col("p_partkey")
    number, first = p.cast("string"), F.floor(p / 40) * 40
    n, part = F.concat(F.lit("N"), number), t(spark, sf_dir, "part")
    other = lambda k: F.concat(F.lit("N"), (first + k).cast("string"))
    text = F.when(p % 7 == 0, F.concat(n, F.lit(" gate"))).when(p % 7 == 1, F.concat(F.upper("p_brand"), F.lit("/"), number)).when(p % 7 == 2, F.concat(n, F.lit(" and "), other(5), F.lit(" x")))
    text = text.when(p % 7 == 3, "").when(p % 7 == 4, F.concat("p_type", F.lit(" wing"))).when(p % 7 == 5, F.concat(other(9), F.lit(" y"))).otherwise("??")
    cluster = F.floor(p / 40).alias("cluster")
    rows = part.select(cluster, p.alias("asset"), p.alias("node"), text.alias("text"), F.when(p % 17 == 0, "error").otherwise("ok").alias("state"), ((p % 20) / 20.0 + 0.3).alias("score"))
    term = lambda x, name: part.select(cluster, p.alias("node"), x.alias("term"), F.lit(name).alias("is_name"))
    terms = term(F.concat(n, F.when((p % 7).isin(0, 2), " gate").otherwise("")), True).unionByName(term(F.concat("p_brand", F.lit(" "), number), False)).unionByName(term(F.concat(n, F.lit(" and")), False))
    return A.letters_status(rows, terms, part.select(p.alias("node"), F.col("p_type").alias("term")))


@register(f"WITH {LETTERS} SELECT cluster, asset, status, CASE WHEN status NOT IN ('unresolved', 'low_confidence') THEN matched END AS matched FROM s")
def h27_asset_status(spark, sf_dir):
    return letters(spark, sf_dir).select("cluster", "asset", "status", "matched")


@register(f"""WITH {LETTERS}, c AS (SELECT cluster, count(*) AS n, count(*) FILTER (status NOT IN ('no_effective_text', 'low_confidence', 'unresolved')) AS useful, count(*) FILTER (status = 'conflicting_node_match') AS x, count(*) FILTER (status = 'multi_node_match') AS m, count(*) FILTER (status = 'parent_only_match') AS p, count(*) FILTER (status IN ('exact_node_match', 'alias_match')) AS o
        FROM (SELECT asset % 90 AS cluster, status FROM s UNION ALL SELECT 1000 + asset % 7, status FROM s) GROUP BY ALL)
    SELECT cluster, n, useful, CASE WHEN useful <= 0 THEN 'unresolved' WHEN x > 0 THEN 'possible_wrong_binding' WHEN m > 0 THEN 'possible_shared_image' WHEN p = useful THEN 'unresolved' WHEN o = useful AND useful = n THEN 'auto_hard_negative' WHEN o > 0 THEN 'mixed' ELSE 'unresolved' END AS decision FROM c""")
def h27_cluster_decision(spark, sf_dir):
    rows = stages.stage(letters(spark, sf_dir).select("asset", "status"), "statuses")
    return A.cluster_decision(rows.select((F.col("asset") % 90).alias("cluster"), "status").unionByName(rows.select((1000 + F.col("asset") % 7).alias("cluster"), "status")))


ACTIONS = ["keep", "exclude_shared", "needs_rebind", "drop"]


@register(f"""WITH i AS (SELECT vec_id AS asset, vec_id // 4 AS node, CASE WHEN vec_id % 4 = 0 THEN 'query' ELSE 'gallery' END AS role, CASE WHEN vec_id % 13 = 0 THEN false WHEN vec_id % 2 = 0 THEN true END AS usable, CASE WHEN vec_id % 5 = 0 THEN {pick_sql(ACTIONS, 'vec_id // 5')} END AS action FROM embeddings),
    d AS (SELECT *, CASE WHEN action IS NULL THEN coalesce(usable, true) ELSE action = 'keep' END AS ok, CASE WHEN action IS NULL OR action = 'keep' THEN NULL WHEN action = 'exclude_shared' THEN 'shared_image_excluded' WHEN action = 'needs_rebind' THEN 'wrong_binding_needs_rebind' ELSE 'duplicate_excluded' END AS why FROM i),
    n AS (SELECT node FROM d WHERE ok GROUP BY node HAVING count(DISTINCT role) = 2) SELECT asset, ok AND node IN (SELECT node FROM n) AS usable, CASE WHEN ok AND node NOT IN (SELECT node FROM n) THEN 'node_without_query_gallery' ELSE why END AS reason FROM d""")
def h30_cluster_decisions(spark, sf_dir):
    v = F.col("vec_id")
    e = t(spark, sf_dir, "embeddings")
    items = e.select(v.alias("asset"), F.floor(v / 4).alias("node"), F.when(v % 4 == 0, "query").otherwise("gallery").alias("role"), F.when(v % 13 == 0, False).when(v % 2 == 0, True).alias("usable"))
    decisions = e.where(v % 5 == 0).select(v.alias("asset"), pick(ACTIONS, F.floor(v / 5)).alias("action"))
    return A.apply_decisions(items, decisions).select("asset", "usable", "reason")


@register("""WITH c AS (SELECT o_custkey % 7 AS run, o_orderkey AS claim, o_custkey % 97 AS node FROM orders), a AS (SELECT l_orderkey * 8 + l_linenumber AS asset, l_partkey % 97 AS node, CASE WHEN l_linenumber % 5 > 0 THEN 'http://x/' || l_linenumber ELSE ' ' END AS url, l_shipdate AS updated FROM lineitem),
    f AS (SELECT * FROM a WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY node ORDER BY updated DESC NULLS LAST, asset) <= 3), n AS (SELECT run, node, asset FROM (SELECT DISTINCT run, node FROM c) JOIN f USING (node) QUALIFY row_number() OVER (PARTITION BY run ORDER BY node, asset) <= 40),
    s AS (SELECT claim, asset, CASE WHEN claim % 4 > 0 AND (claim + asset) % 3 > 0 THEN round(((claim * 31 + asset * 17) % 1000) / 1000.0, 4) END AS score FROM c JOIN n USING (run, node))
    SELECT claim, CASE WHEN count(score) > 0 THEN 'SCORED' ELSE 'UNAVAILABLE' END AS status, count(*) AS asset_count, max(score) AS support, coalesce(list(asset ORDER BY score DESC, asset) FILTER (score IS NOT NULL), []) AS assets FROM s GROUP BY claim""")
def k17_multimodal_rerank(spark, sf_dir):
    o, claim, asset = t(spark, sf_dir, "orders"), F.col("claim"), F.col("asset")
    claims = o.select((F.col("o_custkey") % 7).alias("run"), F.col("o_orderkey").alias("claim"), (F.col("o_custkey") % 97).alias("node"))
    n = F.col("l_linenumber")
    assets = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + n).alias("asset"), (F.col("l_partkey") % 97).alias("node"), F.when(n % 5 > 0, F.concat(F.lit("http://x/"), n.cast("string"))).otherwise(" ").alias("url"), F.col("l_shipdate").alias("updated"))
    # What a reranker would give: a score for some of the pairs of a claim and a late asset of its node.
    late = A.first_by_key(assets.where("trim(url) <> ''"), ["node"], [F.col("updated").desc_nulls_last(), asset], 3)
    scores = claims.join(late.select("node", "asset"), "node").where((claim % 4 > 0) & ((claim + asset) % 3 > 0)).select("claim", "asset", F.round(((claim * 31 + asset * 17) % 1000) / 1000.0, 4).alias("score"))
    return A.ranked_evidence(claims, assets, scores, 3, 40)


@register("""WITH c AS (SELECT o_custkey AS cluster, o_orderkey AS ordinal, list(l_partkey ORDER BY l_linenumber) AS assets FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), x AS (SELECT ordinal, unnest(assets) AS asset FROM c) SELECT asset, max(ordinal) AS ordinal FROM x WHERE asset NOT IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY asset""")
def s32_cluster_feed(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ordinal")).agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("assets"))
    clusters = t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("ordinal")).join(li, "ordinal")
    return A.last_of_each(clusters, t(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("asset")))


@register("""WITH b AS (SELECT p_partkey AS id, p_type AS domain FROM part WHERE p_size > 5), x AS (SELECT domain, unnest(list(id)) AS id FROM b WHERE domain IN (SELECT DISTINCT p_type FROM part WHERE p_type < 'M') GROUP BY domain) SELECT p_partkey AS id, coalesce(x.domain, 'other') AS topic FROM part LEFT JOIN x ON x.id = p_partkey""")
def s28_topic_assignment(spark, sf_dir):
    part = t(spark, sf_dir, "part")
    tree = part.where("p_size > 5 AND p_type < 'M'").groupBy(F.col("p_type").alias("domain"), F.col("p_brand").alias("concept")).agg(F.sort_array(F.collect_list("p_partkey")).alias("item_ids"))
    tree = tree.groupBy("domain").agg(F.collect_list(F.struct("concept", "item_ids")).alias("concepts"))
    return tools.topics(part.select(F.col("p_partkey").alias("id")), tree, "other")


#: Parts of uploads: an order's lines, some twice, some missing.
PARTS = """p AS (SELECT l_orderkey AS upload, l_linenumber - 1 AS part, l_returnflag || l_linestatus || l_partkey AS content, 0 AS arrival FROM lineitem WHERE (l_orderkey + l_linenumber) % 9 > 0 UNION ALL SELECT l_orderkey, l_linenumber - 1, 'again' || l_suppkey, 1 FROM lineitem WHERE l_linenumber = 2),
    k AS (SELECT l_orderkey AS upload, max(l_linenumber) AS total_parts FROM lineitem GROUP BY ALL), u AS (SELECT upload, part, max(length(content)) AS size, max({'a': arrival, 'c': content}).c AS content FROM p GROUP BY ALL)"""


def parts(spark, sf_dir):
    li, n = t(spark, sf_dir, "lineitem"), F.col("l_linenumber")
    base = li.where((F.col("l_orderkey") + n) % 9 > 0).select(F.col("l_orderkey").alias("upload"), (n - 1).alias("part"), F.encode(F.concat("l_returnflag", "l_linestatus", F.col("l_partkey").cast("string")), "UTF-8").alias("content"), F.lit(0).alias("arrival"))
    again = li.where(n == 2).select(F.col("l_orderkey").alias("upload"), (n - 1).alias("part"), F.encode(F.concat(F.lit("again"), F.col("l_suppkey").cast("string")), "UTF-8").alias("content"), F.lit(1).alias("arrival"))
    return base.unionByName(again), li.groupBy(F.col("l_orderkey").alias("upload")).agg(F.max("l_linenumber").alias("total_parts"))


@register(f"""WITH {PARTS} SELECT k.upload, count(u.part) AS received, coalesce(sum(size), 0)::BIGINT AS uploaded_bytes, least(100, count(u.part) * 100 // any_value(total_parts)) AS progress, CASE WHEN count(u.part) >= any_value(total_parts) THEN 'UPLOADED' ELSE 'UPLOADING' END AS status,
    list_filter(range(0, any_value(total_parts)), lambda x: NOT list_contains(coalesce(list(u.part) FILTER (u.part IS NOT NULL), []), x)) AS missing FROM k LEFT JOIN u ON u.upload = k.upload GROUP BY k.upload""")
def s7_upload_progress(spark, sf_dir):
    return uploads.progress(*parts(spark, sf_dir))


@register(f"WITH {PARTS} SELECT upload, md5(string_agg(content, '' ORDER BY part)) AS digest FROM u JOIN k USING (upload) GROUP BY upload HAVING count(*) = any_value(total_parts)")
def s7_chunk_assembly(spark, sf_dir):
    return uploads.assembled(*parts(spark, sf_dir)).select("upload", F.md5("content").alias("digest"))


@register("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def s23_partitioned_archive(spark, sf_dir):
    path = stages.new_path(spark, "archive")
    uploads.write_parts(t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, "o_orderkey")
    return uploads.read_parts(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double")


@register("SELECT 'nation' AS table_name, column_name, ordinal_position AS place FROM (DESCRIBE SELECT * FROM nation) x(column_name, a, b, c, d, e) POSITIONAL JOIN (SELECT unnest(range(1, 5)) AS ordinal_position) UNION ALL SELECT 'region', column_name, ordinal_position FROM (DESCRIBE SELECT * FROM region) x(column_name, a, b, c, d, e) POSITIONAL JOIN (SELECT unnest(range(1, 4)) AS ordinal_position)".replace("(DESCRIBE SELECT * FROM nation) x(column_name, a, b, c, d, e) POSITIONAL JOIN (SELECT unnest(range(1, 5)) AS ordinal_position)", "(VALUES ('n_nationkey', 1), ('n_name', 2), ('n_regionkey', 3)) x(column_name, ordinal_position)").replace("(DESCRIBE SELECT * FROM region) x(column_name, a, b, c, d, e) POSITIONAL JOIN (SELECT unnest(range(1, 4)) AS ordinal_position)", "(VALUES ('r_regionkey', 1), ('r_name', 2)) x(column_name, ordinal_position)"))
def s24_catalog_columns(spark, sf_dir):
    return tools.columns(spark, {name: t(spark, sf_dir, name) for name in ("nation", "region")})


@register("SELECT doc_id, source, lang FROM documents ORDER BY doc_id LIMIT 50 OFFSET 50")
def s24_table_preview(spark, sf_dir):
    return tools.preview(t(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id", page=2)


# ---- models, sources and the graph's tools

MODELS = [("legacy_image", "old_image"), ("old_image", "image_v1"), ("image_v1", None), ("text_v1", None), ("lost", "nowhere")]


@register("""WITH m(key, alias_for) AS (VALUES ('legacy_image', 'old_image'), ('old_image', 'image_v1'), ('image_v1', NULL), ('text_v1', NULL), ('lost', 'nowhere')), e AS (SELECT vec_id, list_extract(['legacy_image', 'image_v1', 'text_v1', 'lost', 'unknown'], vec_id % 5 + 1) AS model FROM embeddings)
    SELECT vec_id, model, CASE model WHEN 'legacy_image' THEN 'image_v1' WHEN 'image_v1' THEN 'image_v1' WHEN 'text_v1' THEN 'text_v1' END AS resolved FROM e""")
def x5_model_registry(spark, sf_dir):
    registry = spark.createDataFrame(MODELS, "key string, alias_for string")
    rows = t(spark, sf_dir, "embeddings").select("vec_id", pick(["legacy_image", "image_v1", "text_v1", "lost", "unknown"], F.col("vec_id")).alias("model"))
    return rows.join(tools.resolved_aliases(registry).withColumnRenamed("key", "model"), "model", "left").select("vec_id", "model", "resolved")


SCOPES = [(None, 2, True), (None, 0, False), ("kb; web", 1, False), ("KB,extractor", 0, True), ("  ", 3, True), ("provided|local_kb", None, False)]


@register("""SELECT doc_id, source, list_contains(CASE doc_id % 6 WHEN 0 THEN ['provided_evidence', 'domain_kb', 'web_search'] WHEN 1 THEN ['provided_evidence'] WHEN 2 THEN ['domain_kb', 'web_search'] WHEN 3 THEN ['web_extractor', 'web_search'] WHEN 4 THEN ['provided_evidence'] ELSE ['provided_evidence', 'domain_kb'] END,
    CASE WHEN source IN ('src0', 'src1') THEN 'provided_evidence' WHEN source IN ('src2', 'src3', 'src4') THEN 'domain_kb' ELSE 'web_search' END) AS readable FROM documents""")
def f17_source_scope(spark, sf_dir):
    plans = [sorted(evidence.source_scope(scope, depth, web_search=web)) for scope, depth, web in SCOPES]
    scope = F.array(*[F.array(*map(F.lit, p)) for p in plans])
    kind = F.when(F.col("source").isin("src0", "src1"), "provided_evidence").when(F.col("source").isin("src2", "src3", "src4"), "domain_kb").otherwise("web_search")
    return t(spark, sf_dir, "documents").select("doc_id", "source", F.array_contains(F.element_at(scope, (F.col("doc_id") % 6 + 1).cast("int")), kind).alias("readable"))


@register(f"WITH {PAIRS} SELECT qid, gid, row_number() OVER (ORDER BY rank, qid) AS place FROM r WHERE rank <= 3")
def w7_rank_major_selection(spark, sf_dir):
    rows = ranked(spark, sf_dir, 3).withColumn("_all", F.lit(0))
    return evidence.numbered(rows, ["_all"], ["rank", "qid"]).select("qid", "gid", "place")
