"""Queries on documents, pages, conversations and benchmark passages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import texts as X
from tessera.operators import retrieval as R
from tessera.operators import upserts as U
from tessera.operators import variants
from tessera.sources import html

from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

WORDS = ["the", "ereand", "tion", "license"]
CLEAN = r"array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))"
CHUNKS = rf"""d AS (SELECT doc_id, {CLEAN} AS c FROM documents), k AS (SELECT doc_id, c, unnest(range(0, 1 + ceil(greatest(length(c) - 1200, 0) / 1020.0)::BIGINT)) AS i FROM d),
    p AS (SELECT doc_id, i, regexp_replace(c[i * 1020 + 1 : i * 1020 + 1200], '^\s+|\s+$', '', 'g') AS chunk FROM k), n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index, chunk FROM p WHERE chunk <> '')"""


def chunked(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("chunk_index", "chunk"))


@register(f"WITH {CHUNKS} SELECT doc_id, chunk_index, length(chunk) AS n, md5(chunk) AS digest FROM n")
def h3_chunk_text(spark, sf_dir):
    return chunked(spark, sf_dir).select("doc_id", "chunk_index", F.length("chunk").alias("n"), F.md5("chunk").alias("digest"))


@register(f"SELECT doc_id, md5({CLEAN}) AS digest FROM documents")
def h4_normalize_lines(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.md5(X.normalized_lines(F.col("text"))).alias("digest"))


TERMS = r"""w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[\s,.;:!?，。；：！？、]+'), lambda x: regexp_replace(x, '[^\p{L}\p{N}_-]', '', 'g')), lambda x: length(x) >= 2) AS t FROM documents),
    u AS (SELECT doc_id, list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 16) AS terms FROM w)"""


@register(f"WITH {TERMS} SELECT doc_id, array_to_string(terms, ' ') AS terms FROM u")
def h5_query_terms(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(X.terms(F.col("text")), " ").alias("terms"))


HITS = " + ".join(f"contains(lower(text), '{w}')::INT" for w in WORDS)


@register(f"SELECT doc_id, {HITS} AS hits, {HITS} + 1.5 AS score FROM documents WHERE {HITS} > 0")
def f2_keyword_hits(spark, sf_dir):
    rows = R.keyword_search(t(spark, sf_dir, "documents"), "text", WORDS)
    return rows.select("doc_id", "hits", F.col("score").cast("double").alias("score"))


@register("SELECT doc_id FROM documents WHERE length(trim(coalesce(text, ''))) >= 40 AND trim(text) NOT IN ('暂无内容', '暂无', '无', 'null')")
def f5_content_filter(spark, sf_dir):
    return t(spark, sf_dir, "documents").where(R.has_content(F.col("text"), 40)).select("doc_id")


@register("""WITH a AS (SELECT doc_id, md5(text) AS k, 3.0 AS score, 0 AS ch FROM documents WHERE n_chars > 3000 UNION ALL SELECT doc_id, md5(text), 2.0, 1 FROM documents WHERE n_chars > 1000),
    b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ch, doc_id) AS n FROM a) SELECT doc_id, score FROM b WHERE n = 1""")
def u3_vector_keyword_merge(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    part = lambda least, score, ch: d.where(F.col("n_chars") > least).select("doc_id", F.md5("text").alias("k"), F.lit(score).alias("score"), F.lit(ch).alias("ch"))
    rows = part(3000, 3.0, 0).unionByName(part(1000, 2.0, 1))
    return R.first_by_key(rows, ["k"], [F.col("ch"), F.col("doc_id")]).select("doc_id", "score")


FAMILY = "CASE WHEN source IN ('src0', 'src1') THEN 'provided' WHEN source IN ('src2', 'src3', 'src4') THEN 'domain_kb' ELSE 'web' END"


def families():
    return F.when(F.col("source").isin("src0", "src1"), "provided").when(F.col("source").isin("src2", "src3", "src4"), "domain_kb").otherwise("web")


@register(f"""WITH a AS (SELECT lang, doc_id, source, {FAMILY} AS family, n_chars FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY lang, family, source ORDER BY n_chars DESC, doc_id) AS n FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY lang, family ORDER BY n_chars DESC, doc_id) AS turn FROM b WHERE n = 1)
    SELECT lang, doc_id, family, row_number() OVER (PARTITION BY lang ORDER BY turn, CASE family WHEN 'provided' THEN 1 WHEN 'domain_kb' THEN 2 ELSE 3 END, doc_id) AS place FROM c""")
def w5_diversity_interleave(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").withColumn("family", families())
    out = R.interleaved(rows, ["lang"], "source", "family", "n_chars", "doc_id", ["provided", "domain_kb", "web"])
    return out.select("lang", "doc_id", "family", "place")


@register("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY source, md5(text) ORDER BY n_chars DESC, doc_id) AS n FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS m FROM a WHERE n = 1) SELECT source, doc_id, m AS place FROM b WHERE m <= 8""")
def w6_limit_after_dedupe(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = R.first_by_key(t(spark, sf_dir, "documents"), ["source", F.md5("text")], [F.desc("n_chars"), F.col("doc_id")])
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return rows.withColumn("place", place).where("place <= 8").select("source", "doc_id", "place")


URL = r"""u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path, list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND lower(regexp_extract(x, '^([^=]*)', 1)) NOT IN ('fbclid', 'gclid', 'spm', 'from')) AS q FROM pages)"""


@register(f"WITH {URL} SELECT page_id, scheme || '://' || host || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS canonical FROM u")
def h1_canonical_url(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


@register("""SELECT doc_id, CASE WHEN source = 'src0' THEN 'image:' || doc_id WHEN source = 'src1' THEN 'document:' || (doc_id // 10) WHEN source = 'src2' THEN 'web:http://' || lang ELSE 'document:' || (doc_id // 10) END AS family FROM documents""")
def h2_source_family(spark, sf_dir):
    kind = F.when(F.col("source") == "src0", "image").when(F.col("source") == "src1", "document").otherwise("other")
    url = F.when(F.col("source") == "src2", F.concat(F.lit("http://"), "lang"))
    doc = F.floor(F.col("doc_id") / 10).cast("string")
    return t(spark, sf_dir, "documents").select("doc_id", K.source_family(kind, doc, url, F.col("doc_id").cast("string")).alias("family"))


@register(r"SELECT p_partkey, lower(regexp_replace(p_name, '[^\p{L}\p{N}]', '', 'g')) AS name_key FROM part")
def h16_name_key(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", X.name_key(F.col("p_name")).alias("name_key"))


@register(r"SELECT page_id, regexp_replace(url, '[^\p{L}\p{N}._-]+', '_', 'g')[1:180] AS file_name FROM pages")
def h32_safe_filename(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", X.safe_filename(F.col("url")).alias("file_name"))


@register(r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, least(len(w) - 1, 20) + 1), lambda i: w[i] || w[i + 1]), ' ') AS bigrams FROM w""")
def h40_bigrams(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.array_join(X.bigrams(F.col("text")), " ").alias("bigrams"))


@register(r"""WITH p AS (SELECT doc_id, source, lang, list_filter(list_transform(regexp_split_to_array(text, '[,，、;/；|]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS x FROM documents),
    z AS (SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN list_concat(list_concat([lang], x), [source]) WHEN 3 THEN list_concat([lang, source], x) ELSE x END AS x FROM p) SELECT doc_id, len(x) AS n, md5(array_to_string(x, '|')) AS parts FROM z""")
def h18_multi_values(spark, sf_dir):
    d, i, s = t(spark, sf_dir, "documents"), F.col("doc_id") % 4, F.struct
    # Lists of objects and of lists, and an object with such a list.
    mixed = F.concat(F.lit("["), F.to_json(s(F.lit("").alias("value"), F.col("lang").alias("values"))), F.lit(", null, "), F.to_json(F.array("text")), F.lit(", "), F.to_json(s(F.col("source").alias("display_value"))), F.lit("]"))
    held = F.concat(F.lit('{"values": [['), F.to_json(F.array("lang", "source")), F.lit("], "), F.to_json(F.array("text")), F.lit("]}"))
    raw = F.when(i == 0, F.col("text")).when(i == 1, F.to_json(s(F.col("text").alias("value")))).when(i == 2, mixed).otherwise(held)
    rows = d.select("doc_id", variants.values(raw).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x", "|")).alias("parts"))


@register("SELECT page_id, CASE WHEN regexp_matches(u, '^https?://') THEN u WHEN starts_with(u, '/') THEN 'http://base.example' || u ELSE u END AS resolved FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^[a-z]+://[^/]*', '') END AS u FROM pages)")
def h28_resolved_url(spark, sf_dir):
    u = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^[a-z]+://[^/]*", ""))
    return t(spark, sf_dir, "pages").select("page_id", X.resolved_url("http://base.example/", u).alias("resolved"))


@register("""SELECT page_id, conv_id, turn, (sum(n + 1) OVER (PARTITION BY conv_id ORDER BY turn) - n - 1)::BIGINT AS char_start FROM (SELECT conv_id // 4 AS page_id, conv_id, turn, length(text) AS n FROM conversations)""")
def w9_cumulative_offsets(spark, sf_dir):
    from pyspark.sql import Window as W

    n = F.length("text").cast("long")
    before = F.sum(n + 1).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)) - n - 1
    return t(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 4).alias("page_id"), "conv_id", "turn", before.alias("char_start"))


@register("""WITH a AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system'), b AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS page, count(*) AS blocks FROM a GROUP BY conv_id) SELECT conv_id, blocks, length(page) AS n_chars, md5(page) AS digest FROM b""")
def s8_page_assembler(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").where("role <> 'system'")
    page = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    rows = rows.groupBy("conv_id").agg(page.alias("page"), F.count(F.lit(1)).alias("blocks"))
    return rows.select("conv_id", "blocks", F.length("page").alias("n_chars"), F.md5("page").alias("digest"))


@register("""WITH a AS (SELECT conv_id, turn, length(text) AS n FROM conversations), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM a) SELECT conv_id, turn FROM b WHERE before < 600""")
def w10_length_budget(spark, sf_dir):
    from pyspark.sql import Window as W

    before = F.sum(F.length("text")).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1))
    return t(spark, sf_dir, "conversations").withColumn("before", F.coalesce(before, F.lit(0))).where("before < 600").select("conv_id", "turn")


@register("SELECT conv_id, max(turn) AS last_turn, arg_max(role, turn) AS last_role, arg_max(md5(text), turn) AS last_text FROM conversations GROUP BY conv_id")
def w16_latest_row(spark, sf_dir):
    rows = t(spark, sf_dir, "conversations").groupBy("conv_id")
    return rows.agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("last_role"), F.md5(F.max_by("text", "turn")).alias("last_text"))


@register("""WITH a AS (SELECT d.doc_id, d.source, md5(regexp_replace(text, '\\s', '', 'g')) AS k FROM documents d), b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM a) SELECT source, count(*) AS docs, count(*) FILTER (n = 1) AS kept FROM b GROUP BY source""".replace("\\\\", "\\"))
def u8_text_pool(spark, sf_dir):
    from pyspark.sql import Window as W

    key = F.md5(F.regexp_replace("text", r"\s", ""))
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", key.alias("k"))
    rows = rows.withColumn("n", F.row_number().over(W.partitionBy("k").orderBy("doc_id")))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") == 1).alias("kept"))


@register("SELECT doc_id FROM documents UNION SELECT doc_id FROM labels")
def u1_union_ids(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").union(t(spark, sf_dir, "labels").select("doc_id")).distinct()


@register("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u5_missing_ids(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").distinct().join(t(spark, sf_dir, "labels"), "doc_id", "left_anti")


@register("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE quality = 1")
def u6_intersect_ids(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id").intersect(t(spark, sf_dir, "labels").where("quality = 1").select("doc_id"))


@register("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars > 100 ORDER BY n_chars DESC, doc_id LIMIT 200")
def s17_backfill_scan(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").where("n_chars > 100").join(t(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return rows.orderBy(F.desc("n_chars"), "doc_id").limit(200).select("doc_id", "n_chars")


@register("SELECT doc_id, coalesce(quality, 1) = 1 AS usable, coalesce(toxic, -1) AS toxic FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(quality, 1) = 1")
def f18_usable_rows(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    usable = F.coalesce("quality", F.lit(1)) == 1
    return rows.where(usable).select("doc_id", usable.alias("usable"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@register("SELECT doc_id, source, lang FROM documents WHERE source = 'src0' AND lang IN ('en', 'de')")
def s1_scoped_scan(spark, sf_dir):
    return t(spark, sf_dir, "documents").where((F.col("source") == "src0") & F.col("lang").isin("en", "de")).select("doc_id", "source", "lang")


@register("SELECT source, doc_id FROM (SELECT doc_id, source, n_chars FROM documents WHERE lang = 'en' AND n_chars >= 200) ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 50")
def f1_filtered_list(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").where((F.col("lang") == "en") & (F.col("n_chars") >= 200))
    return rows.orderBy(F.desc("n_chars"), "doc_id").offset(50).limit(100).select("source", "doc_id")


@register("""SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_extract_string(props, '$.k')::INT + 100 AS merged_k, event_type AS merged_type, event_id::VARCHAR AS set_k_x, event_type AS set_type, 2 AS keys, true AS stays
    FROM events WHERE json_extract_string(props, '$.k')::INT IN (1, 5, 9)""")
def f3_json_predicate(spark, sf_dir):
    k, get = F.get_json_object("props", "$.k").cast("int"), F.get_json_object
    rows = t(spark, sf_dir, "events").where(k.isin(1, 5, 9)).select("event_id", "event_type", k.alias("k"), "props")
    rows = rows.withColumn("m", variants.merged(F.col("props"), F.to_json(F.struct((F.col("k") + 100).alias("k"), F.col("event_type").alias("type")))))
    rows = rows.withColumn("s", variants.with_value(variants.with_value(F.col("m"), ["k"], F.lit('{"x": null}')), ["k", "x"], F.col("event_id").cast("string")))
    stays = variants.with_value(F.col("m"), ["q", "x"], F.lit("1")) == variants.with_value(F.col("m"), ["q"], F.lit("1"), create=False)
    return rows.select("event_id", "k", get("m", "$.k").cast("int").alias("merged_k"), get("m", "$.type").alias("merged_type"), get("s", "$.k.x").alias("set_k_x"), get("s", "$.type").alias("set_type"), F.size(F.json_object_keys("s")).alias("keys"), stays.alias("stays"))


@register("SELECT doc_id, CASE WHEN n_chars > 2000 THEN 'TOO_LARGE' WHEN lang NOT IN ('en', 'de') THEN 'UNSUPPORTED' END AS error FROM documents")
def s30_upload_validation(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 2000, "TOO_LARGE").when(~F.col("lang").isin("en", "de"), "UNSUPPORTED").alias("error"))


@register("SELECT doc_id, sha256(text) AS digest, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def s29_checksums(spark, sf_dir):
    digests = t(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return digests.join(digests.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")), "digest").select("doc_id", "digest", "copies")


@register()
def s5_page_text(spark, sf_dir):
    return html.page_texts(t(spark, sf_dir, "pages"), "page_id", "html")


@register()
def s12_web_page_extraction(spark, sf_dir):
    return html.page_texts(t(spark, sf_dir, "pages"), "page_id", "html", boilerplate=True, least_line=8)


@register("SELECT page_id AS id, length(coalesce(html, '')) AS n, 'utf-8' AS encoding FROM pages")
def s6_decode_bytes(spark, sf_dir):
    files = t(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("content"))
    return html.decode_files(files, "page_id", "content").select("id", F.length("text").alias("n"), "encoding")


@register("""WITH old AS (SELECT doc_id % 500 AS k, doc_id, source FROM documents WHERE doc_id % 2 = 0), new AS (SELECT doc_id % 500 AS k, doc_id, source FROM documents WHERE doc_id % 2 = 1), a AS (SELECT *, 0 AS new FROM old UNION ALL SELECT *, 1 FROM new),
    b AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY new DESC, doc_id DESC) AS n FROM a) SELECT k, doc_id, source FROM b WHERE n = 1""")
def s18_upsert_snapshot(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select((F.col("doc_id") % 500).alias("k"), "doc_id", "source")
    return U.latest(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), ["k"], [F.desc("doc_id")])


@register("""WITH p AS (SELECT l_partkey AS node, l_linestatus AS name, l_returnflag AS value, CASE l_linenumber % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'disputed' WHEN 2 THEN 'proposed' ELSE 'rejected' END AS status, l_orderkey * 8 + l_linenumber AS o FROM lineitem),
    b AS (SELECT node, name, arg_max(value, (CASE status WHEN 'accepted' THEN 3 WHEN 'disputed' THEN 2 WHEN 'proposed' THEN 1 ELSE 0 END, o)) AS v FROM p GROUP BY ALL) SELECT node, string_agg(name || '=' || v, ',' ORDER BY name) AS properties FROM b GROUP BY node""")
def s19_property_aggregation(spark, sf_dir):
    n = F.col("l_linenumber") % 4
    rows = t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("node"), F.col("l_linestatus").alias("name"), F.col("l_returnflag").alias("value"),
        F.when(n == 0, "accepted").when(n == 1, "disputed").when(n == 2, "proposed").otherwise("rejected").alias("status"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("o"),
    )
    out = U.best_properties(rows, "node", "name", "value", "status", "o")
    return out.select("node", F.array_join(F.transform("properties", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("properties"))


@register("""WITH g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT 'documents' AS table_name, count(*) FILTER (doc_id IN (SELECT doc_id FROM g)) AS deleted, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM g)) AS kept FROM documents
    UNION ALL SELECT 'labels', count(*) FILTER (doc_id IN (SELECT doc_id FROM g)), count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM g)) FROM labels""")
def s22_cascading_delete(spark, sf_dir):
    d, labels = t(spark, sf_dir, "documents"), t(spark, sf_dir, "labels")
    return U.cascade_counts({"documents": d.select("doc_id"), "labels": labels.select("doc_id")}, "doc_id", labels.where("toxic = 1").select("doc_id"))


@register(f"WITH {CHUNKS}, e AS (SELECT vec_id, label FROM embeddings) SELECT label, count(*) AS chunks, sum(length(chunk))::BIGINT AS chars FROM n JOIN e ON vec_id = doc_id GROUP BY label")
def j1_chunk_embedding_join(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    return chunked(spark, sf_dir).join(e, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("chunk")).alias("chars"))


@register(f"WITH {TERMS}, x AS (SELECT doc_id, unnest(terms) AS term FROM u) SELECT term, count(*) AS docs, min(doc_id) AS first_doc FROM x GROUP BY term")
def j9_keyword_references(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", F.explode(X.terms(F.col("text"))).alias("term"))
    return rows.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"))


@register(r"""SELECT doc_id, regexp_matches(text, '(?:^|[^0-9A-Za-z])42(?:[^0-9A-Za-z]|$)') AS has_number, contains(text, 'The') AS has_name FROM documents""")
def f11_name_match(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", X.name_occurs(F.lit("42"), F.col("text")).alias("has_number"), X.name_occurs(F.lit("The"), F.col("text")).alias("has_name"))
