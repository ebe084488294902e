"""Queries of the remaining sources, rankings and comparisons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import vectors as V
from tessera.operators import graph as G
from tessera.operators import retrieval as R
from tessera.operators import text_index, values
from tessera.sources import documents, html, json_lines, stages, uploads

from . import graphs
from .registry import Registry
from .shared import t
from .vectors import HASHES, PAIRS, ranked

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register("SELECT doc_id, text, lang FROM documents")
def s2_json_lines(spark, sf_dir):
    rows = t(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = stages.new_path(spark, "jsonl")
    json_lines.write_jsonl(rows, path)
    return json_lines.read_jsonl(spark, path, "doc_id long, text string, lang string")


@register("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 5")
def s4_append_log(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    path = stages.new_path(spark, "log")
    for kind in ("view", "other"):
        part = e.where("event_type = 'view'" if kind == "view" else "event_type <> 'view'")
        json_lines.write_jsonl(part.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), path, append=True)
    log = json_lines.read_jsonl(spark, path, "user_id long, event_id long, at long")
    return R.first_by_key(log, ["user_id"], [F.desc("at"), F.desc("event_id")], 5).select("user_id", "event_id")


@register()
def s10_archive_search(spark, sf_dir):
    rows = html.page_texts(t(spark, sf_dir, "pages"), "page_id", "html")
    return R.keyword_search(rows, "text", ["the", "article"], 0.8).select("id", "title", "hits", "score")


@register()
def s10_ranked_search(spark, sf_dir):
    pages = t(spark, sf_dir, "pages")
    texts = stages.stage(html.page_texts(pages, "page_id", "html"), "page-texts")
    index = text_index.build(texts, "id", "text", stages.new_path(spark, "text-index"))
    found = text_index.search(index, ["the", "article", "und"], 50).withColumnRenamed("doc", "id")
    # Only the pages found are parsed for their headings and summaries.
    hits = pages.join(F.broadcast(found.select(F.col("id").alias("page_id"))), "page_id")
    rows = found.join(html.articles(hits, "page_id", "html"), "id").join(texts.select("id", "title"), "id")
    return rows.select("id", "rank", "relevance", "hits", "title", "headings", "summary", F.lit(0.8).alias("score"))


#: Documents as files of five kinds.
@register(r"""SELECT doc_id, CASE doc_id % 5 WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN 'doc ' || doc_id || chr(10) || '(' || lang || ')' || chr(10) || chr(10) || source WHEN 1 THEN text
    ELSE array_to_string(list_concat(list_filter(string_split(text, chr(10)), lambda x: x <> ''), [lang || ' | ' || source]), chr(10)) END AS text, CASE doc_id % 5 WHEN 2 THEN 'unsupported_file_type' WHEN 3 THEN 'docx_extract_unavailable' END AS warning FROM documents""")
def s5_document_texts(spark, sf_dir):
    rows = uploads.as_files(t(spark, sf_dir, "documents"))
    out = documents.texts(rows, "doc_id", "name", "content")
    return out.select("doc_id", "text", F.split_part("warning", F.lit(":"), F.lit(1)).alias("warning"))


@register(f"WITH {PAIRS} SELECT q_label, gid, round(max(score), 6) AS score FROM r WHERE rank <= 5 GROUP BY ALL")
def u4_recall_channels(spark, sf_dir):
    hits = ranked(spark, sf_dir, 5).withColumn("node", F.concat_ws("/", F.col("q_label").cast("string"), F.col("gid").cast("string"))).withColumn("method", F.col("qid").cast("string"))
    out = R.recall_channels(hits, "node", "score", "method")
    part = F.split("node", "/")
    return out.select(part[0].cast("int").alias("q_label"), part[1].cast("long").alias("gid"), F.round("score", 6).alias("score"))


@register(f"WITH {HASHES} SELECT a.vec_id, hamming(a.bits, b.bits) AS distance FROM h a JOIN h b ON b.vec_id = a.vec_id + 1")
def h24_hamming_distance(spark, sf_dir):
    h = t(spark, sf_dir, "embeddings").select("vec_id", V.average_hash(F.col("embedding")).alias("bits"))
    other = h.select((F.col("vec_id") - 1).alias("vec_id"), F.col("bits").alias("other"))
    return h.join(other, "vec_id").select("vec_id", V.hamming(F.col("bits"), F.col("other")).cast("long").alias("distance"))


@register("""WITH e AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), d AS (SELECT vec_id, list_distance(x, y) AS d, list_cosine_similarity(x, y) AS c FROM e)
    SELECT vec_id, round(d, 6) AS l2, round(c, 6) AS cosine, round(1 / (1 + d), 6) AS inverse, round(greatest(0, 3 - d), 6) AS text_score, round(greatest(0, 1 - d / 2), 6) AS image_score FROM d""")
def h23_distance_variants(spark, sf_dir):
    e = t(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    rows = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id").select("vec_id", V.l2(F.col("x"), F.col("y")).alias("d"), V.cosine(F.col("x"), F.col("y")).alias("c"))
    d = F.col("d")
    return rows.select("vec_id", *[F.round(c, 6).alias(n) for n, c in (("l2", d), ("cosine", F.col("c")), ("inverse", V.similarity(d, "inverse")), ("text_score", V.similarity(d, "text")), ("image_score", V.similarity(d, "image")))])


@register("""WITH a AS (SELECT a.p_partkey, lower(regexp_replace(a.p_name, '[^a-z0-9]', '', 'g')) AS x, lower(regexp_replace(b.p_name, '[^a-z0-9]', '', 'g')) AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1)
    SELECT p_partkey, x = y OR (least(length(x), length(y)) >= 16 AND (contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) >= 0.9 * greatest(length(x), length(y))) AS same FROM a""")
def h22_same_value(spark, sf_dir):
    p = t(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("x"))
    rows = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("x").alias("y")), "p_partkey")
    return rows.select("p_partkey", values.same_value(F.col("x"), F.col("y")).alias("same"))


@register("SELECT count(*) AS vectors, max(len(embedding)) AS dim, (count(*) * max(len(embedding)) * 4)::BIGINT AS storage_bytes FROM embeddings")
def a33_storage_metrics(spark, sf_dir):
    n, dim = F.count(F.lit(1)), F.max(F.size("embedding"))
    return t(spark, sf_dir, "embeddings").agg(n.alias("vectors"), dim.alias("dim"), (n * dim * 4).alias("storage_bytes"))


@register(f"WITH {graphs.EDGES}, {graphs.HOPS}, m AS (SELECT id, min(depth) AS depth FROM z GROUP BY id), i AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM m) AND b IN (SELECT id FROM m)) SELECT id, depth, p_name AS name, (SELECT count(*) FROM i WHERE a = id OR b = id) AS relations FROM m JOIN part ON p_partkey = id")
def g16_grounding_context(spark, sf_dir):
    e = graphs.edges(spark, sf_dir)
    near = G.hops(e, graphs.root(spark), 3, unique=True)
    n = G.degrees(G.induced(e, near), unique=True).withColumnRenamed("degree", "relations")
    rows = near.join(graphs.parts(spark, sf_dir), "id").join(n, "id", "left")
    return rows.select("id", "depth", "name", F.coalesce("relations", F.lit(0)).alias("relations"))

