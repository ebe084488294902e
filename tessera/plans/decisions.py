"""Queries of rule tables: extraction checks, resolution, dialogue, review decisions, profiles and audits."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import texts as X
from tessera.operators import graph as G, source_rules, variants
from tessera.operators import retrieval as R
from tessera.operators import rules

from .fixtures import pick, pick_sql, sql_list
from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register("""SELECT conv_id, turn, trim(text) = '' OR (lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) = lower(role)) AS low FROM conversations""".replace("\\\\", "\\"))
def f7_low_information(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", rules.low_information(F.col("text"), F.col("role")).alias("low"))


@register("""SELECT conv_id, turn, CASE WHEN length(trim(text)) = 0 THEN 'EMPTY' WHEN length(text) > 40 AND regexp_matches(text, '[,.;:!?]') THEN 'LONG_WITH_PUNCTUATION' WHEN length(text) >= 8 AND regexp_matches(lower(text), '\\b(is|was|has|are)\\b') THEN 'CLAUSE' END AS reason FROM conversations""".replace("\\\\", "\\"))
def f10_non_entity_mentions(spark, sf_dir):
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", rules.non_entity(F.col("text")).alias("reason"))


@register("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def f14_seed_scope(spark, sf_dir):
    seeds = t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return rules.scoped(t(spark, sf_dir, "part").select("p_partkey"), seeds, "p_partkey")


@register("""WITH c AS (SELECT vec_id, list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS d FROM embeddings) SELECT vec_id, round(d, 6) AS d FROM c WHERE d <= 1.4""")
def f6_distance_threshold(spark, sf_dir):
    from tessera.functions import vectors as V

    e = t(spark, sf_dir, "embeddings")
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    return e.crossJoin(F.broadcast(one)).select("vec_id", V.l2(F.col("embedding"), F.col("q")).alias("d")).where("d <= 1.4").withColumn("d", F.round("d", 6))


@register("""SELECT doc_id, CASE WHEN text = '' THEN NULL WHEN contains(text, 'The') AND contains(text, 'of') AND contains(text, 'and') THEN 0.9 WHEN contains(text, 'The') AND contains(text, 'and') THEN 0.8 WHEN contains(text, 'and') THEN 0.7 WHEN contains(text, 'The') AND contains(text, 'of') THEN 0.45 ELSE 0.15 END AS entailment FROM documents""")
def h11_lexical_entailment(spark, sf_dir):
    return t(spark, sf_dir, "documents").select("doc_id", S.entailment(F.col("text"), F.lit("The"), F.lit("of"), F.lit("and")).alias("entailment"))


@register(r"""SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '\d+', '#', 'g') AS predicate FROM pages""")
def h13_discovered_predicate(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^https?://", ""), r"\d+", "#").alias("predicate"))


TIME = r"""t AS (SELECT doc_id, regexp_extract(text, '\b(1[0-9]{3}|20[0-9]{2})\b', 1) AS y FROM documents)"""


@register(f"WITH {TIME} SELECT doc_id, CASE WHEN y = '' THEN NULL ELSE y::INT END AS start_year, CASE WHEN y = '' THEN 'none' ELSE 'year' END AS granularity FROM t")
def h14_temporal_value(spark, sf_dir):
    v = rules.year_of(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", v.alias("start_year"), F.when(v.isNull(), "none").otherwise("year").alias("granularity"))


@register(r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name || ' (' || p_brand || ') ', '\s*[\(\[（【][^\)\]）】]*[\)\]）】]\s*$', ''), '^[\s,.;:]+|[\s,.;:]+$', '', 'g') AS value FROM part""")
def h15_text_value(spark, sf_dir):
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") "))
    return t(spark, sf_dir, "part").select("p_partkey", rules.without_noise(raw).alias("value"))


HOSTS = ["www.taiyuan.gov.cn", "example.com", "news.xinhuanet.com", "a.people.com.cn", "gov.cn.example.org"]
TERMS = {"node": ["License", "the M.I.T!", "x"], "scenic": ["the", "le", "license"], "context": ["version", "und", "le"], "target": ["number", "the", "que", "-"]}
PLAIN = {"node": ["license", "themit"], "scenic": ["the", "le"], "context": ["version", "und"], "target": ["number", "que"]}


def _relevance_sql() -> str:
    hits = {n: "list_filter(" + sql_list(words) + ", lambda x: contains(hay, x))" for n, words in PLAIN.items()}
    weights = {"node": 3.0, "scenic": 1.6, "context": 1.0, "target": 0.35}
    score = " + ".join(f"{w} * len({hits[n]})" for n, w in weights.items())
    return f"""WITH h AS (SELECT doc_id, lang, {pick_sql(HOSTS, 'doc_id')} AS host, regexp_replace(lower(lang || ' ' || text || ' https://' || {pick_sql(HOSTS, 'doc_id')} || '/p'), '[^0-9a-z\\x{{4e00}}-\\x{{9fff}}_-]+', '', 'g') AS hay FROM documents),
        k AS (SELECT doc_id, host, round((({score}) + 0.8 * regexp_matches(host, '(gov.cn|xinhuanet.com|people.com.cn)$')::INT + 0.4 * (doc_id % 10 <= 2)::INT)::DECIMAL(20,10), 2)::DOUBLE AS score, len(list_concat({", ".join(hits.values())})) AS n FROM h)
        SELECT doc_id, host, score, n, CASE WHEN score >= 1.2 THEN 'keep' ELSE 'reject' END AS decision FROM k"""


@register(_relevance_sql())
def h6_source_relevance(spark, sf_dir):
    url = F.concat(F.lit("https://"), pick(HOSTS, F.col("doc_id")), F.lit("/p"))
    terms = {k: F.array(*map(F.lit, v)) for k, v in TERMS.items()}
    rows = source_rules.with_relevance(t(spark, sf_dir, "documents"), [F.col("lang"), F.col("text")], url, terms, F.col("doc_id") % 10).select("doc_id", F.col("relevance").alias("x"))
    return rows.select("doc_id", F.col("x.domain").alias("host"), "x.score", F.size("x.matched").cast("long").alias("n"), rules.keep_decision(F.col("x.score")).alias("decision"))


@register("""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k, n_chars / 10000.0 AS s FROM documents) SELECT doc_id, CASE WHEN s >= 1.2 THEN 'keep' WHEN k <= 2 AND s >= 0.4 THEN 'fallback' ELSE 'reject' END AS decision FROM r""")
def h7_keep_or_drop(spark, sf_dir):
    k = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = t(spark, sf_dir, "documents").select("doc_id", "source", k.alias("k"), (F.col("n_chars") / 10000).alias("s"))
    return rows.select("doc_id", F.when(F.col("s") >= 1.2, "keep").when((F.col("k") <= 2) & (F.col("s") >= 0.4), "fallback").otherwise("reject").alias("decision"))


TITLES, SOURCE_TYPES = ["", "太原市人民政府", "晋祠博物馆", "大学学报", "新华社", "Wiki guide", None], ["web_search", "domain_kb_vector", "provided", "graph_lookup", "web_extractor", "domain_kb_keyword", "", "Local"]
TITLE_CLASS = [None, "government", "official", "academic", "news", None, None]


@register(f"""WITH r AS (SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host, coalesce(url, '') <> '' AS has_url, {pick_sql(TITLE_CLASS, 'page_id')} AS titled, {pick_sql(SOURCE_TYPES, 'page_id // 3')} AS st, page_id % 3 = 0 AS verified, page_id % 11 = 0 AS told FROM pages),
    p AS (SELECT *, CASE WHEN starts_with(st, 'domain_kb') THEN 'local_kb' WHEN st = 'provided' THEN 'provided' WHEN starts_with(st, 'web') OR has_url THEN 'web' WHEN starts_with(st, 'graph') THEN 'graph' ELSE 'unknown' END AS provenance,
        CASE st WHEN 'domain_kb_vector' THEN 'vector' WHEN 'domain_kb_keyword' THEN 'keyword' WHEN 'web_search' THEN 'web_search' WHEN 'graph_lookup' THEN 'graph_lookup' WHEN '' THEN 'unknown' ELSE lower(st) END AS method FROM r),
    a AS (SELECT *, CASE WHEN told THEN 'academic' WHEN regexp_matches(host, '[.]gov[.]|gov[.]cn') THEN 'government' WHEN titled = 'government' THEN titled WHEN titled = 'official' OR regexp_matches(host, 'museum|official') THEN 'official' WHEN titled = 'academic' OR regexp_matches(host, 'cnki|[.]edu') THEN 'academic'
        WHEN titled = 'news' OR regexp_matches(host, 'xinhuanet|people[.]com[.]cn|chinanews') THEN 'news' WHEN contains(host, 'wiki') OR contains(host, 'baike.baidu') THEN 'encyclopedia' WHEN regexp_matches(host, 'trip|mafengwo|dianping') THEN 'travel_platform' WHEN provenance IN ('local_kb', 'provided') THEN CASE WHEN verified THEN 'official' ELSE 'museum_or_institution' END ELSE 'unknown' END AS authority FROM p),
    s AS (SELECT *, CASE authority WHEN 'official' THEN 0.95 WHEN 'government' THEN 0.92 WHEN 'museum_or_institution' THEN 0.88 WHEN 'academic' THEN 0.85 WHEN 'encyclopedia' THEN 0.72 WHEN 'news' THEN 0.62 WHEN 'travel_platform' THEN 0.55 ELSE 0.45 END AS base FROM a)
    SELECT page_id, provenance, method, authority, round(least(1, greatest(0, base + CASE method WHEN 'provided' THEN 0.08 WHEN 'vector' THEN 0.04 WHEN 'web_extractor' THEN 0.04 WHEN 'graph_lookup' THEN -0.05 ELSE 0 END + CASE provenance WHEN 'provided' THEN 0.06 WHEN 'local_kb' THEN 0.05 WHEN 'graph' THEN -0.08 ELSE 0 END)), 3)::DOUBLE AS weight FROM s""")
def h8_source_weight(spark, sf_dir):
    k = F.col("page_id")
    told = F.when(k % 11 == 0, " Academic")
    x = source_rules.weight(told, pick(SOURCE_TYPES, F.floor(k / 3)), F.col("url"), pick(TITLES, k), F.lit(None).cast("string"), k % 3 == 0).alias("x")
    return t(spark, sf_dir, "pages").select("page_id", x).select("page_id", "x.provenance", "x.method", "x.authority", "x.weight")


@register(r"""SELECT p_partkey, lower(regexp_replace(p_name, '[\s\p{P}]', '', 'g')) AS norm, list_distinct(list_concat([p_name], string_split(p_brand, '#'))) AS aliases FROM part""".replace("list_distinct(list_concat([p_name], string_split(p_brand, '#')))", "list_sort(list_distinct(list_concat([p_name], string_split(p_brand, '#'))))"))
def h26_name_aliases(spark, sf_dir):
    aliases = F.array_sort(F.array_union(F.array("p_name"), F.split("p_brand", "#")))
    return t(spark, sf_dir, "part").select("p_partkey", F.lower(F.regexp_replace("p_name", r"[\s\p{P}]", "")).alias("norm"), aliases.alias("aliases"))


@register("""WITH d AS (SELECT o_orderkey % 1500 AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'keep' WHEN 'O' THEN 'exclude' ELSE 'uncertain' END AS action, o_orderkey FROM orders), l AS (SELECT doc_id, arg_max(action, o_orderkey) AS action FROM d GROUP BY doc_id) SELECT documents.doc_id, coalesce(action, 'none') AS action, coalesce(action, 'none') <> 'exclude' AS usable FROM documents LEFT JOIN l USING (doc_id)""")
def h29_review_decisions(spark, sf_dir):
    action = F.when(F.col("o_orderstatus") == "F", "keep").when(F.col("o_orderstatus") == "O", "exclude").otherwise("uncertain")
    last = t(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 1500).alias("doc_id")).agg(F.max_by(action, "o_orderkey").alias("action"))
    rows = t(spark, sf_dir, "documents").select("doc_id").join(last, "doc_id", "left").withColumn("action", F.coalesce("action", F.lit("none")))
    return rows.withColumn("usable", F.col("action") != "exclude")


@register("""WITH q AS (SELECT p_partkey, unnest([{'kind': 'property', 'priority': 82}, {'kind': 'relation', 'priority': 75}, {'kind': 'temporal', 'priority': 60}]) AS z FROM part) SELECT p_partkey, z.kind AS kind, z.priority AS priority, sha1(p_partkey || '|' || z.kind)[1:12] AS question_id FROM q""")
def k1_question_planning(spark, sf_dir):
    return rules.planned(t(spark, sf_dir, "part"), "p_partkey", {"property": 82, "relation": 75, "temporal": 60})


@register("""SELECT p_partkey, array_to_string(list_filter([p_name, p_type, CASE WHEN p_brand <> 'Brand#1' THEN p_brand ELSE '' END], lambda x: x <> ''), ' ') AS query FROM part""")
def k15_query_text(spark, sf_dir):
    parts = F.array("p_name", "p_type", F.when(F.col("p_brand") != "Brand#1", F.col("p_brand")).otherwise(""))
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_distinct(F.filter(parts, lambda x: x != "")), " ").alias("query"))


@register("""WITH s AS (SELECT 1 AS level, doc_id FROM documents WHERE source = 'src99' UNION ALL SELECT 2, doc_id FROM documents WHERE source = 'src3' UNION ALL SELECT 3, doc_id FROM documents) SELECT doc_id, level FROM s WHERE level = (SELECT min(level) FROM s)""")
def x6_scope_ladder(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    return rules.first_scope([d.where("source = 'src99'").select("doc_id"), d.where("source = 'src3'").select("doc_id"), d.select("doc_id")])


#: Raw values of properties: objects, lists, broken ones and plain text; ``K`` is a number of the event.
RAWS = ['{"value": "v K", "source_url": "http://s/K", "confidence": 0.5}', '{"value": "", "status": "ok"}', "plain K", '{broken K', '[1, 2]', ' {"source_text": null, "value": K} ', '{"value": null, "confidence": ""}', None]


def raw_values(key):
    return F.replace(pick(RAWS, key), F.lit("K"), key.cast("string"))


RAW_SQL = f"r AS (SELECT event_id, event_type, replace({pick_sql(RAWS, 'event_id')}, 'K', event_id::VARCHAR) AS raw FROM events), j AS (SELECT *, CASE WHEN event_id % 8 IN (0, 1, 5, 6) THEN raw END AS o FROM r)"


@register(f"""WITH {RAW_SQL} SELECT event_id, CASE WHEN event_type = 'view' THEN coalesce(json_extract_string(o, '$.value'), '') ELSE event_type END AS value, json_extract_string(o, '$.source_text') AS source_text, json_extract_string(o, '$.source_url') AS source_url,
    CASE WHEN event_id % 5 = 0 THEN 'kept' ELSE nullif(json_extract_string(o, '$.confidence'), '') END AS confidence, json_extract_string(o, '$.status') AS status FROM j""")
def s20_wrapped_values(spark, sf_dir):
    i, none = F.col("event_id"), F.lit(None).cast("string")
    now = {"value": F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")), "source_text": none, "source_url": none, "confidence": F.when(i % 5 == 0, "kept"), "status": none}
    return t(spark, sf_dir, "events").select("event_id", *[c.alias(n) for n, c in variants.wrapped(raw_values(i), now).items()])


@register("""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem) SELECT src, dst FROM e WHERE src IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') AND dst IN (SELECT p_partkey FROM part WHERE p_size > 10)""")
def s21_graph_projection(spark, sf_dir):
    e = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    e = e.join(t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("src")), "src", "left_semi")
    return e.join(t(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst")


@register("""WITH k AS (SELECT upper(trim(p_brand)) AS id, p_type FROM part), m AS (SELECT id, list_sort(list_distinct(list(p_type))) AS words FROM k GROUP BY id) SELECT p_partkey, coalesce(words, []) AS words FROM part LEFT JOIN m ON m.id = upper(trim(p_brand))""")
def s27_keyword_migration(spark, sf_dir):
    p = t(spark, sf_dir, "part").withColumn("id", F.upper(F.trim("p_brand")))
    words = p.groupBy("id").agg(F.sort_array(F.collect_set("p_type")).alias("words"))
    return p.select("p_partkey", "id").join(words, "id", "left").select("p_partkey", F.coalesce("words", F.array().cast("array<string>")).alias("words"))


@register(r"""SELECT p_partkey, CASE WHEN regexp_extract(p_brand, '(\d+)', 1) = '' THEN NULL ELSE regexp_extract(p_brand, '(\d+)', 1)::INT END AS people FROM part""")
def s33_first_integer(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", r"(\d+)", 1).try_cast("int").alias("people"))


OCR = "o AS (SELECT l_orderkey AS asset, l_linenumber AS line, l_shipmode AS text, l_tax * 10 AS score FROM lineitem)".replace("l_shipmode", "l_returnflag")


@register(f"WITH {OCR} SELECT asset, string_agg(text, '' ORDER BY line) FILTER (score >= 0.55) AS clean, string_agg(text, '' ORDER BY line) AS raw, round(max(score), 6) AS best, round(avg(score) FILTER (score >= 0.55), 6) AS mean_kept, count(*) FILTER (score >= 0.55) AS kept FROM (SELECT DISTINCT ON (asset, line) * FROM o ORDER BY asset, line, text, score) GROUP BY asset")
def s16_ocr_lines(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("text"), (F.col("l_tax") * 10).alias("score"))
    return rules.ocr_pages(R.first_by_key(li, ["asset", "line"], [F.col("text"), F.col("score")]), 0.55)


