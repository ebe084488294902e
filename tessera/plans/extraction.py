"""Queries that read claims and names out of whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evidence, mentions

from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: What a document says of itself; patterns that Python and RE2 read alike.
CLAIM_RULES = [
    mentions.Rule("property", "license", r"under the ([A-Z][A-Za-z]*) License", 0.9),
    mentions.Rule("property", "version", r"[Vv]ersion ([0-9]+(?:\.[0-9]+)*)", 0.7),
    mentions.Rule("property", "phone", r"(\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4})", 0.8),
    mentions.Rule("relation", "writes_to", r"([a-z0-9._]+@[a-z0-9]+(?:\.[a-z0-9]+)+)", 0.6),
    mentions.Rule("background", "number", r"#([0-9]{2,})", 1.2),
]


def _claims_sql(rule: mentions.Rule) -> str:
    p = rule.pattern.replace("'", "''")
    sure = min(1.0, rule.confidence)
    return f"""SELECT doc_id, '{mentions.KINDS[rule.claim_type]}' AS claim_type, '{rule.predicate}' AS predicate, unnest(regexp_extract_all(text, '{p}', 1)) AS value, unnest(regexp_extract_all(text, '{p}', 0)) AS quote,
        CAST({sure} AS DOUBLE) AS confidence, CAST(round({sure} * 0.35, 3) AS DOUBLE) AS recommend_score FROM documents"""


@register(" UNION ALL ".join(map(_claims_sql, CLAIM_RULES)))
def x1_rule_extractor(spark, sf_dir):
    rows = mentions.extracted(t(spark, sf_dir, "documents"), "doc_id", "text", CLAIM_RULES)
    return rows.select("doc_id", "claim_type", "predicate", "value", "quote", "confidence", "recommend_score")


#: Documents as chunks: every seventh is an image with a node of its own, bound by its id; nodes are named by words and numbers.
ALIGNED = """n AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_partkey::VARCHAR WHEN 1 THEN split_part(p_name, ' ', 2) || ' ' || p_partkey ELSE w END AS name
        FROM part LEFT JOIN (SELECT doc_id AS k, regexp_extract(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents) ON k = p_partkey),
    k AS (SELECT id, trim(name) AS name FROM n WHERE name IS NOT NULL), u AS (SELECT name, min(id) AS id FROM k WHERE length(name) >= 2 GROUP BY name HAVING count(*) = 1),
    h AS (SELECT doc_id, id, name FROM documents JOIN u ON contains(text, name) WHERE doc_id % 7 > 0 AND (NOT regexp_matches(name, '^[0-9]+$') OR regexp_matches(text, '(^|[^0-9A-Za-z])' || name || '([^0-9A-Za-z]|$)'))),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(name) DESC, name) AS place FROM h)"""


@register(f"""WITH {ALIGNED} SELECT doc_id, id AS node, name AS node_name, 'EXACT_NAME' AS method, 1.0::DOUBLE AS score FROM o WHERE place <= 30
    UNION ALL SELECT doc_id, k, coalesce(nullif(name, ''), k::VARCHAR), 'ASSET_NODE_BINDING', 0.95::DOUBLE FROM (SELECT doc_id, (doc_id % 300)::BIGINT AS k FROM documents WHERE doc_id % 7 = 0 AND trim(coalesce(text, '')) <> '') LEFT JOIN k ON id = k""")
def j11_chunk_alignment(spark, sf_dir):
    d, p = t(spark, sf_dir, "documents"), F.col("p_partkey")
    first = d.select(F.col("doc_id").alias("p_partkey"), F.regexp_extract("text", r"[^\x20\x09-\x0D]+", 0).alias("w"))
    part = t(spark, sf_dir, "part").join(first, "p_partkey", "left")
    name = F.when(p % 4 == 0, p.cast("string")).when(p % 4 == 1, F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(" "), p.cast("string"))).otherwise(F.col("w"))
    nodes = part.select(p.alias("id"), name.alias("name")).where("name IS NOT NULL")
    image = F.col("doc_id") % 7 == 0
    chunks = d.select(F.col("doc_id").alias("chunk"), F.col("text").alias("content"), F.when(image, "image").otherwise("text").alias("asset_type"), F.when(image, F.col("doc_id") % 300).alias("node"), F.lit(None).cast("string").alias("node_name"))
    rows = mentions.aligned(chunks, nodes, evidence.MOST_NAMES)
    return rows.select(F.col("chunk").alias("doc_id"), "node", "node_name", "method", "score")
