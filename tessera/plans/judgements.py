"""Queries of claim checks, trust, resolution of names, and where results go."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import texts as X
from tessera.functions import vectors as V
from tessera.operators import claim_checks as C
from tessera.operators import dialogue, evidence, resolution as Z, retrieval as R, spaces, vector_index

from .fixtures import CLAIMS, claims, pick, pick_sql
from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

YES_NO, ACTION, GOAL, POLICY, EVENT = "('是', '否', 'true', 'false', 'True', 'False')", "落实|推动|开展|实施|坚持|承担|服务|形成|完成", "目标|建设|建成|打造|发展|提升|愿景|规划", "政策|方针|战略|方案|意见|规定", "始建|建于|成立|建成|重修|维修|发生|举办"
CLAUSE = "锚定|落实|推动|打造|建成|构建|营造|承担|获得|努力|矢志|做出|服务|坚持|开展|形成|入选|存在|达到|突破|培养|建设"


@register(f"""WITH {CLAIMS}, r AS (SELECT claim, predicate, supp, upper(trim(claim_type)) AS k, value IN {YES_NO} AND (regexp_matches(predicate, '{ACTION}|{GOAL}|{POLICY}')
        OR NOT (predicate = '开放时间' OR starts_with(predicate, '是否') OR starts_with(predicate, '有无') OR length(predicate) <= 12)) AS b FROM cl),
    l AS (SELECT claim, CASE WHEN k = 'RELATION' THEN 'RELATION' WHEN k NOT IN ('PROPERTY', '') OR b THEN 'BACKGROUND' ELSE 'PROPERTY' END AS lane, predicate || ' ' || CASE WHEN supp % 3 = 0 THEN '于2002年成立' ELSE '' END AS x FROM r)
    SELECT claim, lane, CASE WHEN lane <> 'BACKGROUND' THEN '' WHEN regexp_matches(x, '{GOAL}') THEN 'GOAL' WHEN regexp_matches(x, '{POLICY}') THEN 'POLICY' WHEN regexp_matches(x, '{EVENT}') THEN 'EVENT' WHEN regexp_matches(x, '{ACTION}') THEN 'ACTION' ELSE 'OTHER' END AS role FROM l""")
def f12_claim_lanes(spark, sf_dir):
    rows = claims(spark, sf_dir)
    rows = rows.withColumn("lane", C.lane(F.col("claim_type"), F.col("predicate"), F.col("value"), F.col("predicate") == "开放时间"))
    role = C.background_role(F.col("predicate"), F.when(F.col("supp") % 3 == 0, "于2002年成立"))
    return rows.select("claim", "lane", F.when(F.col("lane") == "BACKGROUND", role).otherwise("").alias("role"))


@register(f"""WITH {CLAIMS}, r AS (SELECT *, regexp_matches(predicate, '{CLAUSE}') AS c FROM cl) SELECT claim, CASE WHEN value IN ('是', '否') THEN
        CASE WHEN starts_with(predicate, '是否') OR starts_with(predicate, '有无') THEN NULL WHEN regexp_matches(predicate, '[“”"‘’'']') THEN 'MALFORMED_PREDICATE_BOOLEAN_VALUE' WHEN c OR length(predicate) > 12 THEN 'CLAUSE_AS_PREDICATE_BOOLEAN_VALUE' END
    WHEN claim_type = 'property' AND c AND (value = predicate OR (length(value) >= 4 AND contains(predicate, value) AND length(predicate) > length(value) + 1)) THEN 'CLAUSE_AS_PROPERTY_SELF_VALUE'
    WHEN claim_type = 'property' AND c AND NOT regexp_matches(value, '[0-9]|年|月|日|亿元|万元|平方米|公里|项|人|号|次|%') THEN 'ACTION_CLAUSE_AS_PROPERTY' END AS reason FROM r""")
def f9_malformed_claims(spark, sf_dir):
    return claims(spark, sf_dir).select("claim", C.malformed(F.col("claim_type"), F.col("predicate"), F.col("value")).alias("reason"))


@register(f"""WITH {CLAIMS}, e AS (SELECT claim, predicate, value, p_name || ' ' || p_brand || ' 位于太原' AS content, CASE line % 4 WHEN 0 THEN '' WHEN 1 THEN p_name WHEN 2 THEN upper(p_brand) || ' 位于' ELSE 'nothing like it' END AS quote FROM cl JOIN part ON p_partkey = part),
    k AS (SELECT *, lower(regexp_replace(content || ' ' || quote, '\\s+', '', 'g')) AS h, lower(regexp_replace(quote, '\\s+', '', 'g')) AS q, lower(regexp_replace(value, '\\s+', '', 'g')) AS v, lower(regexp_replace(predicate, '\\s+', '', 'g')) AS p FROM e)
    SELECT claim, CASE WHEN q = '' OR NOT contains(h, q) THEN 'quote_not_in_evidence' WHEN v <> '' AND NOT contains(h, v) THEN 'raw_value_not_in_evidence' WHEN regexp_matches(predicate, '^[A-Za-z][A-Za-z0-9_ .-]*$') AND NOT contains(h, p) THEN 'internal_schema_predicate_not_in_evidence' END AS reason FROM k""".replace("\\\\", "\\"))
def f8_surface_grounding(spark, sf_dir):
    rows = claims(spark, sf_dir).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_brand"), "part")
    content, n = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" 位于太原")), F.col("line") % 4
    quote = F.when(n == 0, "").when(n == 1, F.col("p_name")).when(n == 2, F.concat(F.upper("p_brand"), F.lit(" 位于"))).otherwise("nothing like it")
    return rows.select("claim", C.surface_reason(content, quote, F.col("value"), F.col("predicate")).alias("reason"))


#: The last words of a compact text that decide whether a passage can be in it.
COMPACT = r"b AS (SELECT item_id, lower(regexp_replace(text, '\s+', '', 'g')) AS k FROM benchmark), d AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS k FROM documents)"


def held_passages(spark, sf_dir):
    docs = t(spark, sf_dir, "documents").select("doc_id", X.compact(F.col("text")).alias("k"))
    passages = t(spark, sf_dir, "benchmark").select("item_id", X.compact(F.col("text")).alias("p"))
    return R.held_beginnings(docs, passages, "doc_id", "k", "item_id", "p", 40)


@register(f"WITH {COMPACT} SELECT doc_id, item_id FROM d JOIN b ON contains(d.k, b.k) WHERE b.k <> ''")
def f8_grounded_passages(spark, sf_dir):
    return held_passages(spark, sf_dir).where("whole").select("doc_id", "item_id")


@register(f"WITH {COMPACT} SELECT doc_id, item_id, CASE WHEN contains(d.k, b.k) THEN 1.0 ELSE 0.45 END AS coverage FROM d JOIN b ON contains(d.k, left(b.k, 40)) WHERE b.k <> ''")
def a9_quote_coverage(spark, sf_dir):
    return held_passages(spark, sf_dir).select("doc_id", "item_id", F.when(F.col("whole"), 1.0).otherwise(0.45).alias("coverage"))


OUTCOMES, OPERATIONS = ["EXACT", "ALIAS_MATCH", "SEMANTIC_MATCH", "AMBIGUOUS", "NEW_ENTITY", "OTHER"], ["NEW", "CONFLICT", "UPDATE", "DEPRECATE", "EXISTS"]
CERTAINTY = "least(1, greatest(0, CASE {s} WHEN 'EXACT' THEN 1.0 WHEN 'ALIAS_MATCH' THEN 0.95 WHEN 'SEMANTIC_MATCH' THEN 0.6 * 0.82 + 0.3 * {t} + 0.1 * least(1, {m} / 0.2) WHEN 'AMBIGUOUS' THEN 0.25 WHEN 'NEW_ENTITY' THEN 0.45 ELSE 0.35 END))"


@register(f"""WITH {CLAIMS}, g AS (SELECT part, supp, line, quantity, discount, tax, p_name, p_type, p_brand, {pick_sql(OUTCOMES, 'part')} AS s1, {pick_sql(OUTCOMES, 'part // 6')} AS s2, {pick_sql(OPERATIONS, 'part')} AS op, part % 7 = 0 AS image, part % 3 = 0 AS two FROM cl JOIN part ON p_partkey = part),
    e AS (SELECT *, p_name || ' ' || p_type AS content, CASE line % 3 WHEN 0 THEN p_name WHEN 1 THEN 'absent words' ELSE '' END AS quote, {CERTAINTY.format(s='s1', t='0.9', m='0.1')} AS r1, CASE WHEN two THEN {CERTAINTY.format(s='s2', t='0.86', m='0.3')} END AS r2 FROM g),
    c AS (SELECT part, op, image, supp AS family, supp % 3 AS kind, CASE WHEN discount > 0 THEN least(1, discount * 10) END AS authority, least(1, (quantity / 10) / 5) AS relevance, CASE WHEN quote = '' THEN 0.0 WHEN contains(content, quote) THEN 1.0 ELSE 0.45 END AS coverage, CASE WHEN tax > 0.03 THEN 1.0 ELSE 0.65 END AS locality,
        CASE WHEN supp % 4 = 0 THEN 0.5 WHEN line % 2 = 0 THEN 0.9 ELSE 0.45 END AS entailment, quantity / 50 AS confidence, least(r1, coalesce(r2, r1)) AS res, s1 = 'AMBIGUOUS' OR (two AND s2 = 'AMBIGUOUS') AS amb FROM e),
    b AS (SELECT *, coalesce(authority, 0.5) AS quality, round(((coalesce(authority, 0.5) * 0.2 + relevance * 0.1 + coverage * 0.15 + locality * 0.1 + entailment * 0.25 + least(1, confidence) * 0.1 + res * 0.1) / 1.0)::DECIMAL(20,10), 4)::DOUBLE AS binding FROM c),
    f AS (SELECT part, family, max(binding) AS s, count(*) AS n FROM b GROUP BY ALL), u AS (SELECT part, 1 - product(1 - s) AS support, count(*) AS families, sum(n)::BIGINT AS evidence FROM f GROUP BY ALL),
    o AS (SELECT part, max(quality) AS quality, max(confidence) AS confidence, min(res) AS resolution, count(DISTINCT kind) AS kinds, max(greatest(CASE WHEN op = 'CONFLICT' THEN 1.0 WHEN amb THEN 0.75 WHEN op IN ('UPDATE', 'DEPRECATE') THEN 0.55 ELSE 0 END, CASE WHEN image THEN 0.35 ELSE 0 END)) AS risk FROM b GROUP BY ALL),
    z AS (SELECT u.part, families, evidence, round(support::DECIMAL(20,10), 4)::DOUBLE AS support, round(least(1, least(1, families / 3) + CASE WHEN kinds > 1 THEN 0.1 ELSE 0 END)::DECIMAL(20,10), 4)::DOUBLE AS cross_source, round(quality::DECIMAL(20,10), 4)::DOUBLE AS quality, round(confidence::DECIMAL(20,10), 4)::DOUBLE AS confidence, round(resolution::DECIMAL(20,10), 4)::DOUBLE AS resolution, round(risk::DECIMAL(20,10), 4)::DOUBLE AS risk FROM u JOIN o USING (part))
    SELECT part, evidence, families, support, cross_source, quality, confidence, resolution, risk, round(least(1, greatest(0, 0.55 * support + 0.2 * resolution + 0.15 * quality + 0.1 * cross_source - 0.1 * risk))::DECIMAL(20,10), 4)::DOUBLE AS trust FROM z""")
def a9_trust_components(spark, sf_dir):
    rows = claims(spark, sf_dir).join(t(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), "p_name", "p_type"), "part")
    p, line = F.col("part"), F.col("line")
    one, two, has_two = pick(OUTCOMES, p), pick(OUTCOMES, F.floor(p / 6)), p % 3 == 0
    rows = rows.select(
        "part", F.col("p_name").alias("subject"), F.col("p_type").alias("predicate"), F.lit("value").alias("value"), Z.certainty(one, F.lit(0.9), F.lit(0.1)).alias("subject_score"),
        F.when(has_two, Z.certainty(two, F.lit(0.86), F.lit(0.3))).alias("target_score"), pick(OPERATIONS, p).alias("operation"), ((one == "AMBIGUOUS") | (has_two & (two == "AMBIGUOUS"))).alias("ambiguous"), (p % 7 == 0).alias("image_only"),
        F.col("supp").alias("family"), (F.col("supp") % 3).alias("kind"), F.concat("p_name", F.lit(" "), "p_type").alias("content"), F.when(line % 3 == 0, F.col("p_name")).when(line % 3 == 1, "absent words").otherwise("").alias("quote"),
        (F.col("quantity") / 10).alias("retrieval"), (F.col("tax") > 0.03).alias("located"), F.when(F.col("discount") > 0, F.col("discount") * 10).alias("authority"),
        F.when(F.col("supp") % 4 == 0, 0.5).when(line % 2 == 0, 0.9).otherwise(0.45).alias("entailment"), (F.col("quantity") / 50).alias("confidence"),
    )
    return C.trust_components(rows, "part")


@register("""SELECT l_orderkey, l_linenumber, round(least(1, 0.7 * (l_discount * 10) + 0.3 * (l_tax * 10))::DECIMAL(20,10), 3)::DOUBLE AS score FROM lineitem""")
def h9_final_evidence_score(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.evidence_score(F.col("l_discount") * 10, F.col("l_tax") * 10).alias("score"))


@register(f"""WITH {CLAIMS} SELECT claim, CASE claim_type WHEN 'property' THEN CASE WHEN predicate IN ('高度', '开放时间', 'main color') THEN 'template_property' ELSE 'discovered_property' END WHEN 'relation' THEN CASE WHEN predicate IN ('位于', 'located_in') THEN 'template_relation' ELSE 'discovered_relation' END
    WHEN 'entity' THEN 'discovered_entity' ELSE 'discovered_fact' END AS kind, CASE WHEN supp % 11 = 0 OR status = 'conflict_candidate' THEN 'CONFLICT' WHEN status = 'duplicate' THEN 'DUPLICATE' WHEN status = 'low_evidence' THEN 'LOW_EVIDENCE' WHEN status IS NULL OR status IN ('adoptable', 'needs_review') THEN 'PENDING' ELSE upper(status) END AS status FROM cl""")
def h42_candidate_status(spark, sf_dir):
    names = lambda *x: F.array(*map(F.lit, x))
    kind = C.candidate_type(F.col("claim_type"), F.col("predicate"), names("高度", "开放时间", "main color"), names("位于", "located_in"))
    return claims(spark, sf_dir).select("claim", kind.alias("kind"), C.candidate_status(F.col("status"), F.col("supp") % 11 == 0).alias("status"))


RUN = "CASE WHEN part % 4 = 0 THEN 'HIGH' WHEN part % 4 = 1 THEN 'low' END"


@register(f"""WITH {CLAIMS}, r AS (SELECT claim, upper(status) AS status, {RUN} AS risk_level, 'AUTO' AS policy, CASE WHEN supp % 2 = 0 THEN 'Supported' END AS es, line % 3 <> 0 AND coalesce(upper(status), 'PENDING') NOT IN ('DUPLICATE', 'ADOPTED', 'PUBLISHED', 'REJECTED', 'INVALIDATED') AS touched FROM cl)
    SELECT claim, touched, CASE WHEN touched AND es IS NULL THEN 'LOW_EVIDENCE' ELSE status END AS status, CASE WHEN NOT touched THEN risk_level WHEN es IS NULL OR risk_level = 'HIGH' THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level, CASE WHEN touched THEN 'MANUAL_REVIEW' ELSE policy END AS policy FROM r""")
def k14_image_only_policy(spark, sf_dir):
    p = F.col("part") % 4
    rows = claims(spark, sf_dir).select("claim", "line", F.upper("status").alias("status"), F.when(p == 0, "HIGH").when(p == 1, "low").alias("risk_level"), F.lit("AUTO").alias("policy"), F.when(F.col("supp") % 2 == 0, "Supported").alias("evidence_status"))
    return C.image_only_policy(rows, F.col("line") % 3 != 0).select("claim", "touched", "status", "risk_level", "policy")


@register("""WITH m AS (SELECT DISTINCT l_suppkey AS node, l_orderkey AS chunk FROM lineitem), c AS (SELECT o_orderkey AS chunk, CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE o_orderpriority END AS content, o_orderstatus = 'F' AS image, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 11) / 10.0 END AS s FROM orders),
    j AS (SELECT node, chunk, image, substr(content, 1, 500) AS quote, CASE WHEN image THEN least(0.75, greatest(0, coalesce(nullif(s, 0), 0.55))) ELSE 0.9 END AS score FROM m JOIN c USING (chunk) WHERE trim(content) <> '')
    SELECT node, bool_and(image) AS image_only, count(*) AS n, string_agg(chunk || ':' || CASE WHEN image THEN 'image_asset' ELSE 'domain_kb' END || ':' || quote, ',' ORDER BY chunk) AS evidence, round(sum(score), 6) AS total FROM j GROUP BY node""")
def k14_node_payloads(spark, sf_dir):
    mentions = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("chunk"))
    o = t(spark, sf_dir, "orders")
    chunks = o.select(
        F.col("o_orderkey").alias("chunk"), F.when(F.col("o_custkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("content"), F.when(F.col("o_orderstatus") == "F", "image").alias("asset_type"),
        F.when(F.col("o_orderkey") % 4 > 0, (F.col("o_orderkey") % 11) / 10.0).alias("ocr_score"),
    )
    x = C.node_payloads(mentions, chunks)
    listed = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["chunk"].cast("string"), e["source_type"], e["quote"])), ",")
    return x.select("node", "image_only", F.size("evidence").cast("long").alias("n"), listed.alias("evidence"), F.round(F.aggregate("evidence", F.lit(0.0), lambda a, e: a + e["score"]), 6).alias("total"))


BUCKET = """b AS (SELECT *, CASE WHEN coalesce(status, '') IN ('duplicate', 'low_evidence') AND claim_type <> 'fact' THEN NULL WHEN part % 9 = 0 AND claim_type <> 'fact' THEN NULL WHEN claim_type = 'property' THEN CASE WHEN supp % 2 = 0 THEN 'discovered_properties' ELSE 'template_properties' END
    WHEN claim_type = 'relation' THEN CASE WHEN supp % 2 = 0 THEN 'discovered_relations' ELSE 'template_relations' END WHEN claim_type = 'fact' THEN CASE WHEN line % 2 = 0 AND tax > 0.04 THEN 'facts' ELSE 'unverified_facts' END END AS bucket FROM cl)"""


def bucketed(spark, sf_dir):
    bucket = C.result_bucket(F.col("claim_type"), F.col("status"), F.col("supp") % 2 == 0, F.col("part") % 9 == 0, F.when(F.col("line") % 2 == 0, "http://x"), F.when(F.col("tax") > 0.04, "supported"))
    return claims(spark, sf_dir).withColumn("bucket", bucket)


@register(f"WITH {CLAIMS}, {BUCKET} SELECT claim, bucket FROM b WHERE bucket IS NOT NULL")
def k16_result_projection(spark, sf_dir):
    return bucketed(spark, sf_dir).where("bucket IS NOT NULL").select("claim", "bucket")


@register(f"WITH {CLAIMS}, {BUCKET} SELECT value AS name, 'unresolved' AS node_type, predicate AS relation, min(claim) AS claim FROM b WHERE bucket = 'discovered_relations' AND value <> '' GROUP BY ALL")
def k16_discovered_entities(spark, sf_dir):
    rows = bucketed(spark, sf_dir).where("bucket = 'discovered_relations'").select(F.col("value").alias("name"), F.lit("").alias("node_type"), F.col("predicate").alias("relation"), "claim")
    return C.discovered_entities(rows, "claim")


# ---- types, predicates and names

KINDS, CODES, LABELS = ["景点", "POI", "type_a1=学校", "大学", "Person ", "", "ce5 = x", "机构", "Widget"], ["poi", "organization", "type_a1", "person", "", "大学", "ce5"], ["学校", None, "景点", "widget", ""]
CODE = """CASE c{n} WHEN '景点' THEN 'poi' WHEN 'type_a1=学校' THEN 'type_a1' WHEN 'ce5 = x' THEN 'ce5' WHEN '学校' THEN 'organization' WHEN '机构' THEN 'organization' ELSE c{n} END"""


@register(f"""WITH r AS (SELECT p_partkey, lower(trim({pick_sql(KINDS, 'p_partkey')})) AS c1, {pick_sql(CODES, 'p_size + p_partkey // 7')} AS c2, coalesce({pick_sql(LABELS, 'p_size')}, '') AS c3 FROM part), k AS (SELECT p_partkey, {CODE.format(n=1)} AS a, {CODE.format(n=2)} AS b, {CODE.format(n=3)} AS c FROM r)
    SELECT p_partkey, a AS kind, a = '' OR b = '' OR a = b OR (c <> '' AND a = c) AS compatible FROM k""")
def f13_type_compatibility(spark, sf_dir):
    p, s = F.col("p_partkey"), F.col("p_size")
    wanted, node, label = pick(KINDS, p), pick(CODES, s + F.floor(p / 7)), pick(LABELS, s)
    return t(spark, sf_dir, "part").select("p_partkey", Z.type_code(wanted).alias("kind"), Z.type_compatible(wanted, node, label).alias("compatible"))


NAMES, ASKED = ["太原理工大学", "二郎庙", "东门", "研究所", "钟楼", "red ring"], ["隶属机构", "设计者", "", "位于"]
RAW = ["poi", "", "person", "thing", "type_b2=塔", "building", "School", "location", "文物", "entity", "ＰＯＩ", "Unknown ", "景区", "domain_x = y", "organisation", "Widget"]
CODED = ["poi", "", "person", "thing", "type_b2", "building", "organization", "region", "object", "", "poi", "", "scenicarea", "domain_x", "organization", "widget"]


@register(f"""WITH k AS (SELECT p_partkey, {pick_sql(CODED, 'p_partkey')} AS code, {pick_sql(NAMES, 'p_size')} AS name, {pick_sql(ASKED, 'p_partkey // 6')} AS pred FROM part),
    m AS (SELECT p_partkey, code, CASE WHEN code NOT IN ('', 'poi', 'thing', 'object') THEN 1 WHEN pred = '隶属机构' OR name IN ('太原理工大学', '研究所') THEN 2 WHEN pred = '设计者' THEN 3 WHEN name IN ('二郎庙', '钟楼') THEN 4 ELSE 5 END AS n FROM k)
    SELECT p_partkey, CASE n WHEN 2 THEN 'organization' WHEN 3 THEN 'person' WHEN 4 THEN 'building' ELSE code END AS kind, [0.9, 0.86, 0.82, 0.72, 0.0][n]::DOUBLE AS confidence, ['EXPLICIT_TYPE', 'DETERMINISTIC_ORGANIZATION_CUE', 'DETERMINISTIC_PERSON_PREDICATE', 'DETERMINISTIC_BUILDING_SUFFIX', 'UNRESOLVED_GENERIC_TYPE'][n] AS method FROM m""")
def h17_inferred_type(spark, sf_dir):
    p = F.col("p_partkey")
    return t(spark, sf_dir, "part").select("p_partkey", Z.inferred_type(pick(RAW, p), pick(ASKED, F.floor(p / 6)), pick(NAMES, F.col("p_size"))).alias("x")).select("p_partkey", "x.*")


PREDICATE_ALIASES = [("开放时间", "营业时间"), ("位于", "空间位置"), ("located_in", "空间位置"), ("年度重修情况", "重修")]
ALIAS_SQL = "x(predicate, alias) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in PREDICATE_ALIASES) + ")"


@register(f"WITH {CLAIMS}, {ALIAS_SQL} SELECT claim, CASE WHEN supp % 5 = 0 THEN predicate ELSE coalesce(alias, predicate) END AS predicate FROM cl LEFT JOIN x USING (predicate)")
def h12_canonical_predicate(spark, sf_dir):
    aliases = spark.createDataFrame(PREDICATE_ALIASES, "predicate string, alias string")
    role = F.when(F.col("supp") % 5 == 0, "construction_time")
    return claims(spark, sf_dir).join(aliases, "predicate", "left").select("claim", Z.canonical_predicate(F.col("predicate"), role, temporal=("construction_time",)).alias("predicate"))


#: Nodes are parts; names that several have are ambiguous.  A mention is a customer's, of the node that its key points at.  The
#: vectors of nodes are those of their number; a mention has one of the queries' vectors, each drawn near to the next node's.
NODES = """n AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE p_name || ' ' || p_partkey END AS name FROM part), al AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_brand || '-' || p_partkey END AS name FROM part),
    pc AS (SELECT count(*) AS n, min(p_partkey) AS lo FROM part), c0 AS (SELECT c_custkey, c_name, c_custkey % n + lo AS p_partkey FROM customer, pc),
    me AS (SELECT c_custkey AS mention, CASE c_custkey % 4 WHEN 0 THEN upper(p_name) || '(' || p_partkey || ')' WHEN 1 THEN p_brand || ' ' || p_partkey WHEN 2 THEN p_name ELSE c_name END AS name FROM c0 JOIN part USING (p_partkey)),
    nk AS (SELECT lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS key, count(DISTINCT node) AS n, min(node) AS node FROM n GROUP BY key), ak AS (SELECT lower(regexp_replace(name, '[^\\p{L}\\p{N}]', '', 'g')) AS key, count(DISTINCT node) AS n, min(node) AS node FROM al GROUP BY key),
    rc AS (SELECT mention, coalesce(nk.n, ak.n, 0) AS candidates, CASE WHEN coalesce(nk.n, ak.n, 0) = 1 THEN coalesce(nk.node, ak.node) END AS node, CASE WHEN coalesce(nk.n, ak.n, 0) = 0 THEN 'NO_GRAPH_MATCH' WHEN coalesce(nk.n, ak.n) > 1 THEN 'REVIEW_REQUIRED' WHEN nk.n = 1 THEN 'AUTO_EXACT_RECALL' ELSE 'AUTO_ALIAS_RECALL' END AS decision
        FROM me LEFT JOIN nk ON nk.key = lower(regexp_replace(me.name, '[^\\p{L}\\p{N}]', '', 'g')) LEFT JOIN ak ON ak.key = lower(regexp_replace(me.name, '[^\\p{L}\\p{N}]', '', 'g'))),
    ev AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    qv AS (SELECT a.vec_id AS qid, list_transform(list_zip(a.v, b.v), lambda x: x[1] * (0.5 - a.vec_id // 50 % 5 * 0.1) + x[2] * (0.5 + a.vec_id // 50 % 5 * 0.1)) AS v FROM ev a JOIN ev b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 50 = 0),
    qc AS (SELECT count(*) AS n FROM qv), mq AS (SELECT mention, mention % n * 50 AS qid FROM me, qc),
    qs AS (SELECT qid, ev.vec_id AS node, round(list_cosine_similarity(qv.v, ev.v), 6) AS score FROM qv, ev WHERE ev.vec_id <> qid),
    vr AS (SELECT mention, node, score FROM mq JOIN (SELECT * FROM qs QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, node) <= 5) USING (qid))""".replace("\\\\", "\\")


def named(spark, sf_dir):
    """(recall, ranked vector candidates, mentions) of the customers' mentions."""
    part = t(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    p = F.col("p_partkey")
    number = p.cast("string")
    nodes = part.select(p.alias("node"), F.when(p % 5 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" "), number)).alias("name"))
    aliases = part.select(p.alias("node"), F.when(p % 3 == 0, F.col("p_brand")).otherwise(F.concat("p_brand", F.lit("-"), number)).alias("name"))
    n, least = part.agg(F.count(F.lit(1)), F.min("p_partkey")).first()
    c = F.col("c_custkey")
    rows = t(spark, sf_dir, "customer").select("c_custkey", "c_name", (c % n + least).alias("p_partkey")).join(part, "p_partkey")
    name = F.when(c % 4 == 0, F.concat(F.upper("p_name"), F.lit("("), number, F.lit(")"))).when(c % 4 == 1, F.concat("p_brand", F.lit(" "), number)).when(c % 4 == 2, F.col("p_name")).otherwise(F.col("c_name"))
    mentions = rows.select(c.alias("mention"), name.alias("name"))
    e = t(spark, sf_dir, "embeddings")
    share = F.col("vec_id").cast("long")
    share = 0.5 + F.floor(share / 50) % 5 * 0.1
    near = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    mixed = F.zip_with("embedding", "next", lambda x, y: x.cast("double") * (1 - share) + y.cast("double") * share)
    asked = e.where("vec_id % 50 = 0").join(near, "vec_id").select(F.col("vec_id").alias("qid"), mixed.alias("vec"))
    best = vector_index.top_k(asked, e.select(F.col("vec_id").alias("gid"), F.col("embedding").alias("vec")), 5)
    queries = mentions.select("mention", (F.col("mention") % asked.count() * 50).alias("qid"))
    ranked = queries.join(best, "qid").select("mention", F.col("gid").alias("node"), F.round("score", 6).alias("score"))
    return Z.name_recall(mentions, nodes, aliases), ranked, n, least


@register(f"""WITH {NODES}, o AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, node) AS k FROM vr), tp AS (SELECT mention, max(node) FILTER (k = 1) AS best, max(score) FILTER (k = 1) AS top1, max(score) FILTER (k = 2) AS top2 FROM o WHERE k <= 2 GROUP BY mention),
    s AS (SELECT rc.*, best, top1, top2, round((top1 - coalesce(top2, 0))::DECIMAL(20,10), 6)::DOUBLE AS margin FROM rc LEFT JOIN tp USING (mention)),
    f AS (SELECT *, CASE decision WHEN 'AUTO_EXACT_RECALL' THEN 'EXACT' WHEN 'AUTO_ALIAS_RECALL' THEN 'ALIAS_MATCH' WHEN 'REVIEW_REQUIRED' THEN 'AMBIGUOUS' ELSE CASE WHEN top1 >= 0.84 AND margin >= 0.08 THEN 'SEMANTIC_MATCH' WHEN top1 >= 0.78 THEN 'AMBIGUOUS' ELSE 'NEW_ENTITY' END END AS status, decision = 'NO_GRAPH_MATCH' AS v FROM s)
    SELECT mention, status, CASE WHEN status = 'SEMANTIC_MATCH' THEN best ELSE node END AS node, CASE WHEN v THEN top1 END AS top1, CASE WHEN v THEN top2 END AS top2, CASE WHEN v THEN margin END AS margin FROM f""")
def k9_entity_resolution(spark, sf_dir):
    recall, ranked, *_ = named(spark, sf_dir)
    return Z.resolved(recall, ranked)


@register("""WITH r AS (SELECT c_custkey, list_extract(['EXACT', 'alias_match', 'SEMANTIC_MATCH', 'AMBIGUOUS', 'NEW_ENTITY', NULL], c_custkey % 6 + 1) AS s, CASE WHEN c_custkey % 5 > 0 THEN c_acctbal / 9000 END AS t, CASE WHEN c_custkey % 7 > 0 THEN (c_custkey % 30) / 100.0 END AS m FROM customer)
    SELECT c_custkey, round(CASE upper(coalesce(s, '')) WHEN 'EXACT' THEN 1.0 WHEN 'ALIAS_MATCH' THEN 0.95 WHEN 'AMBIGUOUS' THEN 0.25 WHEN 'NEW_ENTITY' THEN 0.45 WHEN 'SEMANTIC_MATCH' THEN CASE WHEN t IS NULL THEN 0.82 ELSE 0.6 * 0.82 + 0.3 * least(1, greatest(0, t)) + 0.1 * least(1, coalesce(m, 0) / 0.2) END ELSE 0.35 END::DECIMAL(20,10), 6)::DOUBLE AS score FROM r""")
def h43_resolution_scores(spark, sf_dir):
    c = F.col("c_custkey")
    status = pick(["EXACT", "alias_match", "SEMANTIC_MATCH", "AMBIGUOUS", "NEW_ENTITY", None], c)
    score = Z.certainty(status, F.when(c % 5 > 0, F.col("c_acctbal") / 9000), F.when(c % 7 > 0, (c % 30) / 100.0))
    return t(spark, sf_dir, "customer").select("c_custkey", S.rounded(score, 6).alias("score"))


JOINT = f"""{NODES}, pa AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 10 > 0 THEN p_partkey // 10 * 10 END AS parent FROM part), nv AS (SELECT mention, max(score) AS best FROM vr GROUP BY mention),
    j AS (SELECT rc.mention, decision, rc.node AS target, (rc.mention * 3) % pc.n + pc.lo AS subject, CASE WHEN rc.mention % 6 > 0 THEN 1 - best END AS distance, CASE WHEN rc.mention % 8 > 0 THEN (rc.mention % 100) / 80.0 END AS ev FROM pc, rc JOIN nv USING (mention)),
    cx AS (SELECT j.*, CASE WHEN target IS NULL THEN 0 WHEN coalesce(sp.parent = target, false) OR coalesce(tp.parent = subject, false) THEN 1.0 WHEN coalesce(sp.parent = tp.parent, false) THEN 0.55 ELSE 0.25 END AS context FROM j LEFT JOIN pa sp ON sp.node = subject LEFT JOIN pa tp ON tp.node = target),
    sc AS (SELECT *, round((0.45 * CASE decision WHEN 'AUTO_EXACT_RECALL' THEN 1.0 WHEN 'AUTO_ALIAS_RECALL' THEN 0.85 WHEN 'REVIEW_REQUIRED' THEN 0.35 ELSE 0 END + 0.2 * least(1, coalesce(ev, 0)) + 0.2 * context + 0.15 * CASE WHEN distance IS NULL THEN 0 ELSE 1 / (1 + greatest(0, distance)) END)::DECIMAL(20,10), 3)::DOUBLE AS score FROM cx)"""


@register(f"WITH {JOINT} SELECT mention, context::DOUBLE AS context, score, CASE WHEN decision IN ('AUTO_EXACT_RECALL', 'AUTO_ALIAS_RECALL') AND score >= 0.7 THEN 'REVIEW_READY_DETERMINISTIC' WHEN distance IS NOT NULL AND score >= 0.45 THEN 'REVIEW_REQUIRED_VECTOR_SUPPORT' ELSE 'REVIEW_REQUIRED' END AS review FROM sc")
def h36_joint_resolution(spark, sf_dir):
    recall, ranked, n, least = named(spark, sf_dir)
    p = F.col("p_partkey")
    parents = t(spark, sf_dir, "part").select(p.alias("node"), F.when(p % 10 > 0, F.floor(p / 10) * 10).alias("parent"))
    nearest = ranked.groupBy("mention").agg(F.max("score").alias("best"))
    m = F.col("mention")
    rows = recall.join(nearest, "mention").select("mention", "decision", F.col("node").alias("target"), ((m * 3) % n + least).alias("subject"), F.when(m % 6 > 0, 1 - F.col("best")).alias("distance"), F.when(m % 8 > 0, (m % 100) / 80.0).alias("ev"))
    rows = rows.join(parents.select(F.col("node").alias("subject"), F.col("parent").alias("above")), "subject", "left").join(parents.select(F.col("node").alias("target"), F.col("parent").alias("beside")), "target", "left")
    rows = rows.withColumn("context", Z.context_score(F.col("subject"), F.col("above"), F.col("target"), F.col("beside")))
    rows = rows.withColumn("score", Z.joint_score(F.col("decision"), F.col("ev"), F.col("context"), F.col("distance")))
    return rows.select("mention", "context", "score", Z.review_decision(F.col("decision"), F.col("score"), F.col("distance")).alias("review"))


@register("""SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber % 4 = 0 THEN l_discount * 10 ELSE 0.65 * (l_discount * 10) + 0.25 * (l_tax * 10) END::DECIMAL(20,10) + CASE WHEN l_suppkey % 3 = 0 THEN 0.04 ELSE 0 END, 6)::DOUBLE AS score FROM lineitem""")
def h44_reranked_score(spark, sf_dir):
    rerank = F.when(F.col("l_linenumber") % 4 != 0, F.col("l_tax") * 10)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", Z.reranked(F.col("l_discount") * 10, rerank, F.col("l_suppkey") % 3 == 0).alias("score"))


# ---- places and topics

TOPICS, UNIT_TOPICS = ["路线", "SERVICE", "建筑", "历史", "其他", None], ["路线", "设施", "历史", None, "Others"]
QUESTION = ["red widget 在哪", "blue ring", "小 plate 怎么走", ""]
SPACES = """sp AS (SELECT n_nationkey AS space, CASE WHEN n_nationkey >= 5 THEN n_nationkey // 5 WHEN n_nationkey > 0 THEN 0 END AS parent FROM nation), up AS (SELECT space AS below, parent AS above FROM sp WHERE parent IS NOT NULL UNION SELECT a.space, b.parent FROM sp a JOIN sp b ON a.parent = b.space WHERE b.parent IS NOT NULL)"""


@register(f"""WITH {SPACES}, q AS (SELECT n_nationkey AS question, n_nationkey AS here, {pick_sql(QUESTION, 'n_nationkey')} AS query, {pick_sql(TOPICS, 'n_nationkey')} AS topic FROM nation),
    u AS (SELECT p_partkey AS unit, p_name AS text, p_size % 25 AS space, {pick_sql(UNIT_TOPICS, 'p_partkey')} AS ut, split_part(p_name, ' ', 2) AS sname FROM part),
    x AS (SELECT question, unit, query, CASE WHEN query = '' THEN 0 ELSE len(list_filter(string_split(query, ''), lambda c: contains(text, c))) / length(query)::DOUBLE END AS base, CASE WHEN here = space THEN 2.0 WHEN (SELECT count(*) FROM up WHERE below = here AND above = space) > 0 THEN 1.2 WHEN (SELECT count(*) FROM up WHERE above = here AND below = space) > 0 THEN 1.8 ELSE 1.0 END AS f,
        CASE WHEN contains(query, sname) THEN 3.0 ELSE 1.0 END AS g, CASE WHEN topic <> '' AND topic = ut THEN 1.5 ELSE 1.0 END AS h FROM q, u)
    SELECT question, unit, round((base * f * g * h)::DECIMAL(20,10), 6)::DOUBLE AS score FROM x""")
def h37_character_overlap(spark, sf_dir):
    k = F.col("n_nationkey")
    nation = t(spark, sf_dir, "nation")
    tree = nation.select(k.alias("space"), F.when(k >= 5, F.floor(k / 5)).when(k > 0, 0).alias("parent"))
    asked = nation.select(k.alias("question"), k.alias("here"), pick(QUESTION, k).alias("query"), pick(TOPICS, k).alias("topic"))
    p = F.col("p_partkey")
    units = t(spark, sf_dir, "part").select(p.alias("unit"), "p_name", (F.col("p_size") % 25).cast("long").alias("space"), pick(UNIT_TOPICS, p).alias("ut"))
    # Each question of a nation, of which there are few, meets every unit.
    pairs = units.crossJoin(F.broadcast(asked))
    rows = pairs.join(spaces.relation(spaces.closure(tree), asked), ["question", "space"], "left")
    named = F.contains("query", F.split_part("p_name", F.lit(" "), F.lit(2)))
    score = spaces.unit_score(F.col("query"), F.col("p_name"), F.col("where"), named, F.col("topic"), F.col("ut"))
    return rows.select("question", "unit", S.rounded(score, 6).alias("score"))


@register(f"""WITH e AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) + CASE WHEN vec_id % 3 = 0 THEN 0.4 ELSE 0 END AS c, {pick_sql(TOPICS, 'vec_id')} AS topic, {pick_sql(UNIT_TOPICS, 'vec_id // 6')} AS ut FROM embeddings),
    b AS (SELECT *, CASE WHEN vec_id % 4 = 0 THEN c * 1.05 + 0.05 ELSE c END AS s FROM e), f AS (SELECT vec_id, CASE WHEN label = 3 AND s > 0.3 THEN s * CASE WHEN topic IN ('路线', 'SERVICE') AND ut IN ('路线', '设施', 'Others') THEN 2.0 WHEN topic = '建筑' THEN 1.2 WHEN topic = '历史' THEN 1.05 ELSE 1.1 END ELSE s END AS s FROM b)
    SELECT vec_id, round(s, 6) AS score FROM f WHERE s > 0.38""")
def h39_boosted_score(spark, sf_dir):
    e, v = t(spark, sf_dir, "embeddings"), F.col("vec_id")
    # One question, so its side is one row.
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    c = V.cosine(F.col("embedding"), F.col("q")) + F.when(v % 3 == 0, 0.4).otherwise(0.0)
    words = F.when(v % 4 == 0, F.array(F.lit("塔"), F.lit("钟楼"))).when(v % 4 == 1, F.array(F.lit("门")))
    score = spaces.boosted(c, F.lit("钟楼和东门"), words, F.col("label") == 3, F.coalesce(pick(TOPICS, v), F.lit("")), pick(UNIT_TOPICS, F.floor(v / 6)))
    return e.crossJoin(F.broadcast(one)).select("vec_id", score.alias("score")).where("score > 0.38").withColumn("score", F.round("score", 6))


@register("""WITH c AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)) AS v, CASE WHEN vec_id % 3 > 0 THEN (vec_id % 10) / 10.0 END AS k, label / 10.0 AS s FROM embeddings)
    SELECT vec_id, round(0.5 * v + 0.3 * coalesce(k, 0) + 0.2 * s, 6) AS score FROM c""")
def x7_channel_fusion(spark, sf_dir):
    e, v = t(spark, sf_dir, "embeddings"), F.col("vec_id")
    one = e.where("vec_id = 7").select(F.col("embedding").alias("q")).limit(1)
    rows = e.crossJoin(F.broadcast(one))
    channels = [rows.select("vec_id", F.lit(n).alias("channel"), x.alias("score")) for n, x in (("vector", V.cosine(F.col("embedding"), F.col("q"))), ("keyword", F.when(v % 3 > 0, (v % 10) / 10.0)), ("node", F.col("label") / 10.0))]
    hits = channels[0].unionByName(channels[1]).unionByName(channels[2]).where("score IS NOT NULL")
    return R.fused_channels(hits, "vec_id", "channel", "score", {"vector": 0.5, "keyword": 0.3, "node": 0.2}).withColumn("score", F.round("score", 6))


# ---- dialogue

SAID = ["是的，完成了", "还没完成", "OK", "不是这样", "hmm", "任务完成", "", None, "Yeah!", "完成。"]
TOLD = ["请确认 __NPC_CONFIRM_PENDING__", "继续"]


@register(f"""WITH c AS (SELECT conv_id, turn, lower(trim(coalesce({pick_sql(SAID, 'conv_id + turn')}, ''))) AS x FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(x, '不是|不对|没有|未|没拿到|还没|不确定|不用|不行|否') THEN 'negative' WHEN regexp_matches(x, '是|对|嗯|好|行|可以|确认|确定|没错|正确|已经|拿到了|完成|ok|y') THEN 'affirmative' ELSE 'none' END AS reply,
    regexp_matches(x, '任务完成|完成了|我完成|已完成|结束|通关|搞定') OR x IN ('完成', '完成!', '完成。') AS done FROM c""")
def h34_reply_classifier(spark, sf_dir):
    said = pick(SAID, F.col("conv_id") + F.col("turn"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", dialogue.reply(said).alias("reply"), dialogue.says_done(said).alias("done"))


@register(f"""WITH c AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN {pick_sql(TOLD, 'conv_id')} ELSE {pick_sql(SAID, 'conv_id + turn')} END AS x FROM conversations), p AS (SELECT conv_id, bool_or(role = 'assistant' AND contains(coalesce(x, ''), '__NPC_CONFIRM_PENDING__')) AS pending FROM c GROUP BY conv_id),
    l AS (SELECT conv_id, x FROM c WHERE role = 'user' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1) SELECT p.conv_id, pending, pending AND NOT regexp_matches(lower(trim(coalesce(x, ''))), '不是|不对|没有|未|没拿到|还没|不确定|不用|不行|否') AND regexp_matches(lower(trim(coalesce(x, ''))), '是|对|嗯|好|行|可以|确认|确定|没错|正确|已经|拿到了|完成|ok|y') AS confirmed FROM p LEFT JOIN l USING (conv_id)""")
def q15_pending_confirmation(spark, sf_dir):
    c = t(spark, sf_dir, "conversations")
    text = F.when(F.col("role") == "assistant", pick(TOLD, F.col("conv_id"))).otherwise(pick(SAID, F.col("conv_id") + F.col("turn")))
    rows = c.select("conv_id", "turn", "role", text.alias("text"))
    return dialogue.pending(rows, "conv_id").join(dialogue.confirmed(rows, "conv_id", "turn"), "conv_id")


# ---- names in texts, batches, search

GRAMMED = """n AS (SELECT id, name FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_partkey::VARCHAR ELSE substr(md5(p_partkey::VARCHAR), 1, 2 + p_partkey % 3) END AS name FROM part)),
    u AS (SELECT name, min(id) AS id FROM n WHERE length(trim(name)) >= 2 GROUP BY name HAVING count(*) = 1), c AS (SELECT conv_id, turn, text || ' ' || md5(conv_id::VARCHAR || '-' || turn) || ' ' || (conv_id % 300) || ' red ring blue bolt' AS text FROM conversations),
    h AS (SELECT conv_id, turn, id, name FROM c JOIN u ON CASE WHEN regexp_matches(name, '^[0-9]+$') THEN regexp_matches(text, '(^|[^0-9A-Za-z])' || name || '([^0-9A-Za-z]|$)') ELSE contains(text, name) END),
    o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(name) DESC, name) AS place FROM h)"""


def text_mentions(spark, sf_dir, most):
    p = F.col("p_partkey")
    name = F.when(p % 3 == 0, F.col("p_name")).when(p % 3 == 1, p.cast("string")).otherwise(F.substring(F.md5(p.cast("string")), F.lit(1), (2 + p % 3).cast("int")))
    nodes = t(spark, sf_dir, "part").select(p.alias("id"), name.alias("name"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    texts = t(spark, sf_dir, "conversations").select(key.alias("turn_key"), F.concat("text", F.lit(" "), F.md5(key), F.lit(" "), (F.col("conv_id") % 300).cast("string"), F.lit(" red ring blue bolt")).alias("text"))
    out = evidence.mentions(texts, nodes, "turn_key", "text", most)
    part = F.split("turn_key", "-")
    return out.select(part[0].cast("long").alias("conv_id"), part[1].cast("int").alias("turn"), "id", "name", "place")


@register(f"WITH {GRAMMED} SELECT conv_id, turn, id, name, place FROM o WHERE place <= 30")
def j11_mention_extraction(spark, sf_dir):
    return text_mentions(spark, sf_dir, evidence.MOST_NAMES)


@register(f"WITH {GRAMMED} SELECT conv_id, turn, name, place FROM o WHERE place <= 3")
def w8_longest_first(spark, sf_dir):
    return text_mentions(spark, sf_dir, 3).select("conv_id", "turn", "name", "place")


@register("""WITH u AS (SELECT l_suppkey % 3 AS run, l_orderkey * 8 + l_linenumber AS unit, l_returnflag = 'A' AS is_image, -l_quantity AS priority FROM lineitem) SELECT run, unit, is_image, ((row_number() OVER (PARTITION BY run, is_image ORDER BY priority, unit) - 1) // CASE WHEN is_image THEN 16 ELSE 200 END + 1)::BIGINT AS batch FROM u""")
def q6_evidence_batches(spark, sf_dir):
    units = t(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 3).alias("run"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("unit"), (F.col("l_returnflag") == "A").alias("is_image"), (-F.col("l_quantity")).alias("priority"))
    return evidence.claim_batches(units).select("run", "unit", "is_image", F.col("batch").cast("long").alias("batch"))


@register("""WITH k AS (SELECT doc_id, text, contains(lower(text), 'the')::INT + contains(lower(text), 'tion')::INT AS h FROM documents), v AS (SELECT doc_id, text, 1.0 / (1 + n_chars / 1000.0) AS s FROM documents),
    a AS (SELECT doc_id AS id, text AS content, h * 1.0 AS similarity, 0 AS channel FROM k WHERE h > 1 UNION ALL SELECT doc_id, text, s, 1 FROM v),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY channel, similarity DESC, id) AS n FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY md5(lower(trim(content))) ORDER BY channel, similarity DESC, id) AS m FROM b WHERE n = 1)
    SELECT id, round(similarity, 6) AS similarity, channel FROM (SELECT * FROM c WHERE m = 1 ORDER BY channel, similarity DESC, id LIMIT 400)""")
def u2_hybrid_merge(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    hits = X.keyword_hits(F.col("text"), ["the", "tion"])
    first = d.where(hits > 1).select(F.col("doc_id").alias("id"), F.col("text").alias("content"), hits.cast("double").alias("similarity"))
    second = d.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), (1.0 / (1 + F.col("n_chars") / 1000.0)).alias("similarity"))
    return R.merged_search(first, second, 400).select("id", F.round("similarity", 6).alias("similarity"), "channel")


TITLE = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' ' || p_brand WHEN 2 THEN p_brand || ' ' || upper(p_name) ELSE p_type END"


@register(f"""WITH d AS (SELECT l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY id), n AS (SELECT p_partkey AS id, {TITLE} AS name FROM part), s AS (SELECT n.id, name, CASE WHEN lower(name) = 'red ring' THEN 100 WHEN starts_with(lower(name), 'red ring') THEN 80 WHEN contains(lower(name), 'red ring') THEN 60 ELSE 30 END AS tier, coalesce(degree, 0) AS degree FROM n LEFT JOIN d ON d.id = n.id)
    SELECT * FROM s ORDER BY tier DESC, degree DESC, name, id LIMIT 200""")
def t8_relevance_tiers(spark, sf_dir):
    degree = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    n, name, brand = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand")
    title = F.when(n == 0, name).when(n == 1, F.concat_ws(" ", name, brand)).when(n == 2, F.concat_ws(" ", brand, F.upper(name))).otherwise(F.col("p_type"))
    rows = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), title.alias("name")).join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    rows = rows.withColumn("tier", R.relevance_tier(F.col("name"), "Red ring ", F.lit(False)))
    return rows.orderBy(F.desc("tier"), F.desc("degree"), "name", "id").limit(200).select("id", "name", "tier", "degree")
