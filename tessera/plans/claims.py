"""Queries on claims: line items say of a part what its return flag and line status are; suppliers are the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import scoring as S
from tessera.operators import claims as C
from tessera.operators import retrieval as R

from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

CLAIMS = """c AS (SELECT l_orderkey * 16 + l_linenumber * 2 AS claim_id, l_partkey AS subject, 'flag' AS predicate, l_returnflag AS value, l_suppkey AS source, l_discount * 10 AS confidence, l_tax AS tax, l_shipdate AS day FROM lineitem
    UNION ALL SELECT l_orderkey * 16 + l_linenumber * 2 + 1, l_partkey, 'status', l_linestatus, l_suppkey, l_discount * 10, l_tax, l_shipdate FROM lineitem)"""
KEY = ["subject", "predicate"]


def claims(spark, sf_dir) -> DataFrame:
    rows = t(spark, sf_dir, "lineitem")
    two = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("flag").alias("predicate"), F.col("l_returnflag").alias("value")), F.struct(F.lit(1).alias("k"), F.lit("status").alias("predicate"), F.col("l_linestatus").alias("value"))))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_shipdate", two.alias("z"))
    return rows.select(
        (F.col("l_orderkey") * 16 + F.col("l_linenumber") * 2 + F.col("z.k")).alias("claim_id"), F.col("l_partkey").alias("subject"), "z.predicate", "z.value",
        F.col("l_suppkey").alias("source"), (F.col("l_discount") * 10).alias("confidence"), F.col("l_tax").alias("tax"), F.col("l_shipdate").alias("day"),
    )


FUSED = f"""{CLAIMS}, b AS (SELECT subject, predicate, value, source, max(least(1, greatest(0, confidence))) AS s, count(*) AS n FROM c GROUP BY ALL),
    k AS (SELECT subject, predicate, value, count(DISTINCT source % 3) AS kinds FROM c GROUP BY ALL),
    f AS (SELECT subject, predicate, value, 1 - product(1 - s) AS support, count(*) AS families, sum(n)::BIGINT AS evidence FROM b GROUP BY ALL),
    z AS (SELECT f.*, kinds, least(1, least(1, families / 3) + CASE WHEN kinds > 1 THEN 0.1 ELSE 0 END) AS cross_source FROM f JOIN k USING (subject, predicate, value))"""


def fused(spark, sf_dir):
    return C.fused(claims(spark, sf_dir).withColumn("kind", F.col("source") % 3), [*KEY, "value"], "source", "kind", "confidence")


@register(f"WITH {FUSED} SELECT subject, predicate, value, round(support::DECIMAL(20,10), 6)::DOUBLE AS support, families, evidence, kinds, round(cross_source, 6) AS cross_source FROM z")
def a6_evidence_fusion(spark, sf_dir):
    return fused(spark, sf_dir).withColumns({"support": S.rounded(F.col("support"), 6), "cross_source": F.round("cross_source", 6)})


@register("""SELECT l_orderkey, l_linenumber, round((CASE WHEN l_tax = 0 THEN (least(1, l_discount * 10) * 0.5 + least(1, l_quantity / 50) * 0.3) / 0.8 ELSE (least(1, l_discount * 10) * 0.5 + least(1, l_quantity / 50) * 0.3 + least(1, l_tax * 10) * 0.2) / 1.0 END)::DECIMAL(20,10), 3)::DOUBLE AS support FROM lineitem""")
def a7_weighted_mean(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").withColumns({"a": F.col("l_discount") * 10, "b": F.col("l_quantity") / 50, "c": F.when(F.col("l_tax") != 0, F.col("l_tax") * 10)})
    return rows.select("l_orderkey", "l_linenumber", S.weighted_mean({"a": 0.5, "b": 0.3, "c": 0.2}, 3).alias("support"))


@register(f"WITH {FUSED} SELECT subject, predicate, value, round(least(1, greatest(0, 0.55 * support + 0.2 + 0.15 * 0.5 + 0.1 * cross_source - 0.1 * 0.25))::DECIMAL(20,10), 4)::DOUBLE AS trust FROM z")
def a8_trust_score(spark, sf_dir):
    score = S.trust(F.col("support"), F.lit(1.0), F.lit(0.5), F.col("cross_source"), F.lit(0.25))
    return fused(spark, sf_dir).select(*KEY, "value", score.alias("trust"))


CLASSES = f"""{CLAIMS}, g AS (SELECT subject, predicate, count(DISTINCT value) AS n_values, count(DISTINCT source) AS n_sources, max(confidence) AS best, arg_max(value, (confidence, value)) AS best_value FROM c GROUP BY ALL),
    x AS (SELECT *, CASE WHEN best < 0.1 THEN 'unsupported' WHEN best < 0.45 THEN 'weak' WHEN n_values <= 1 THEN 'same_value' WHEN predicate = 'status' THEN 'exclusive' ELSE 'multi_value' END AS conflict_class FROM g)"""


def classes(spark, sf_dir):
    return C.classified(claims(spark, sf_dir), KEY, F.col("predicate") == "status", F.lit(False))


@register(f"WITH {CLASSES} SELECT subject, predicate, n_values, n_sources, round(best, 6) AS best, best_value, conflict_class FROM x")
def a12_group_classification(spark, sf_dir):
    return classes(spark, sf_dir).withColumn("best", F.round("best", 6))


RISK = "CASE WHEN conflict_class IN ('exclusive', 'unsupported') OR best < 0.45 THEN 'HIGH' WHEN n_sources < 2 OR conflict_class <> 'same_value' THEN 'MEDIUM' ELSE 'LOW' END"


@register(f"WITH {CLASSES}, r AS (SELECT *, {RISK} AS risk FROM x) SELECT subject, predicate, risk, CASE risk WHEN 'HIGH' THEN 'MANUAL_REVIEW' WHEN 'MEDIUM' THEN 'BATCH_REVIEW' ELSE 'AUTO_PUBLISH' END AS policy FROM r")
def a11_risk_level(spark, sf_dir):
    rows = classes(spark, sf_dir).withColumn("risk", C.risk_level(F.col("conflict_class"), F.col("n_sources"), F.col("best")))
    return rows.select(*KEY, "risk", C.policy(F.col("risk")).alias("policy"))


PENALTY = "CASE conflict_class WHEN 'multi_value' THEN 0.12 WHEN 'exclusive' THEN 0.35 WHEN 'temporal' THEN 0.25 WHEN 'weak' THEN 0.3 WHEN 'unsupported' THEN 0.35 ELSE 0 END"


@register(f"WITH {CLASSES} SELECT subject, predicate, round(greatest(0, 0.7 * least(1, best) + 0.3 * least(1, n_sources / 3) - {PENALTY}), 6) AS recommendation FROM x")
def a10_recommendation(spark, sf_dir):
    score = 0.7 * F.least(F.lit(1.0), F.col("best")) + 0.3 * F.least(F.lit(1.0), F.col("n_sources") / 3) - C.penalty(F.col("conflict_class"))
    return classes(spark, sf_dir).select(*KEY, F.round(F.greatest(F.lit(0.0), score), 6).alias("recommendation"))


@register(f"WITH {CLASSES} SELECT conflict_class, count(*) AS groups, sum(n_values)::BIGINT AS n_values, round(avg(best), 6) AS mean_best FROM x GROUP BY ALL")
def k5_group_records(spark, sf_dir):
    return classes(spark, sf_dir).groupBy("conflict_class").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_values").alias("n_values"), F.round(F.avg("best"), 6).alias("mean_best"))


@register(f"WITH {CLAIMS} SELECT subject, predicate, arg_max(value, (confidence, -claim_id)) AS value, list(claim_id ORDER BY claim_id) AS claim_ids, count(DISTINCT source) AS n_sources, round(max(confidence), 6) AS confidence FROM c GROUP BY ALL")
def a13_canonical_claims(spark, sf_dir):
    return C.canonical(claims(spark, sf_dir), KEY).withColumn("confidence", F.round("confidence", 6))


@register(f"WITH {CLAIMS} SELECT subject, predicate, count(DISTINCT source) AS n_sources, round(max(confidence), 6) AS best, list_sort(list_distinct(list(value))) AS seen FROM c GROUP BY ALL")
def a14_candidate_statistics(spark, sf_dir):
    return claims(spark, sf_dir).groupBy(*KEY).agg(F.countDistinct("source").alias("n_sources"), F.round(F.max("confidence"), 6).alias("best"), F.sort_array(F.collect_set("value")).alias("seen"))


PUBLISHED = "p AS (SELECT DISTINCT subject, predicate, value FROM c WHERE day < TIMESTAMP '1998-01-01'), n AS (SELECT DISTINCT subject, predicate, value FROM c WHERE day >= TIMESTAMP '1998-01-01'), s AS (SELECT subject, predicate, list(value) AS known FROM p GROUP BY ALL)"


@register(f"""WITH {CLAIMS}, {PUBLISHED} SELECT n.subject, n.predicate, n.value, CASE WHEN known IS NULL THEN 'NEW' WHEN list_contains(known, n.value) THEN 'EXISTS' WHEN n.predicate = 'status' THEN 'CONFLICT' ELSE 'ADD' END AS operation FROM n LEFT JOIN s USING (subject, predicate)""")
def k6_knowledge_delta(spark, sf_dir):
    rows = claims(spark, sf_dir)
    old, new = rows.where("day < timestamp'1998-01-01'"), rows.where("day >= timestamp'1998-01-01'")
    new = new.select(*KEY, "value").distinct().withColumn("single", F.col("predicate") == "status")
    return C.deltas(new, old.select(*KEY, "value"), KEY).drop("single")


@register(f"WITH {CLAIMS}, {PUBLISHED} SELECT subject, predicate, value FROM n SEMI JOIN p USING (subject, predicate, value)")
def f16_published_duplicates(spark, sf_dir):
    rows = claims(spark, sf_dir)
    old = rows.where("day < timestamp'1998-01-01'").select(*KEY, "value")
    return rows.where("day >= timestamp'1998-01-01'").select(*KEY, "value").distinct().join(old, [*KEY, "value"], "left_semi")


@register(f"""WITH {CLAIMS}, {PUBLISHED} SELECT n.subject, n.predicate, count(*) AS claims, count(*) FILTER (list_contains(known, n.value)) AS duplicates, count(*) FILTER (NOT list_contains(known, n.value)) AS conflicts FROM n JOIN s USING (subject, predicate) GROUP BY ALL""")
def k3_compare_with_published(spark, sf_dir):
    rows = claims(spark, sf_dir)
    known = rows.where("day < timestamp'1998-01-01'").groupBy(*KEY).agg(F.collect_set("value").alias("known"))
    new = rows.where("day >= timestamp'1998-01-01'").select(*KEY, "value").distinct().join(known, KEY)
    held = F.array_contains("known", F.col("value"))
    return new.groupBy(*KEY).agg(F.count(F.lit(1)).alias("claims"), F.count_if(held).alias("duplicates"), F.count_if(~held).alias("conflicts"))


@register(f"WITH {CLAIMS} SELECT subject, predicate, count(*) AS claims, count(DISTINCT value) > 1 AS conflicting FROM c GROUP BY ALL")
def k4_compare_within_run(spark, sf_dir):
    return claims(spark, sf_dir).groupBy(*KEY).agg(F.count(F.lit(1)).alias("claims"), (F.countDistinct("value") > 1).alias("conflicting"))


@register("""SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 2 ELSE 1 END, o_orderdate DESC NULLS LAST, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def w1_review_queue(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ADOPTED").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("PENDING")
    rows = C.review_queue(t(spark, sf_dir, "orders").withColumn("status", status), ["o_custkey", "o_orderpriority"], "status", "o_orderdate", "o_orderkey")
    return rows.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


@register("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'PENDING' WHEN o_orderstatus = 'P' THEN 'INVALIDATED' ELSE 'BLOCKED_BY_DEPENDENCY' END AS downstream FROM orders")
def k11_dependency_status(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "ADOPTED").when(F.col("o_orderstatus") == "P", "REJECTED").otherwise("PENDING")
    return t(spark, sf_dir, "orders").select("o_orderkey", C.dependent_status(status).alias("downstream"))


@register(f"""WITH {CLAIMS}, o AS (SELECT subject, predicate, max(confidence) AS confidence FROM c WHERE day < TIMESTAMP '1998-01-01' GROUP BY ALL), n AS (SELECT subject, predicate, max(confidence) AS confidence FROM c WHERE day >= TIMESTAMP '1998-01-01' GROUP BY ALL)
    SELECT subject, predicate, round(CASE WHEN o.subject IS NOT NULL AND subject % 5 = 0 THEN o.confidence ELSE greatest(o.confidence, n.confidence) END, 6) AS confidence, coalesce(CASE WHEN o.subject IS NOT NULL THEN CASE WHEN subject % 5 = 0 THEN 'ADOPTED' ELSE 'PENDING' END END, 'PENDING') AS status FROM o FULL JOIN n USING (subject, predicate)""")
def k7_candidate_merge(spark, sf_dir):
    rows = claims(spark, sf_dir)
    best = lambda d: d.groupBy(*KEY).agg(F.max("confidence").alias("confidence"))
    old = best(rows.where("day < timestamp'1998-01-01'")).withColumn("status", F.when(F.col("subject") % 5 == 0, "ADOPTED").otherwise("PENDING"))
    new = best(rows.where("day >= timestamp'1998-01-01'")).withColumn("status", F.lit("PENDING"))
    return C.upserted(old, new, KEY, ["confidence"], F.col("o.status") == "ADOPTED").withColumn("confidence", F.round("confidence", 6))


@register(f"WITH {CLAIMS} SELECT DISTINCT sha256(concat_ws(chr(31), subject, predicate, value, source)) AS binding_uid FROM c")
def k8_fact_bindings(spark, sf_dir):
    key = K.claim_key(F.col("subject"), F.col("predicate"), F.col("value"), F.col("source"))
    return claims(spark, sf_dir).select(key.alias("binding_uid")).distinct()


@register(f"WITH {CLASSES} SELECT subject, predicate, conflict_class, CASE WHEN conflict_class <> 'same_value' AND n_values <= 1 THEN 'same_value' ELSE conflict_class END AS sanitised FROM x")
def k10_same_value_sanitiser(spark, sf_dir):
    same = (F.col("conflict_class") != "same_value") & (F.col("n_values") <= 1)
    return classes(spark, sf_dir).select(*KEY, "conflict_class", F.when(same, "same_value").otherwise(F.col("conflict_class")).alias("sanitised"))


@register(f"WITH {CLAIMS} SELECT predicate, value, CASE predicate WHEN 'status' THEN 'exclusive' ELSE 'append' END AS policy, count(*) AS claims FROM c GROUP BY ALL")
def k12_policy_lookup(spark, sf_dir):
    table = spark.createDataFrame([("status", "exclusive")], "predicate string, policy string")
    rows = claims(spark, sf_dir).join(table, "predicate", "left")
    return rows.groupBy("predicate", "value", F.coalesce("policy", F.lit("append")).alias("policy")).agg(F.count(F.lit(1)).alias("claims"))


@register("SELECT o_orderkey, CASE WHEN o_orderkey <= 0 THEN 'INVALID_ID' WHEN o_orderstatus = 'F' THEN 'UNCHANGED' ELSE 'UPDATED' END AS outcome FROM orders")
def k13_status_batch_update(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") <= 0, "INVALID_ID").when(F.col("o_orderstatus") == "F", "UNCHANGED").otherwise("UPDATED").alias("outcome"))


@register(f"WITH {CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate, value ORDER BY confidence DESC, claim_id) AS n FROM c) SELECT subject, predicate, value, claim_id FROM r WHERE n = 1")
def u10_claim_dedupe(spark, sf_dir):
    return R.first_by_key(claims(spark, sf_dir), [*KEY, "value"], [F.desc("confidence"), F.col("claim_id")]).select(*KEY, "value", "claim_id")


@register(f"""WITH {CLAIMS}, r AS (SELECT claim_id, 1 AS prio FROM c WHERE tax > 0.06 UNION ALL SELECT claim_id, 2 FROM c WHERE confidence < 0.2) SELECT claim_id, min(prio) AS origin FROM r GROUP BY claim_id""")
def u9_conflict_union(spark, sf_dir):
    c = claims(spark, sf_dir)
    rows = c.where("tax > 0.06").select("claim_id", F.lit(1).alias("origin")).unionByName(c.where("confidence < 0.2").select("claim_id", F.lit(2).alias("origin")))
    return R.first_by_key(rows, ["claim_id"], [F.col("origin")])


@register("SELECT sha256(concat_ws('|', least(a, b), greatest(a, b)))[1:48] AS pair_key, count(*) AS n FROM (SELECT l_partkey::VARCHAR AS a, l_suppkey::VARCHAR AS b FROM lineitem) GROUP BY ALL")
def h20_pair_keys(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy(K.pair_key(F.col("l_partkey"), F.col("l_suppkey")).alias("pair_key")).agg(F.count(F.lit(1)).alias("n"))


@register(f"WITH {CLAIMS} SELECT claim_id, sha256(concat_ws(chr(31), subject, predicate, value)) AS canonical_claim_key, sha256(concat_ws(chr(31), subject, predicate)) AS conflict_scope_key FROM c")
def h19_claim_keys(spark, sf_dir):
    return claims(spark, sf_dir).select(
        "claim_id", K.claim_key(F.col("subject"), F.col("predicate"), F.col("value")).alias("canonical_claim_key"), K.claim_key(F.col("subject"), F.col("predicate")).alias("conflict_scope_key")
    )


@register("SELECT l_orderkey, l_linenumber, md5(concat_ws('|', l_orderkey, l_partkey, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END)) AS content_hash FROM lineitem")
def h21_content_hash(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.content_hash(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string"), flag).alias("content_hash"))


@register(f"""WITH {CLAIMS}, v AS (SELECT claim_id, 0.35 * (value = 'A')::INT + 0.25 * least(1, confidence) + 0.2 + 0.2 * least(1, tax * 10) AS s FROM c)
    SELECT claim_id, round(s, 6) AS score, CASE WHEN round(s, 9) >= 0.75 THEN 'supported' WHEN round(s, 9) >= 0.45 THEN 'weak' ELSE 'unsupported' END AS status FROM v""")
def h10_verification(spark, sf_dir):
    one = F.lit(1.0)
    s = F.round(S.verification((F.col("value") == "A").cast("int"), F.least(one, F.col("confidence")), one, F.least(one, F.col("tax") * 10)), 9)
    return claims(spark, sf_dir).select("claim_id", F.round(s, 6).alias("score"), S.support_status(s).alias("status"))


@register("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'FACT' WHEN o_orderpriority LIKE '1-%' OR o_orderpriority LIKE '2-%' THEN 'NODE' ELSE 'PROPERTY' END AS track, CASE WHEN o_orderstatus = 'F' THEN 'AUDIT_ONLY' WHEN o_totalprice > 200000 THEN 'GROWTH_RUN' ELSE 'NODE_WORKBENCH' END AS surface FROM orders""")
def f4_candidate_projection(spark, sf_dir):
    done, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority").startswith("1-") | F.col("o_orderpriority").startswith("2-")
    track = F.when(done, "FACT").when(urgent, "NODE").otherwise("PROPERTY")
    return t(spark, sf_dir, "orders").select("o_orderkey", track.alias("track"), F.when(done, "AUDIT_ONLY").when(F.col("o_totalprice") > 200000, "GROWTH_RUN").otherwise("NODE_WORKBENCH").alias("surface"))


@register(f"""WITH {CLAIMS}, b AS (SELECT claim_id, subject, source FROM c), u AS (SELECT l_suppkey AS source, count(*) AS units FROM lineitem GROUP BY ALL)
    SELECT subject, list(DISTINCT source ORDER BY source) AS sources, sum(units)::BIGINT AS units FROM b JOIN u USING (source) GROUP BY ALL""")
def j19_claim_lineage(spark, sf_dir):
    units = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count(F.lit(1)).alias("units"))
    return claims(spark, sf_dir).join(units, "source").groupBy("subject").agg(F.sort_array(F.collect_set("source")).alias("sources"), F.sum("units").alias("units"))


@register(f"""WITH {CLAIMS} SELECT subject, predicate, count(DISTINCT source) >= 2 AND max(confidence) >= 0.9 AS covered, count(*) AS hits FROM c GROUP BY ALL""")
def a29_coverage_test(spark, sf_dir):
    rows = claims(spark, sf_dir).groupBy(*KEY).agg(F.countDistinct("source").alias("n"), F.max("confidence").alias("best"), F.count(F.lit(1)).alias("hits"))
    return rows.select(*KEY, ((F.col("n") >= 2) & (F.col("best") >= 0.9)).alias("covered"), "hits")


@register(f"""WITH {CLASSES} SELECT subject, CASE WHEN bool_or(conflict_class = 'exclusive') THEN 'conflicted' WHEN bool_and(conflict_class = 'unsupported') THEN 'weak' WHEN bool_or(n_sources >= 2) THEN 'pending_review' WHEN max(best) >= 0.45 THEN 'needs_more_evidence' ELSE 'weak' END AS gap_status FROM x GROUP BY ALL""")
def a27_gap_status(spark, sf_dir):
    rows = classes(spark, sf_dir).groupBy("subject").agg(
        F.bool_or(F.col("conflict_class") == "exclusive").alias("c"), F.bool_and(F.col("conflict_class") == "unsupported").alias("u"), F.bool_or(F.col("n_sources") >= 2).alias("p"), F.max("best").alias("b")
    )
    return rows.select("subject", F.when(F.col("c"), "conflicted").when(F.col("u"), "weak").when(F.col("p"), "pending_review").when(F.col("b") >= 0.45, "needs_more_evidence").otherwise("weak").alias("gap_status"))


@register(f"""WITH {CLAIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY subject, predicate ORDER BY confidence DESC, claim_id) AS n FROM c), k AS (SELECT subject, predicate, max(value) FILTER (n = 1) AS top, round(max(confidence) FILTER (n = 1), 6) AS s1, round(coalesce(max(confidence) FILTER (n = 2), 0), 6) AS s2 FROM r WHERE n <= 2 GROUP BY ALL)
    SELECT subject, predicate, top, CASE WHEN s1 >= 0.84 AND round(s1 - s2, 6) >= 0.08 THEN 'SEMANTIC_MATCH' WHEN s1 >= 0.78 THEN 'AMBIGUOUS' ELSE 'NEW_ENTITY' END AS resolution FROM k""")
def k9_margin_resolution(spark, sf_dir):
    rows = R.first_by_key(claims(spark, sf_dir), KEY, [F.desc("confidence"), F.col("claim_id")], 2)
    order = W.partitionBy(*KEY).orderBy(F.desc("confidence"), "claim_id")
    rows = rows.withColumn("n", F.row_number().over(order)).groupBy(*KEY).agg(
        F.max(F.when(F.col("n") == 1, F.col("value"))).alias("top"), F.round(F.max(F.when(F.col("n") == 1, F.col("confidence"))), 6).alias("s1"), F.round(F.coalesce(F.max(F.when(F.col("n") == 2, F.col("confidence"))), F.lit(0.0)), 6).alias("s2")
    )
    kind = F.when((F.col("s1") >= 0.84) & (F.round(F.col("s1") - F.col("s2"), 6) >= 0.08), "SEMANTIC_MATCH").when(F.col("s1") >= 0.78, "AMBIGUOUS").otherwise("NEW_ENTITY")
    return rows.select(*KEY, "top", kind.alias("resolution"))
