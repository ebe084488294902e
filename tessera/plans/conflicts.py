"""Queries on values that say the same and on the classes of conflicting claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import temporal
from tessera.operators import deltas
from tessera.operators import values as V

from .fixtures import pick, pick_sql, sql_list
from .registry import Registry
from .shared import t

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: Values, each with the number of what it says; None: blank, -1: the same as none.
SAYS = [
    ("太原理工大学是一所历史悠久的综合性大学", 0), ("太原理工大学，是一所历史悠久的综合性大学。", 0), ("the hall was rebuilt in the ninth year of the emperor", 1),
    ("The hall was rebuilt in the ninth year of the Emperors.", 1), ("the hall was rebuilt in the ninth year of an empress", 2), ("open", 3), ("OPEN ", 3), ("closed", 4), ("—", -1), (" ", None),
    ("１９０２年", 5), ("1902年", 5), ("the west gate of the old library and its long garden", 6), ("The old west gate of the library and its long garden", 7),
]
PREDICATES, KINDS, ROLES = ["始建年代", "简介", "空间位置", "周边特色", "毗邻"], ["property", "relation", "fact"], [None, "construction_time", "renovation_time", "other_time", ""]
EVIDENCE, ENTITY = ["supported", "weak", "none", None, "supported"], ["RESOLVED", None, "AMBIGUOUS"]
TEXTS, MEANINGS = [x for x, _ in SAYS], [m for _, m in SAYS]

RAISED = f"""c AS (SELECT l_orderkey * 8 + l_linenumber AS claim, l_partkey AS subject, {pick_sql(PREDICATES, 'l_orderkey % 7')} AS predicate, {pick_sql(KINDS, 'l_partkey')} AS kind, {pick_sql(ROLES, 'l_partkey // 3')} AS role,
        (l_suppkey * 3 + l_orderkey) % {len(SAYS)} AS v, l_suppkey % 9 AS source, l_discount * 10 AS score, {pick_sql(EVIDENCE, 'l_orderkey // 5 + l_suppkey // 40')} AS evidence, l_orderkey % 97 = 0 AS ambiguous, l_orderkey % 89 = 0 AS scope FROM lineitem),
    k AS (SELECT *, {sql_list(TEXTS)}[v + 1] AS value, {str(MEANINGS).replace('None', 'NULL')}[v + 1] AS says FROM c)"""


def raised(spark, sf_dir, *more):
    rows = t(spark, sf_dir, "lineitem")
    o, n, p, s = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    return rows.select(
        (o * 8 + n).alias("claim"), p.alias("subject"), pick(PREDICATES, o % 7).alias("predicate"), pick(KINDS, p).alias("claim_type"), pick(ROLES, F.floor(p / 3)).alias("temporal_role"),
        pick(TEXTS, s * 3 + o).alias("value"), (s % 9).alias("source"), (F.col("l_discount") * 10).alias("score"), pick(EVIDENCE, F.floor(o / 5) + F.floor(s / 40)).alias("evidence_status"),
        F.when(o % 97 == 0, "AMBIGUOUS").alias("entity_status"), (o % 89 == 0).alias("scope_mismatch"), *more,
    )


@register(f"""WITH {RAISED}, g AS (SELECT subject, predicate, count(*) AS candidate_count, count(DISTINCT source) AS source_count, count(DISTINCT says) FILTER (says >= 0) + count(*) FILTER (says = -1) AS distinct_value_count,
        arg_min(claim, (-score, claim)) AS best_claim, max(score) AS best, min(kind) AS kind, min(coalesce(role, '')) AS role, bool_or(ambiguous) AS ambiguous, bool_or(scope) AS scope, count(*) FILTER (evidence = 'supported') AS good, count(*) FILTER (evidence = 'weak') AS weak FROM k GROUP BY ALL),
    x AS (SELECT *, CASE WHEN scope THEN 'scope_mismatch' WHEN ambiguous THEN 'entity_ambiguity' WHEN good + weak = 0 THEN 'unsupported' WHEN good = 0 THEN 'weak_evidence' WHEN distinct_value_count <= 1 THEN 'same_value'
        WHEN kind = 'property' AND role = 'construction_time' THEN 'conflicting' WHEN kind = 'property' AND role <> '' THEN 'compatible' WHEN kind = 'relation' AND predicate = '空间位置' THEN 'conflicting'
        WHEN kind = 'property' AND predicate NOT IN ('简介', '周边特色') THEN 'conflicting' WHEN kind IN ('property', 'relation') THEN 'multi_value' ELSE 'compatible' END AS conflict_class FROM g)
    SELECT subject, predicate, conflict_class, CASE WHEN conflict_class IN ('scope_mismatch', 'entity_ambiguity', 'conflicting') THEN 'conflicted' WHEN conflict_class = 'unsupported' THEN 'weak_evidence' ELSE 'pending_review' END AS gap_status,
        candidate_count, distinct_value_count, source_count, best_claim, round(best::DECIMAL(20,10), 3)::DOUBLE AS recommend_score FROM x""")
def a12_conflict_classes(spark, sf_dir):
    return V.classified_groups(raised(spark, sf_dir), ["subject", "predicate"])


@register(f"""WITH {RAISED} SELECT subject, predicate, arg_min(trim(value), claim) AS value, min(claim) AS "at" FROM k WHERE says >= 0 GROUP BY subject, predicate, says
    UNION ALL SELECT subject, predicate, trim(value), claim FROM k WHERE says = -1""")
def a12_distinct_values(spark, sf_dir):
    # Of rows of one claim the table's first one counts.
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
    return V.distinct_values(raised(spark, sf_dir, *place), ["subject", "predicate"], "value", "claim", ["file", "row"])


@register("""WITH c AS (SELECT p_partkey, ['始建年代', '周边特色', '备注', '空间位置', '毗邻', ' 隶属 '][p_partkey % 6 + 1] AS predicate, [NULL, 'construction_time', 'renovation_time', 'legend_time'][p_size % 4 + 1] AS role FROM part)
    SELECT p_partkey, CASE WHEN coalesce(role IN ('renovation_time', 'legend_time'), false) OR predicate IN ('周边特色', '备注') THEN 'append' ELSE 'exclusive' END AS of_property, CASE WHEN trim(predicate) IN ('空间位置', '隶属') THEN 'single' ELSE 'multi' END AS of_relation FROM c""")
def k12_default_policies(spark, sf_dir):
    predicate = pick(["始建年代", "周边特色", "备注", "空间位置", "毗邻", " 隶属 "], F.col("p_partkey"))
    role = pick([None, "construction_time", "renovation_time", "legend_time"], F.col("p_size"))
    rows = t(spark, sf_dir, "part").select("p_partkey", V.property_policy(predicate, role).alias("p"), V.relation_policy(predicate).alias("r"))
    return rows.select("p_partkey", F.col("p.conflict_policy").alias("of_property"), F.col("r.cardinality").alias("of_relation"))


#: Times as they are told, and what is made of them: text, first and last year, kind, how sure.
TIMES = [
    ("建于1902年。", "1902年", 1902, 1902, "year", "certain"), ("约 1368 - 1644 年", "1368-1644年", 1368, 1644, "year_range", "uncertain"), ("唐朝", "唐代", None, None, "period", "certain"),
    ("相传北宋", "北宋时期", None, None, "period", "uncertain"), ("， 明清（来源：方志）", "明清时期", None, None, "period", "certain"), ("", "", None, None, None, "unknown"),
    ("约", "约", None, None, "period", "uncertain"), ("618至907", "618-907年", 618, 907, "year_range", "certain"), ("民国 ", "民国时期", None, None, "period", "certain"), ("1949", "1949", None, None, "period", "certain"), (None, "", None, None, None, "unknown"),
]


def _column_sql(k: int) -> str:
    items = [x[k] for x in TIMES]
    return sql_list(items) if k in (0, 1, 4, 5) else "[" + ", ".join("NULL" if v is None else str(v) for v in items) + "]"


@register(f"""WITH k AS (SELECT p_partkey, p_partkey % {len(TIMES)} + 1 AS i FROM part) SELECT p_partkey, {_column_sql(1)}[i] AS normalized, {_column_sql(2)}[i] AS time_start, {_column_sql(3)}[i] AS time_end, {_column_sql(4)}[i] AS granularity, {_column_sql(5)}[i] AS certainty FROM k""")
def h14_normalized_times(spark, sf_dir):
    rows = t(spark, sf_dir, "part").select("p_partkey", temporal.normalized(pick([x[0] for x in TIMES], F.col("p_partkey"))).alias("x"))
    return rows.select("p_partkey", "x.*")


#: Claims of line items shipped from 1998 on against those published before: properties by return flag, relations to suppliers.
QUOTES = ["it is so", "Updated in spring", "no longer in use", "改为新馆", None]
STATUSES = ["RESOLVED", "RESOLVED", "RESOLVED", "AMBIGUOUS", "NEW_ENTITY", "RESOLVED", None]
FACT_KINDS, FACT_PREDICATES = ["property", "relation"], ["始建年代", "简介", "空间位置", "毗邻"]
FACTS = f"""f AS (SELECT l_orderkey * 8 + l_linenumber AS claim, {pick_sql(FACT_KINDS, 'l_orderkey')} AS claim_type, l_partkey // 4 AS subject, (l_suppkey % 5)::VARCHAR AS target, {pick_sql(FACT_PREDICATES, 'l_linenumber + l_orderkey // 2')} AS predicate,
        CASE WHEN l_suppkey % 4 = 0 THEN '' WHEN l_suppkey % 4 = 1 THEN ' ' || l_returnflag ELSE lower(l_returnflag) || l_quantity::INT % 3 END AS value, {pick_sql(QUOTES, 'l_suppkey + l_partkey')} AS quote, {pick_sql(STATUSES, 'l_suppkey // 3')} AS ss, CASE WHEN l_partkey % 9 = 0 THEN 'AMBIGUOUS' END AS ts,
        CASE WHEN l_partkey % 6 = 0 THEN 'legend_time' END AS role, l_shipdate < TIMESTAMP '1998-01-01' AS old FROM lineitem)"""


def facts(spark, sf_dir):
    o, n, p, s = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    value = F.when(s % 4 == 0, "").when(s % 4 == 1, F.concat(F.lit(" "), "l_returnflag")).otherwise(F.concat(F.lower("l_returnflag"), (F.col("l_quantity").cast("int") % 3).cast("string")))
    return t(spark, sf_dir, "lineitem").select(
        (o * 8 + n).alias("claim"), pick(FACT_KINDS, o).alias("claim_type"), F.floor(p / 4).alias("subject"), (s % 5).cast("string").alias("target"), pick(FACT_PREDICATES, n + F.floor(o / 2)).alias("predicate"), value.alias("value"),
        pick(QUOTES, s + p).alias("quote"), pick(STATUSES, F.floor(s / 3)).alias("subject_status"), F.when(p % 9 == 0, "AMBIGUOUS").alias("target_status"), F.when(p % 6 == 0, "legend_time").alias("temporal_role"), (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).alias("old"),
    )


@register(f"""WITH {FACTS}, pv AS (SELECT DISTINCT subject, predicate, lower(trim(value)) AS v FROM f WHERE old AND claim_type = 'property' AND trim(value) <> ''), pe AS (SELECT DISTINCT subject, predicate, target FROM f WHERE old AND claim_type = 'relation'),
    c AS (SELECT *, lower(trim(value)) AS v, coalesce(lower(quote), '') AS q FROM f WHERE NOT old),
    x AS (SELECT c.*, EXISTS (SELECT 1 FROM pv WHERE pv.subject = c.subject AND pv.predicate = c.predicate AND pv.v = c.v) AS same, EXISTS (SELECT 1 FROM pv WHERE pv.subject = c.subject AND pv.predicate = c.predicate) AS has,
        EXISTS (SELECT 1 FROM pe WHERE pe.subject = c.subject AND pe.predicate = c.predicate AND pe.target = c.target) AS edge, EXISTS (SELECT 1 FROM pe WHERE pe.subject = c.subject AND pe.predicate = c.predicate) AS edges, q IN ('updated in spring', '改为新馆') AS upd, q = 'no longer in use' AS dep FROM c)
    SELECT claim, CASE WHEN coalesce(ss = 'AMBIGUOUS', false) OR ts IS NOT NULL THEN 'CONFLICT' WHEN coalesce(ss = 'NEW_ENTITY', false) THEN 'MINT_ADD'
        WHEN claim_type = 'property' THEN CASE WHEN same THEN 'EXISTS' WHEN NOT has THEN 'ADD' WHEN dep THEN 'DEPRECATE' WHEN upd OR dep THEN 'UPDATE' WHEN role IS NOT NULL OR predicate = '简介' THEN 'ADD' ELSE 'CONFLICT' END
        ELSE CASE WHEN edge THEN 'EXISTS' WHEN NOT edges OR predicate <> '空间位置' THEN 'ADD' WHEN upd OR contains(q, 'now') THEN 'UPDATE' ELSE 'CONFLICT' END END AS operation FROM x""")
def k6_deltas_in_full(spark, sf_dir):
    rows = facts(spark, sf_dir)
    old = rows.where("old")
    properties = old.where("claim_type = 'property'").select("subject", "predicate", "value")
    relations = old.where("claim_type = 'relation'").select("subject", "predicate", "target")
    return deltas.knowledge_deltas(rows.where("NOT old").drop("old"), properties, relations).select("claim", "operation")


CLASSES = ["same_value", "weak_evidence", "unsupported", "entity_ambiguity", "conflicting", "scope_mismatch", "multi_value", None]


@register(f"""WITH {FACTS}, g AS (SELECT f.*, l_discount * 10 AS authority, l_tax * 10 AS relevance, {pick_sql(CLASSES, 'l_orderkey // 8')} AS kind, l_suppkey AS source, l_orderkey % 7 = 0 AS dup FROM f JOIN (SELECT *, l_orderkey * 8 + l_linenumber AS id FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1) ON id = claim),
    n AS (SELECT subject, predicate, lower(trim(value)) AS v, count(DISTINCT source) AS sources FROM g GROUP BY ALL),
    p AS (SELECT g.*, sources, CASE WHEN kind IN ('conflicting', 'scope_mismatch', 'entity_ambiguity') THEN 0.15 WHEN dup THEN 1.0 WHEN coalesce(kind, 'unsupported') IN ('weak_evidence', 'unsupported') THEN 0.45 ELSE 0.85 END AS fits,
        CASE coalesce(kind, 'unsupported') WHEN 'weak_evidence' THEN 0.12 WHEN 'unsupported' THEN 0.35 WHEN 'entity_ambiguity' THEN 0.25 WHEN 'conflicting' THEN 0.3 WHEN 'scope_mismatch' THEN 0.35 ELSE 0 END AS penalty FROM g JOIN n ON n.subject = g.subject AND n.predicate = g.predicate AND n.v = lower(trim(g.value)))
    SELECT claim, sources, round(least(1, greatest(0, 0.25 * authority + 0.2 * relevance + 0.2 * 0.5 + 0.15 * least(1, sources / 3) + 0.1 * fits + 0.1 * least(1, authority) - penalty))::DECIMAL(20,10), 3)::DOUBLE AS recommend_score FROM p""")
def a10_recommendation_in_full(spark, sf_dir):
    rows = facts(spark, sf_dir).drop("old")
    more = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("claim"), (F.col("l_discount") * 10).alias("source_authority"), (F.col("l_tax") * 10).alias("retrieval_relevance"), F.col("l_suppkey").alias("source"), pick(CLASSES, F.floor(F.col("l_orderkey") / 8)).alias("conflict_class"), F.when(F.col("l_orderkey") % 7 == 0, "duplicate").alias("status"))
    once = more.groupBy("claim").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("claim")
    rows = rows.join(once, "claim", "left_semi").join(more, "claim").withColumns({"evidence_support": F.lit(0.5), "model_confidence": F.col("source_authority")})
    return deltas.recommended(rows, ["subject", "predicate"]).select("claim", "sources", "recommend_score")
