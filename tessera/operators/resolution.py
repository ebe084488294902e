"""Which entity a mention names: types, exact and alias names, vector recall with a margin, and scores of the outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scoring, texts

# Names of types, the most general types, and words that tell a type.
TYPES = {
    "poi": "poi", "景点": "poi", "地点": "poi", "region": "region", "区域": "region", "地区": "region", "organization": "organization", "机构": "organization",
    "学校": "organization", "person": "person", "人物": "person", "building": "building", "建筑": "building", "facility": "facility", "设施": "facility",
    "event": "event", "事件": "event", "route": "route", "路线": "route", "program": "program", "项目": "program", "concept": "concept", "概念": "concept",
    "time_literal": "time_literal", "时间": "time_literal",
}
# The names of an entity's own type; those of no type become blank.
ENTITY_TYPES = {
    "poi": "poi", "place": "poi", "地点": "poi", "场所": "poi", "building": "building", "建筑": "building", "region": "region", "location": "region", "区域": "region",
    "person": "person", "人物": "person", "object": "object", "物品": "object", "文物": "object", "artifact": "object", "facility": "facility", "设施": "facility",
    "organization": "organization", "organisation": "organization", "机构": "organization", "school": "organization", "大学": "organization", "event": "event", "事件": "event",
    "route": "route", "路线": "route", "concept": "concept", "概念": "concept", "program": "program", "项目": "program", "scenicarea": "scenicarea", "景区": "scenicarea",
    "entity": "", "unresolved": "", "unknown": "",
}
LONGEST_TYPE = 64
GENERIC = ("", "poi", "entity", "unresolved", "unknown", "thing", "object")
ORGANISATION_ENDS = ("大学", "学院", "研究院", "研究所", "实验室", "办公室", "委员会", "集团", "公司", "基金会", "协会", "部门", "处", "中心", "机构")
BUILDING_ENDS = ("楼", "馆", "庙", "塔", "殿", "寺")
ORGANISATION_PREDICATES = ("所属机构", "隶属机构", "parent_organization", "合并组成单位", "merged_with", "前身", "predecessor")
PERSON_PREDICATES = ("建造者", "设计者", "相关人物", "notable_person", "人物")
#: Least score and margin of a match, least score of an ambiguous one.
MATCH, MARGIN, AMBIGUOUS = 0.84, 0.08, 0.78
#: How sure each outcome is.
CERTAINTY = {"EXACT": 1.0, "ALIAS_MATCH": 0.95, "SEMANTIC_MATCH": 0.82, "NEW_ENTITY": 0.45, "AMBIGUOUS": 0.25}
UNKNOWN_CERTAINTY = 0.35
#: The deterministic part of a joint score by recall decision.
DECISION = {"AUTO_EXACT_RECALL": 1.0, "AUTO_ALIAS_RECALL": 0.85, "REVIEW_REQUIRED": 0.35}


def looked_up(key: Column, table: dict[str, float] | dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _coded(value: Column) -> Column:
    """A type in compatibility form and folded case; of ``code=label`` the code, where it is one of a domain."""
    raw = texts.folded(value)
    code = F.trim(F.substring_index(raw, "=", 1))
    return F.when(raw.contains("=") & (code.startswith("type_") | code.startswith("domain_") | (code == "ce5")), code).otherwise(raw)


def type_code(value: Column) -> Column:
    """A type's code for comparing types, from a code, a name or ``code=label``; types without a code of their own stay."""
    return F.coalesce(looked_up(_coded(value), TYPES), _coded(value))


def entity_type(value: Column) -> Column:
    """The type of an entity, by names of its own; those that tell nothing are blank, unknown ones are cut to LONGEST_TYPE."""
    return F.coalesce(looked_up(_coded(value), ENTITY_TYPES), F.substring(_coded(value), 1, LONGEST_TYPE))


def type_compatible(wanted: Column, node_type: Column, label: Column) -> Column:
    """Whether types agree by code or label; a blank type agrees with any."""
    a, b, c = type_code(wanted), type_code(node_type), type_code(label)
    return (a == "") | (b == "") | (a == b) | ((c != "") & (a == c))


def inferred_type(raw_type: Column, predicate: Column, mention: Column) -> Column:
    """(type, confidence, method): an explicit type as it is, a general one by its predicate or the mention's ending."""
    raw, name = entity_type(raw_type), texts.compatible(mention)
    ends = lambda words: name.rlike(f"(?:{'|'.join(words)})$")
    row = lambda kind, sure, method: F.struct((kind if isinstance(kind, Column) else F.lit(kind)).alias("kind"), F.lit(sure).alias("confidence"), F.lit(method).alias("method"))
    p = texts.compatible(predicate)
    return (
        F.when(~raw.isin(*GENERIC), row(raw, 0.9, "EXPLICIT_TYPE")).when(p.isin(*ORGANISATION_PREDICATES) | ends(ORGANISATION_ENDS), row("organization", 0.86, "DETERMINISTIC_ORGANIZATION_CUE"))
        .when(p.isin(*PERSON_PREDICATES), row("person", 0.82, "DETERMINISTIC_PERSON_PREDICATE")).when(ends(BUILDING_ENDS), row("building", 0.72, "DETERMINISTIC_BUILDING_SUFFIX"))
        .otherwise(row(raw, 0.0, "UNRESOLVED_GENERIC_TYPE"))
    )


def canonical_predicate(predicate: Column, temporal_role: Column, aliases: DataFrame | None = None, temporal: tuple[str, ...] = ()) -> Column:
    """``alias`` (a joined column of that name, or null) for a predicate, unless the claim's role is one of time."""
    p = F.trim(F.coalesce(predicate, F.lit("")))
    return F.when(temporal_role.isin(*temporal), F.when(p == "", "时间").otherwise(p)).otherwise(F.coalesce("alias", p))


def name_recall(mentions: DataFrame, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(mention, decision, node, candidates): nodes (node, name) whose name a mention (mention, name) has, or else those with
    an alias (node, name) of it.  One alone is taken, several are left to a review."""
    key = lambda d: d.withColumn("key", texts.name_key(F.col("name")))
    found = lambda d: key(d).where("key <> ''").groupBy("key").agg(F.countDistinct("node").alias("n"), F.min("node").alias("node"))
    rows = key(mentions).join(found(nodes).withColumnRenamed("n", "exact").withColumnRenamed("node", "exact_node"), "key", "left")
    rows = rows.join(found(aliases).withColumnRenamed("n", "alias").withColumnRenamed("node", "alias_node"), "key", "left")
    n, exact = F.coalesce("exact", "alias", F.lit(0)), F.col("exact").isNotNull()
    decision = F.when((n == 1) & exact, "AUTO_EXACT_RECALL").when(n == 1, "AUTO_ALIAS_RECALL").when(n > 1, "REVIEW_REQUIRED").otherwise("NO_GRAPH_MATCH")
    return rows.select("mention", decision.alias("decision"), F.when(n == 1, F.coalesce("exact_node", "alias_node")).alias("node"), n.alias("candidates"))


def resolved(recall: DataFrame, ranked: DataFrame) -> DataFrame:
    """(mention, status, node, top1, top2, margin): a name alone decides; else the best of the vector candidates ``ranked``
    (mention, node, score) where it is good and far enough from the second one, an ambiguous outcome where it is only good,
    and a new entity where it is not."""
    place = F.row_number().over(W.partitionBy("mention").orderBy(F.desc("score"), "node"))
    top = ranked.withColumn("k", place).where("k <= 2").groupBy("mention").agg(
        F.max(F.when(F.col("k") == 1, F.col("node"))).alias("best"), F.max(F.when(F.col("k") == 1, F.col("score"))).alias("top1"), F.max(F.when(F.col("k") == 2, F.col("score"))).alias("top2")
    )
    rows = recall.join(top, "mention", "left").withColumn("margin", scoring.rounded(F.col("top1") - F.coalesce("top2", F.lit(0.0)), 6))
    status = (
        F.when(F.col("decision") == "AUTO_EXACT_RECALL", "EXACT").when(F.col("decision") == "AUTO_ALIAS_RECALL", "ALIAS_MATCH").when(F.col("decision") == "REVIEW_REQUIRED", "AMBIGUOUS")
        .when((F.col("top1") >= MATCH) & (F.col("margin") >= MARGIN), "SEMANTIC_MATCH").when(F.col("top1") >= AMBIGUOUS, "AMBIGUOUS").otherwise("NEW_ENTITY")
    )
    by_vector = F.col("decision") == "NO_GRAPH_MATCH"
    rows = rows.withColumn("status", status)
    node = F.when(F.col("status") == "SEMANTIC_MATCH", F.col("best")).otherwise(F.col("node"))
    return rows.select("mention", "status", node.alias("node"), *[F.when(by_vector, F.col(c)).alias(c) for c in ("top1", "top2", "margin")])


def certainty(status: Column, top1: Column, margin: Column) -> Column:
    """How sure an outcome is; that of a vector match depends on its score and margin too."""
    base = F.coalesce(looked_up(F.upper(F.coalesce(status, F.lit(""))), CERTAINTY), F.lit(UNKNOWN_CERTAINTY))
    blend = 0.6 * base + 0.3 * scoring.clamp(top1) + 0.1 * scoring.clamp(F.coalesce(margin, F.lit(0.0)) / 0.2)
    return scoring.clamp(F.when((F.upper(status) == "SEMANTIC_MATCH") & top1.isNotNull(), blend).otherwise(base))


def context_score(subject: Column, subject_parent: Column, target: Column, target_parent: Column) -> Column:
    """1 for a parent or child, 0.55 for a sibling, 0.25 for any other target, 0 for none; a null parent is none."""
    none = F.lit(False)
    return (
        F.when(target.isNull(), 0.0).when(F.coalesce(subject_parent == target, none) | F.coalesce(target_parent == subject, none), 1.0)
        .when(F.coalesce(subject_parent == target_parent, none), 0.55).otherwise(0.25)
    )


def joint_score(decision: Column, evidence: Column, context: Column, distance: Column) -> Column:
    """0.45 of the recall decision's score, 0.2 of the evidence, 0.2 of the context and 0.15 of the nearest vector (a null
    distance: there is none)."""
    by_name = F.coalesce(looked_up(decision, DECISION), F.lit(0.0))
    vector = F.when(distance.isNull(), 0.0).otherwise(1 / (1 + F.greatest(F.lit(0.0), distance)))
    return scoring.rounded(0.45 * by_name + 0.20 * scoring.clamp(F.coalesce(evidence, F.lit(0.0))) + 0.20 * context + 0.15 * vector, 3)


def review_decision(decision: Column, score: Column, distance: Column) -> Column:
    sure = decision.isin("AUTO_EXACT_RECALL", "AUTO_ALIAS_RECALL") & (score >= 0.7)
    return F.when(sure, "REVIEW_READY_DETERMINISTIC").when(distance.isNotNull() & (score >= 0.45), "REVIEW_REQUIRED_VECTOR_SUPPORT").otherwise("REVIEW_REQUIRED")


def reranked(score: Column, rerank: Column, child_of_context: Column) -> Column:
    """A vector score with a reranker's; without one it stays, with 0.04 more for a child of the context in either case."""
    bonus = F.when(F.coalesce(child_of_context, F.lit(False)), 0.04).otherwise(0.0)
    return scoring.rounded(F.when(rerank.isNull(), score + bonus).otherwise(0.65 * score + 0.25 * rerank + bonus), 6)
