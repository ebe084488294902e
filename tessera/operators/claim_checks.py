"""Checks of extracted claims on their own words: lanes, malformed predicates, grounding, trust, and where results go.

Cue words are those of the texts that the claims come from (Chinese); they are looked for as parts of a predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring, texts

from . import claims

# Cue words, and values that say yes or no.
ACTION = ("落实", "推动", "开展", "实施", "坚持", "承担", "服务", "形成", "完成")
GOAL = ("目标", "建设", "建成", "打造", "发展", "提升", "愿景", "规划")
POLICY = ("政策", "方针", "战略", "方案", "意见", "规定")
EVENT = ("始建", "建于", "成立", "建成", "重修", "维修", "发生", "举办")
YES_NO = ("是", "否", "true", "false", "True", "False")
CLAUSE = (
    "锚定", "落实", "推动", "打造", "建成", "构建", "营造", "承担", "获得", "努力", "矢志", "做出", "服务", "坚持", "开展", "形成",
    "入选", "存在", "达到", "突破", "培养", "建设",
)
MEASURE = r"[0-9]|年|月|日|亿元|万元|平方米|公里|项|人|号|次|%"
QUOTES = "[“”\"‘’]"
#: Conflict risk by operation, of ambiguous claims and of images alone.
OPERATION_RISK = {"CONFLICT": 1.0, "UPDATE": 0.55, "DEPRECATE": 0.55}
AMBIGUOUS_RISK, IMAGE_RISK = 0.75, 0.35
#: Weights of a binding's components.
WEIGHTS = {"quality": 0.20, "relevance": 0.10, "coverage": 0.15, "locality": 0.10, "entailment": 0.25, "confidence": 0.10, "resolution": 0.10}
#: Statuses that no policy changes any more.
TERMINAL = ("DUPLICATE", "ADOPTED", "PUBLISHED", "REJECTED", "INVALIDATED")


def has_any(text: Column, cues: tuple[str, ...]) -> Column:
    return text.rlike("|".join(cues))


def text_of(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def lane(claim_type: Column, predicate: Column, value: Column, yes_no_property: Column) -> Column:
    """RELATION, PROPERTY or BACKGROUND.  A property whose value only says yes or no is background where its predicate is
    an action, a goal or a policy, or is a long one that neither the schema nor its first word makes a question."""
    kind, p, v = F.upper(text_of(claim_type)), text_of(predicate), text_of(value)
    asked = F.coalesce(yes_no_property, F.lit(False)) | p.startswith("是否") | p.startswith("有无")
    background = v.isin(*YES_NO) & (has_any(p, ACTION + GOAL + POLICY) | ~(asked | (F.length(p) <= 12)))
    return F.when(kind == "RELATION", "RELATION").when(~kind.isin("PROPERTY", "") | background, "BACKGROUND").otherwise("PROPERTY")


def background_role(predicate: Column, raw_text: Column) -> Column:
    text = F.concat_ws(" ", text_of(predicate), F.coalesce(raw_text, F.lit("")))
    return F.when(has_any(text, GOAL), "GOAL").when(has_any(text, POLICY), "POLICY").when(has_any(text, EVENT), "EVENT").when(has_any(text, ACTION), "ACTION").otherwise("OTHER")


def malformed(claim_type: Column, predicate: Column, value: Column) -> Column:
    """Why a claim is a clause and no property; null if it is none.  A yes or no to a quoted, long or clause-like predicate
    is malformed, and so is a property with a clause for its predicate that repeats its value or measures nothing."""
    p, v = text_of(predicate), text_of(value)
    clause = has_any(p, CLAUSE)
    own = (v == p) | ((F.length(v) >= 4) & F.contains(p, v) & (F.length(p) > F.length(v) + 1))
    plain = F.when((claim_type == "property") & clause & own, "CLAUSE_AS_PROPERTY_SELF_VALUE").when((claim_type == "property") & clause & ~v.rlike(MEASURE), "ACTION_CLAUSE_AS_PROPERTY")
    yes_no = F.when(p.startswith("是否") | p.startswith("有无"), F.lit(None)).when(p.rlike(QUOTES), "MALFORMED_PREDICATE_BOOLEAN_VALUE").when(clause | (F.length(p) > 12), "CLAUSE_AS_PREDICATE_BOOLEAN_VALUE")
    return F.when(v.isin("是", "否"), yes_no).otherwise(plain)


def surface_reason(content: Column, quote: Column, value: Column, predicate: Column) -> Column:
    """Why a claim isn't anchored in its evidence's words; null if it is.  Only a predicate that looks like a name of a schema
    must be there."""
    held = texts.compact(F.concat_ws(" ", F.coalesce(content, F.lit("")), F.coalesce(quote, F.lit(""))))
    absent = lambda x: ~F.contains(held, texts.compact(x))
    p = text_of(predicate)
    return (
        F.when((text_of(quote) == "") | absent(quote), "quote_not_in_evidence").when((text_of(value) != "") & absent(value), "raw_value_not_in_evidence")
        .when(p.rlike("^[A-Za-z][A-Za-z0-9_ .-]*$") & absent(p), "internal_schema_predicate_not_in_evidence")
    )


def quote_coverage(content: Column, quote: Column) -> Column:
    """1 for a quote that is in its evidence, 0.45 for one that isn't, 0 for none."""
    q = F.coalesce(quote, F.lit(""))
    return F.when(q == "", 0.0).when(F.contains(F.coalesce(content, F.lit("")), q), 1.0).otherwise(0.45)


def conflict_risk(operation: Column, statuses: list[Column], image_only: Column) -> Column:
    ambiguous = F.lit(False)
    for s in statuses:
        ambiguous = ambiguous | (F.upper(F.coalesce(s, F.lit(""))) == "AMBIGUOUS")
    risk = F.when(operation == "CONFLICT", 1.0).when(ambiguous, AMBIGUOUS_RISK).when(operation.isin(*OPERATION_RISK), OPERATION_RISK["UPDATE"]).otherwise(0.0)
    return F.when(image_only, F.greatest(risk, F.lit(IMAGE_RISK))).otherwise(risk)


def trust_components(bindings: DataFrame, claim: str) -> DataFrame:
    """Per claim: the parts of its trust score and the score.

    ``bindings`` has one row per piece of evidence: the claim and its subject, predicate, value, subject_score, target_score
    (null: no target), operation, ambiguous, image_only; the evidence's family, kind, content, quote, retrieval (0 to 5),
    located, authority (null: 0.5), entailment (null: by words), confidence.  Evidence of one family counts once."""
    resolution = F.least("subject_score", F.coalesce("target_score", "subject_score"))
    by_words = scoring.entailment(texts.compact(F.col("content")), *(texts.compact(F.col(c)) for c in ("subject", "predicate", "value")))
    rows = bindings.withColumns({
        "quality": F.coalesce("authority", F.lit(0.5)), "relevance": F.least(F.lit(1.0), F.col("retrieval") / 5), "coverage": quote_coverage(F.col("content"), F.col("quote")),
        "locality": F.when(F.col("located"), 1.0).otherwise(0.65), "entailment": F.coalesce("entailment", by_words), "resolution": resolution,
    })
    rows = rows.withColumn("binding", scoring.weighted_mean(WEIGHTS, 4))
    fusion = claims.fused(rows, [claim], "family", "kind", "binding").select(claim, F.col("evidence"), "families", "support", "cross_source")
    risk = conflict_risk(F.col("operation"), [F.when(F.col("ambiguous"), "AMBIGUOUS")], F.col("image_only"))
    own = rows.groupBy(claim).agg(
        F.max(scoring.clamp(F.col("quality"))).alias("quality"), F.max("confidence").alias("confidence"), F.min("resolution").alias("resolution"), F.max(risk).alias("risk")
    )
    out = fusion.join(own, claim)
    four = {c: scoring.rounded(F.col(c), 4) for c in ("support", "cross_source", "quality", "confidence", "resolution", "risk")}
    return out.withColumns(four).withColumn("trust", scoring.trust(F.col("support"), F.col("resolution"), F.col("quality"), F.col("cross_source"), F.col("risk")))


def candidate_type(claim_type: Column, predicate: Column, properties: Column, relations: Column) -> Column:
    """Whether a claim fills a template (arrays of its names) or is a discovery."""
    p = text_of(predicate)
    known = lambda names, kind: F.when(F.coalesce(F.array_contains(names, p), F.lit(False)), f"template_{kind}").otherwise(f"discovered_{kind}")
    return F.when(claim_type == "property", known(properties, "property")).when(claim_type == "relation", known(relations, "relation")).when(claim_type == "entity", "discovered_entity").otherwise("discovered_fact")


def candidate_status(status: Column, forced_conflict: Column) -> Column:
    s = F.coalesce(status, F.lit(""))
    return (
        F.when(forced_conflict | (s == "conflict_candidate"), "CONFLICT").when(s == "duplicate", "DUPLICATE").when(s == "low_evidence", "LOW_EVIDENCE")
        .when(s.isin("adoptable", "needs_review", ""), "PENDING").otherwise(F.upper(s))
    )


def image_only_policy(candidates: DataFrame, image_only: Column) -> DataFrame:
    """Candidates (status, evidence_status, risk_level, policy) after the policy for evidence from images alone: only
    supported ones keep their status, risk is MEDIUM at least (HIGH without support), and a person decides.  Terminal rows
    stay as they are; ``touched`` tells them apart."""
    open_ = image_only & ~F.upper(F.coalesce("status", F.lit("PENDING"))).isin(*TERMINAL)
    supported = F.lower(F.coalesce("evidence_status", F.lit(""))) == "supported"
    risk = F.when(~supported | (F.upper(F.coalesce("risk_level", F.lit(""))) == "HIGH"), "HIGH").otherwise("MEDIUM")
    new = {"status": F.when(supported, F.col("status")).otherwise("LOW_EVIDENCE"), "risk_level": risk, "policy": F.lit("MANUAL_REVIEW")}
    return candidates.withColumns({"touched": open_} | {c: F.when(open_, x).otherwise(F.col(c)) for c, x in new.items()})


def node_payloads(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(node, image_only, evidence): per node, the chunks (chunk, content, asset_type, ocr_score) that mention it (node, chunk)
    as one payload, each with a score: 0.9 for text, for an image that of its letters (0.55 if unknown), 0.75 at most.
    Chunks without content are left out, and so are nodes that have no others."""
    image = F.col("asset_type") == "image"
    score = F.when(image, F.least(F.lit(0.75), F.greatest(F.lit(0.0), F.coalesce(F.nullif(F.col("ocr_score"), F.lit(0.0)), F.lit(0.55))))).otherwise(0.9)
    rows = mentions.select("node", "chunk").distinct().join(chunks.where(text_of(F.col("content")) != ""), "chunk")
    item = F.struct("chunk", F.when(image, "image_asset").otherwise("domain_kb").alias("source_type"), score.alias("score"), F.substring("content", 1, 500).alias("quote"))
    return rows.groupBy("node").agg(F.bool_and(F.coalesce(image, F.lit(False))).alias("image_only"), F.sort_array(F.collect_list(item)).alias("evidence"))


def result_bucket(claim_type: Column, status: Column, open_scope: Column, conflicted: Column, source_url: Column, evidence_status: Column) -> Column:
    """Where a claim goes: into the template, the discoveries, the facts or the unverified ones; null: nowhere."""
    dropped = F.coalesce(status, F.lit("")).isin("duplicate", "low_evidence") & (claim_type != "fact")
    where = lambda kind: F.when(open_scope, f"discovered_{kind}").otherwise(f"template_{kind}")
    fact = F.when((text_of(source_url) != "") & F.coalesce(evidence_status.isin("supported", "weak"), F.lit(False)), "facts").otherwise("unverified_facts")
    return (
        F.when(dropped | conflicted & (claim_type != "fact"), F.lit(None)).when(claim_type == "property", where("properties"))
        .when(claim_type == "relation", where("relations")).when(claim_type == "fact", fact)
    )


def discovered_entities(relations: DataFrame, order: str) -> DataFrame:
    """(name, node_type, relation, claim): the targets of discovered relations (name, node_type, relation), each once."""
    key = [text_of(F.col(c)) for c in ("name", "node_type", "relation")]
    rows = relations.where(key[0] != "").groupBy(*(k.alias(c) for k, c in zip(key, ("name", "node_type", "relation"), strict=True)))
    return rows.agg(F.min(order).alias("claim")).withColumn("node_type", F.when(F.col("node_type") == "", "unresolved").otherwise(F.col("node_type")))
