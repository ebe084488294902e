"""What new claims change in what is published, and how far they are recommended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring

from . import values
from .claims import DEPRECATE_CUES, UPDATE_CUES

# Weights of a recommendation, how a claim fits the graph, penalties by class, sources that are enough.
WEIGHTS = {"source_authority": 0.25, "retrieval_relevance": 0.20, "evidence_support": 0.20, "multi_source_support": 0.15, "graph_consistency": 0.10, "model_confidence": 0.10}
IN_CONFLICT, DUPLICATE, POOR, FITS = 0.15, 1.0, 0.45, 0.85
PENALTIES = {"weak_evidence": 0.12, "unsupported": 0.35, "entity_ambiguity": 0.25, "conflicting": 0.30, "scope_mismatch": 0.35}
ENOUGH = 3


def _told(quote: Column, cues: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, cues)), lambda c: F.contains(F.lower(F.coalesce(quote, F.lit(""))), c))


def knowledge_deltas(claims: DataFrame, properties: DataFrame, relations: DataFrame) -> DataFrame:
    """``claims`` (claim_type, subject, subject_status, target, target_status, predicate, temporal_role, value, quote) with operation
    and reason, against published ``properties`` (subject, predicate, value) and ``relations`` (subject, predicate, target).

    What is ambiguous conflicts and what needs a new entity is minted.  A known value or target exists; a predicate without
    any takes it.  Otherwise words of withdrawal (of a property) or of change in the quote tell, then whether the predicate
    takes several.  Values are compared without white space at their ends and in lower case.

    The published facts of a claim's predicate are looked up as a flag and a match, so no list of them is made."""
    value = F.lower(F.trim(F.coalesce("value", F.lit(""))))
    rows = claims.withColumns({"_value": value, "_prop": F.col("claim_type") == "property"})
    known = properties.where(F.trim("value") != "").select("subject", "predicate", F.lower(F.trim("value")).alias("_value")).distinct().withColumn("_same", F.lit(True))
    any_ = known.select("subject", "predicate").distinct().withColumn("_some", F.lit(True))
    edges = relations.select("subject", "predicate", "target").distinct().withColumn("_edge", F.lit(True))
    any_edge = edges.select("subject", "predicate").distinct().withColumn("_edges", F.lit(True))
    key = ["subject", "predicate"]
    rows = rows.join(known, [*key, "_value"], "left").join(any_, key, "left").join(edges, [*key, "target"], "left").join(any_edge, key, "left")
    is_ = lambda c: F.coalesce(F.col(c), F.lit(False))
    either = lambda s: F.coalesce(F.col("subject_status") == s, F.lit(False)) | F.coalesce(F.col("target_status") == s, F.lit(False))
    row = lambda op, reason: F.struct(F.lit(op).alias("operation"), F.lit(reason).alias("reason"))
    withdrawn, changed = _told(F.col("quote"), DEPRECATE_CUES), _told(F.col("quote"), UPDATE_CUES)
    one_value = values.property_policy(F.col("predicate"), F.col("temporal_role"))["conflict_policy"] == "exclusive"
    one_target = values.relation_policy(F.col("predicate"))["conflict_policy"] == "exclusive"
    of_property = (
        F.when(is_("_same") & (F.col("_value") != ""), row("EXISTS", "published_property_same_value")).when(~is_("_some"), row("ADD", "new_property_for_existing_entity"))
        .when(withdrawn, row("DEPRECATE", "evidence_explicitly_deprecates_existing_fact")).when(changed, row("UPDATE", "evidence_explicitly_replaces_existing_value"))
        .when(~one_value, row("ADD", "multi_value_property_can_coexist")).otherwise(row("CONFLICT", "exclusive_property_has_different_value"))
    )
    of_relation = (
        F.when(is_("_edge"), row("EXISTS", "published_relation_same_target")).when(~is_("_edges"), row("ADD", "new_relation_for_existing_entity"))
        .when(~F.coalesce(one_target, F.lit(False)), row("ADD", "coexistable_relation_target")).when(changed, row("UPDATE", "evidence_explicitly_replaces_relation_target"))
        .otherwise(row("CONFLICT", "exclusive_relation_has_different_target"))
    )
    out = F.when(either("AMBIGUOUS"), row("CONFLICT", "entity_resolution_ambiguous")).when(either("NEW_ENTITY"), row("MINT_ADD", "new_entity_required"))
    rows = rows.withColumn("_d", out.when(is_("_prop"), of_property).otherwise(of_relation))
    return rows.select(*claims.columns, "_d.operation", "_d.reason")


def recommended(claims: DataFrame, group: list[str]) -> DataFrame:
    """``claims`` (group, value, source, conflict_class, status, source_authority, retrieval_relevance, evidence_support,
    model_confidence) with ``sources``, the number of sources of its value in the group, and ``recommend_score``: six parts by
    WEIGHTS less the penalty of the class, between 0 and 1.

    Sources are counted after equal (group, value, source) rows have become one, so a value that many claims of one source
    say weighs nothing in the shuffle."""
    rows = claims.withColumn("_value", F.lower(F.trim(F.coalesce("value", F.lit("")))))
    told = rows.where(F.coalesce(F.trim(F.col("source").cast("string")), F.lit("")) != "").select(*group, "_value", "source").distinct()
    sources = told.groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("sources"))
    rows = rows.join(sources, [*group, "_value"], "left").withColumn("sources", F.coalesce("sources", F.lit(0)))
    kind, zero = F.coalesce("conflict_class", F.lit("unsupported")), F.lit(0.0)
    fits = (
        F.when(kind.isin("conflicting", "scope_mismatch", "entity_ambiguity"), IN_CONFLICT).when(F.coalesce(F.col("status") == "duplicate", F.lit(False)), DUPLICATE)
        .when(kind.isin("weak_evidence", "unsupported"), POOR).otherwise(FITS)
    )
    parts = {c: F.coalesce(F.col(c), zero) for c in ("source_authority", "retrieval_relevance", "evidence_support")}
    parts |= {"multi_source_support": F.least(F.lit(1.0), F.col("sources") / ENOUGH), "graph_consistency": fits, "model_confidence": scoring.clamp(F.coalesce("model_confidence", zero))}
    total = sum((w * parts[n] for n, w in WEIGHTS.items()), zero)
    penalty = F.coalesce(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv])[kind], zero)
    return rows.withColumn("recommend_score", scoring.rounded(scoring.clamp(total - penalty), 3)).drop("_value")
