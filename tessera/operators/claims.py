"""Claims about a subject: fusion of evidence, conflicts, risk, deltas against what is published, and the review queue.

A claim row has subject, predicate, value, source and confidence; a group is a subject and predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import scoring, texts

#: Penalties by conflict class.
PENALTY = {"multi_value": 0.12, "exclusive": 0.35, "temporal": 0.25, "weak": 0.30, "unsupported": 0.35}
#: Status classes in the review queue, best first.
STATUS_CLASS = {"ADOPTED": 0, "PUBLISHED": 0, "PENDING": 1, "REJECTED": 2}
#: Our own cue words of an update and of a withdrawal.
UPDATE_CUES, DEPRECATE_CUES = ["updated", "changed to", "now", "改为", "更新"], ["closed", "removed", "no longer", "废止", "撤销"]


def fused(bindings: DataFrame, claim: list[str], family: str, kind: str, score: str) -> DataFrame:
    """Per claim: the best score of each source family, these combined as independent (1 - product of 1 - s), and how far
    sources agree (a third for each family up to three, 0.1 more for several kinds of sources, 1 at most)."""
    best = bindings.groupBy(*claim, family).agg(F.max(scoring.clamp(F.col(score))).alias("s"), F.count(F.lit(1)).alias("n"))
    kinds = bindings.groupBy(*claim).agg(F.countDistinct(kind).alias("kinds"))
    out = best.groupBy(*claim).agg((1 - F.product(1 - F.col("s"))).alias("support"), F.count(F.lit(1)).alias("families"), F.sum("n").alias("evidence"))
    cross = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("families") / 3) + F.when(F.col("kinds") > 1, 0.1).otherwise(0.0))
    return out.join(kinds, claim).withColumn("cross_source", cross)


def distinct_counts(rows: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """(group, n_<column>...): rows that have the number of different values of one column each, and null for the others; groups
    without a value have no row.

    Each column is counted on its own, so that no row is repeated for the others."""
    out = None
    for c in columns:
        n = rows.where(F.col(c).isNotNull()).select(*group, c).distinct().groupBy(*group).agg(F.count(F.lit(1)).alias(f"n_{c}"))
        out = n if out is None else out.unionByName(n, allowMissingColumns=True)
    return out


def classified(rows: DataFrame, group: list[str], single_valued: Column, temporal: Column) -> DataFrame:
    """Per group: numbers of values and sources, the best claim's value, and the class, of which the first that fits
    holds: unsupported, weak, same_value, temporal, exclusive, multi_value."""
    # All but the sources follows from one row for each value; both counts of different ones together would make three rows of each.
    values = rows.groupBy(*group, "value").agg(F.max("confidence").alias("confidence"), F.max(single_valued.cast("int")).alias("single"), F.max(temporal.cast("int")).alias("temporal"))
    values = values.withColumn("_of", F.struct("confidence", "value"))
    out = values.unionByName(distinct_counts(rows, group, ["source"]), allowMissingColumns=True).groupBy(*group).agg(
        F.count("value").alias("n_values"), F.coalesce(F.max("n_source"), F.lit(0)).alias("n_sources"), F.max("confidence").alias("best"),
        F.max_by("value", "_of").alias("best_value"), F.max("single").alias("single"), F.max("temporal").alias("temporal"),
    )
    kind = (
        F.when(F.col("best") < 0.1, "unsupported").when(F.col("best") < 0.45, "weak").when(F.col("n_values") <= 1, "same_value")
        .when(F.col("temporal") == 1, "temporal").when(F.col("single") == 1, "exclusive").otherwise("multi_value")
    )
    return out.select(*group, "n_values", "n_sources", "best", "best_value", kind.alias("conflict_class"))


def penalty(conflict_class: Column) -> Column:
    out = F.lit(0.0)
    for name, x in PENALTY.items():
        out = F.when(conflict_class == name, x).otherwise(out)
    return out


def risk_level(conflict_class: Column, n_sources: Column, best: Column) -> Column:
    return F.when(conflict_class.isin("exclusive", "unsupported") | (best < 0.45), "HIGH").when((n_sources < 2) | (conflict_class != "same_value"), "MEDIUM").otherwise("LOW")


def policy(level: Column) -> Column:
    return F.when(level == "HIGH", "MANUAL_REVIEW").when(level == "MEDIUM", "BATCH_REVIEW").otherwise("AUTO_PUBLISH")


def canonical(rows: DataFrame, key: list[str]) -> DataFrame:
    """Per key: the value of the most confident claim, all claim ids, the distinct sources and the confidence."""
    best = F.struct("confidence", (-F.col("claim_id")).alias("first"))
    each = rows.groupBy(*key).agg(F.max_by("value", best).alias("value"), F.collect_list("claim_id").alias("claim_ids"), F.max("confidence").alias("confidence"))
    out = each.withColumn("_one", F.lit(True)).unionByName(distinct_counts(rows, key, ["source"]), allowMissingColumns=True).groupBy(*key)
    # One row of a key has the claims, at most one the number of sources.
    first = lambda c: F.max_by(c, "_one")
    out = out.agg(first("value").alias("value"), first("claim_ids").alias("claim_ids"), F.coalesce(F.max("n_source"), F.lit(0)).alias("n_sources"), F.max("confidence").alias("confidence"))
    return out.withColumn("claim_ids", F.sort_array("claim_ids"))


def deltas(claims: DataFrame, published: DataFrame, key: list[str]) -> DataFrame:
    """Claims (key, value, single) against published (key, value): NEW subjects add, known values EXIST, others are added
    where a predicate takes several values and conflict where it takes one."""
    known = published.groupBy(*key).agg(F.collect_set("value").alias("known"))
    rows = claims.join(known, key, "left")
    op = F.when(F.col("known").isNull(), "NEW").when(F.array_contains("known", F.col("value")), "EXISTS").when(F.col("single"), "CONFLICT").otherwise("ADD")
    return rows.withColumn("operation", op).drop("known")


def review_queue(rows: DataFrame, key: list[str], status: str, updated: str, row_id: str) -> DataFrame:
    """One row of each key: the best status class, then the latest update (none last), then the largest id."""
    rank = F.lit(1)
    for name, k in STATUS_CLASS.items():
        rank = F.when(F.col(status) == name, k).otherwise(rank)
    order = W.partitionBy(*key).orderBy(rank, F.col(updated).desc_nulls_last(), F.desc(row_id))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def grounded(evidence: Column, quote: Column, value: Column) -> Column:
    """Why a claim isn't supported by its evidence's words; null if it is."""
    text = texts.compact(evidence)
    return (
        F.when(text == "", "EMPTY_EVIDENCE").when((texts.compact(quote) != "") & ~F.contains(text, texts.compact(quote)), "QUOTE_NOT_FOUND")
        .when((texts.compact(value) != "") & ~F.contains(text, texts.compact(value)), "VALUE_NOT_FOUND")
    )


def dependent_status(upstream: Column) -> Column:
    return F.when(upstream == "ADOPTED", "PENDING").when(upstream == "REJECTED", "INVALIDATED").otherwise("BLOCKED_BY_DEPENDENCY")


def upserted(old: DataFrame, new: DataFrame, key: list[str], greatest: list[str], terminal: Column) -> DataFrame:
    """Old and new rows by key: the larger of the columns ``greatest``; rows in a terminal status stay as they are."""
    o, n = old.alias("o"), new.alias("n")
    rows = o.join(n, key, "full_outer")
    kept = F.coalesce(terminal, F.lit(False))
    columns = [F.when(kept, F.col(f"o.{c}")).otherwise(F.greatest(F.col(f"o.{c}"), F.col(f"n.{c}"))).alias(c) for c in greatest]
    return rows.select(*key, *columns, F.coalesce(F.col("o.status"), F.col("n.status")).alias("status"))
