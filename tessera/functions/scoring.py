"""Evidence and claim scores as Column builders; components lie between 0 and 1."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def rounded(x: Column, digits: int) -> Column:
    """Rounded half up as a decimal: of sums of short decimals, ties are the same on every engine."""
    return F.round(x.cast("decimal(20,10)"), digits).cast("double")


def weighted_mean(parts: dict[str, float], digits: int = 4) -> Column:
    """Mean of the columns by their weights; null components and their weights are left out, none at all gives 0."""
    plus = lambda xs: reduce(lambda a, b: a + b, xs)
    top = plus([F.when(F.col(c).isNotNull(), clamp(F.col(c)) * w).otherwise(0.0) for c, w in parts.items()])
    low = plus([F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in parts.items()])
    return rounded(clamp(F.coalesce(top / F.nullif(low, F.lit(0.0)), F.lit(0.0))), digits)


def trust(support: Column, entity: Column, quality: Column, cross: Column, risk: Column, digits: int = 4) -> Column:
    return rounded(clamp(0.55 * support + 0.20 * entity + 0.15 * quality + 0.10 * cross - 0.10 * risk), digits)


def evidence_score(score: Column, weight: Column) -> Column:
    return rounded(F.least(F.lit(1.0), 0.7 * score + 0.3 * weight), 3)


def verification(quote: Column, relevance: Column, locator: Column, retrieval: Column) -> Column:
    return 0.35 * quote + 0.25 * relevance + 0.20 * locator + 0.20 * retrieval


def support_status(score: Column) -> Column:
    return F.when(score >= 0.75, "supported").when(score >= 0.45, "weak").otherwise("unsupported")


def entailment(evidence: Column, subject: Column, predicate: Column, value: Column) -> Column:
    """How well a text entails a claim, by which of its parts it holds; null for an empty text."""
    has = lambda x: (x != "") & F.contains(evidence, x)
    return (
        F.when(evidence == "", F.lit(None).cast("double"))
        .when(has(subject) & has(predicate) & has(value), 0.9)
        .when(has(subject) & has(value), 0.8)
        .when(has(value), 0.7)
        .when(has(subject) & has(predicate), 0.45)
        .otherwise(0.15)
    )


def backoff_seconds(attempt: Column) -> Column:
    return F.least(F.lit(300.0), F.pow(F.lit(2.0), F.greatest(attempt, F.lit(1))))
