"""Rule tables and text checks of evidence, claims and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def low_information(content: Column, title: Column) -> Column:
    """Nothing, or no more than the title."""
    text = F.trim(F.regexp_replace(content, r"\s+", " "))
    return (F.trim(content) == "") | (F.lower(text) == F.lower(title))


def non_entity(mention: Column) -> Column:
    """Why a mention is no entity; null if it may be one."""
    return (
        F.when(F.length(F.trim(mention)) == 0, "EMPTY").when((F.length(mention) > 40) & mention.rlike("[,.;:!?]"), "LONG_WITH_PUNCTUATION")
        .when((F.length(mention) >= 8) & F.lower(mention).rlike(r"\b(is|was|has|are)\b"), "CLAUSE")
    )


def scoped(rows: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Rows of the seeds; all rows where there are no seeds."""
    return rows if seeds.isEmpty() else rows.join(seeds, key, "left_semi")


def year_of(text: Column) -> Column:
    """The first year from 1000 to 2099 in a text."""
    return F.regexp_extract(text, r"\b(1[0-9]{3}|20[0-9]{2})\b", 1).try_cast("int")


def without_noise(value: Column) -> Column:
    """Without a bracketed end and without punctuation at either end."""
    value = F.regexp_replace(value, r"\s*[\(\[（【][^\)\]）】]*[\)\]）】]\s*$", "")
    return F.regexp_replace(value, r"^[\s,.;:]+|[\s,.;:]+$", "")


def keep_decision(score: Column) -> Column:
    return F.when(score >= 1.2, "keep").otherwise("reject")


def planned(rows: DataFrame, key: str, kinds: dict[str, int]) -> DataFrame:
    """(key, kind, priority, question_id): a question of each kind for each row."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("priority")) for k, p in kinds.items()])).alias("z")
    out = rows.select(key, each).select(key, "z.kind", "z.priority")
    return out.withColumn("question_id", F.substring(F.sha1(F.concat_ws("|", F.col(key).cast("string"), "kind")), 1, 12))


def first_scope(scopes: list[DataFrame]) -> DataFrame:
    """The rows of the first scope that has any, with its level from 1."""
    every = reduce(DataFrame.unionByName, [s.withColumn("level", F.lit(k)) for k, s in enumerate(scopes, 1)])
    least = every.agg(F.min("level").alias("level"))
    return every.join(F.broadcast(least), "level")


def ocr_pages(lines: DataFrame, least: float) -> DataFrame:
    """Per asset of lines (asset, line, text, score): the text of lines with at least that score and of all lines, the best
    score of all, the mean of the kept ones, and their number."""
    kept = F.col("score") >= least
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["text"]), "")
    out = lines.groupBy("asset").agg(
        joined(F.when(kept, F.struct("line", "text"))).alias("clean"), joined(F.struct("line", "text")).alias("raw"), F.round(F.max("score"), 6).alias("best"),
        F.round(F.avg(F.when(kept, F.col("score"))), 6).alias("mean_kept"), F.count_if(kept).alias("kept"),
    )
    return out.withColumn("clean", F.nullif(F.col("clean"), F.lit("")))
