"""Scores of knowledge units for a question asked at a place: characters or vectors, places, names and topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hierarchy

# Factors by where a unit's place lies from the asker's, for a named place and for the topic.
SAME, ABOVE, BELOW, NAMED, TOPIC = 2.0, 1.2, 1.8, 3.0, 1.5
#: Topics that ask for what is near, units that answer them, and topics with factors of their own.
NEARBY_TOPICS, NEARBY_UNITS = ("路线", "服务", "SERVICE", "ROUTE"), ("路线", "服务", "设施", "餐饮", "其他", "Route", "Service", "Facility", "Others", "Common")
BUILDING_TOPICS, GENERAL_TOPICS = ("建筑", "BUILDING"), ("百科", "ENCYCLOPEDIA", "历史", "HISTORY")


def closure(parents: DataFrame) -> DataFrame:
    """(above, below) for a tree of (space, parent): every place and all places beneath it, at any depth."""
    return hierarchy.ancestors(parents, "space", "parent").select("above", "below")


def relation(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(question, space, where): how places lie from the place ``here`` of a question: same, above or below."""
    here = asked.select("question", F.col("here"))
    same = here.select("question", F.col("here").alias("space"), F.lit("same").alias("where"))
    above = here.join(pairs, F.col("here") == F.col("below")).select("question", F.col("above").alias("space"), F.lit("above").alias("where"))
    below = here.join(pairs, F.col("here") == F.col("above")).select("question", F.col("below").alias("space"), F.lit("below").alias("where"))
    return same.unionByName(above).unionByName(below)


def character_overlap(query: Column, text: Column) -> Column:
    """The share of a question's characters that a text holds; 0 for an empty question."""
    signs = F.filter(F.split(query, ""), lambda c: c != "")
    return F.coalesce(F.size(F.filter(signs, lambda c: F.contains(text, c))) / F.nullif(F.length(query), F.lit(0)), F.lit(0.0))


def unit_score(query: Column, text: Column, where: Column, named: Column, topic: Column, unit_topic: Column) -> Column:
    """Character overlap, raised by place, by the name of the unit's place in the question, and by topic."""
    place = F.when(where == "same", SAME).when(where == "above", ABOVE).when(where == "below", BELOW).otherwise(1.0)
    own = F.coalesce(topic, F.lit("")) != ""
    return F.when(query == "", 0.0).otherwise(character_overlap(query, text) * place * F.when(named, NAMED).otherwise(1.0) * F.when(own & (topic == unit_topic), TOPIC).otherwise(1.0))


def boosted(cosine: Column, query: Column, keywords: Column, same_space: Column, topic: Column, unit_topic: Column) -> Column:
    """A cosine, raised for keywords of two or more characters in the question, and then by the topic for units of the same
    place that score above 0.3."""
    hit = F.exists(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: (F.length(k) > 1) & F.contains(query, k))
    score = F.when(hit, cosine * 1.05 + 0.05).otherwise(cosine)
    near = F.when(topic.isin(*NEARBY_TOPICS) & F.coalesce(unit_topic, F.lit("")).isin(*NEARBY_UNITS), 2.0).when(topic.isin(*BUILDING_TOPICS), 1.2).when(topic.isin(*GENERAL_TOPICS), 1.05).otherwise(1.1)
    return F.when(same_space & (score > 0.3), score * near).otherwise(score)
