"""Inputs of claim operators, built from the tables: phrases are dealt to rows by their keys, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import t

TYPES = ["property", "relation", "fact", "entity", "property", " Relation ", ""]
PREDICATES = [
    "是否开放", "有无护栏", "建设目标", "落实保护政策", "高度", "管理机构", "推动“双一流”战略", "承担省级重点实验室建设任务的单位情况", "建成年代", "打造文旅融合示范区",
    "main color", "located_in", "位于", "服务设施", "发展规划", "年度重修情况", "开放时间", "a name that is rather long",
]
VALUES = ["是", "否", "true", "建成年代", "1902年", "示范区", "文旅融合示范区", "太原", "open", "3项", ""]
STATUSES = ["conflict_candidate", "duplicate", "low_evidence", "adoptable", "needs_review", "published", None]


def sql_list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def pick(values: list, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(key, F.lit(len(values))).cast("int") + 1)


def pick_sql(values: list, key: str) -> str:
    return f"{sql_list(values)}[({key}) % {len(values)} + 1]"


#: A claim of every line item: claim, claim_type, predicate, value, status, part.
CLAIMS = f"""cl AS (SELECT l_orderkey * 8 + l_linenumber AS claim, {pick_sql(TYPES, 'l_orderkey + l_linenumber')} AS claim_type, {pick_sql(PREDICATES, 'l_partkey + l_linenumber')} AS predicate,
    {pick_sql(VALUES, 'l_suppkey + l_orderkey')} AS value, {pick_sql(STATUSES, 'l_partkey + l_orderkey')} AS status, l_partkey AS part, l_suppkey AS supp, l_linenumber AS line, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)"""


def claims(spark, sf_dir) -> DataFrame:
    o, n, p, s = (F.col(f"l_{c}") for c in ("orderkey", "linenumber", "partkey", "suppkey"))
    return t(spark, sf_dir, "lineitem").select(
        (o * 8 + n).alias("claim"), pick(TYPES, o + n).alias("claim_type"), pick(PREDICATES, p + n).alias("predicate"), pick(VALUES, s + o).alias("value"),
        pick(STATUSES, p + o).alias("status"), p.alias("part"), s.alias("supp"), n.alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
    )
