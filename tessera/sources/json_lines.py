"""JSON Lines and JSON document files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_bad: bool = True) -> DataFrame:
    """Rows of JSON Lines; blank lines are skipped, and bad ones too where ``skip_bad``, else they are rows of nulls."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE").json(path)


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def newest_first(log: DataFrame, at: str) -> DataFrame:
    return log.orderBy(F.desc(at))
