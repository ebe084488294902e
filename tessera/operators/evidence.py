"""Evidence on its way to claims: names in texts, batches within budgets, and which sources a request may read."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import mentions as names

#: Names of a chunk at most, text and image evidence of a batch, seconds of a lease.
MOST_NAMES, TEXTS, IMAGES, LEASE = 30, 200, 16, 900
#: Other names of sources, and what keeps a request to itself.
SOURCES = {"provided": "provided_evidence", "local_kb": "domain_kb", "kb": "domain_kb", "web": "web_search", "extractor": "web_extractor"}
OWN_ONLY = ("self", "self_web", "node")


def mentions(texts: DataFrame, nodes: DataFrame, key: str, text: str, most: int = MOST_NAMES) -> DataFrame:
    """``names.mentions`` with the usual number of names of a text."""
    return names.mentions(texts, nodes, key, text, most)


def claim_batches(units: DataFrame, texts: int = TEXTS, images: int = IMAGES) -> DataFrame:
    """``units`` (run, unit, is_image, priority) with ``batch``: which of a run's successive batches takes a unit.  A batch
    takes ``texts`` texts and ``images`` images at most, each in order of priority and id, until none is left.

    A unit's place is its number in its block of units plus the units of the blocks before it; a block is a range of
    priorities, so no run is numbered in one task."""
    kind = ["run", "is_image"]
    rows = numbered(units, kind, ["priority", "unit"])
    size = F.when(F.col("is_image"), images).otherwise(texts)
    return rows.withColumn("batch", F.floor((F.col("place") - 1) / size) + 1).drop("place")


def numbered(rows: DataFrame, by: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """``rows`` with ``place``, their number from 1 in an order within ``by``.

    Rows are range-partitioned by ``by`` and the order, so a large group is spread over many tasks; a task numbers its own
    rows, and the numbers of rows in earlier tasks are added.  Only those counts, one for each group and task, meet."""
    from tessera.sources import stages

    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *by, *order)
    # The number of a task is written with its rows, so that it stays what it was when they are read again.
    dealt = stages.stage(dealt.withColumn("_part", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", before).drop("_n")
    own = F.row_number().over(W.partitionBy(*by, "_part").orderBy(*order))
    keyed = dealt.withColumn("_own", own)
    same = [keyed[c].eqNullSafe(counts[c]) for c in (*by, "_part")]
    joined = keyed.join(counts.hint("shuffle_hash"), same)
    return joined.select(*[keyed[c] for c in rows.columns], (F.col("_own") + F.col("_before")).cast("long").alias("place"))


def source_scope(scope: str | Iterable[str] | None = None, depth: int | None = None, web_search: bool = False, web_extractor: bool = False, retrieval: str = "") -> set[str]:
    """The sources that a request may read.  Without a scope of its own: its own evidence, the knowledge base unless its
    depth is 0, and the web where it asks for it.  A depth of 0, or a retrieval of its own node alone, leaves the knowledge
    base out in any case."""
    web = {name for name, on in (("web_search", web_search), ("web_extractor", web_extractor)) if on}
    if scope is None:
        return {"provided_evidence"} | ({"domain_kb"} if depth != 0 else set()) | web
    parts = re.split(r"[\s,，;；|]+", scope) if isinstance(scope, str) else list(scope)
    names = {SOURCES.get(x, x) for x in (str(p or "").strip().lower() for p in parts) if x}
    if depth == 0 or retrieval.strip().lower() in OWN_ONLY:
        names = (names - {"domain_kb"}) | web
    return names or {"provided_evidence"}


def planned_sources(scope: set[str], has_evidence: bool, asked: Mapping[str, bool]) -> list[str]:
    """The sources in the order in which they are read."""
    on = {"provided_evidence": has_evidence, "domain_kb": True, "web_search": asked.get("web_search", False), "web_extractor": asked.get("web_extractor", False)}
    out = [name for name, wanted in on.items() if wanted and name in scope]
    return out or ["provided_evidence" if has_evidence else "none"]
