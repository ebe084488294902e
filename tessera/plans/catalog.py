"""The registered queries of the engine's own operators and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import assets, claims, conflicts, decisions, discovery, extraction, graphs, judgements, lifecycle, more, rollups, texts, vectors

MODULES = [vectors, graphs, claims, texts, rollups, decisions, more, judgements, assets, extraction, conflicts, lifecycle, discovery]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: q for m in MODULES for k, q in m.ORACLES.items()}

#: The query that entry() runs.
FLAGSHIP = "t1_vector_topk"
