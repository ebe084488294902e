"""Retrieval, knowledge-graph and evidence analytics as PySpark DataFrame operators."""
