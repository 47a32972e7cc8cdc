"""The query catalogue. Importing a module registers its queries."""

from quillspark.plans import composed, flagship, graph, quality, retrieval, tables, text  # noqa: F401
from quillspark.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
