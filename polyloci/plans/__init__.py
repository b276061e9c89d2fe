"""Registered queries: each operator applied to the given tables, with SQL that states its result."""

from . import association_queries, result_queries, source_queries, variant_queries  # noqa: F401
from .bindings import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
