"""Registered queries of the engine."""

from tidemark.plans import audit_queries, graph_queries, learning_queries, profile_queries, scalar_queries  # noqa: F401  registers queries
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
