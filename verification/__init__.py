"""Registered queries with their independent SQL counterparts."""

from verification.registry import ORACLE, QUERIES
from verification import (  # noqa: F401
    cases_access,
    cases_graph,
    cases_rules,
    cases_signals,
    cases_policies,
    cases_sources,
    cases_learning,
)

__all__ = ["ORACLE", "QUERIES"]
