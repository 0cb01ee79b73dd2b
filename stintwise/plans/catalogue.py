"""All registered queries; importing the modules fills the registry."""

from __future__ import annotations

from stintwise.plans import (  # noqa: F401
    audit_queries, describe_queries, evidence_queries, inference_queries, source_queries, trail_queries,
)
from stintwise.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
