"""All registered queries."""

from tallyhound.plans import queries_audit, queries_evaluation, queries_ledger, queries_links, queries_matching, queries_models, queries_profile, queries_sequence, queries_sources  # noqa: F401
from tallyhound.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
