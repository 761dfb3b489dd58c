"""All queries, by area."""

from evidentia.plans import (  # noqa: F401
    queries_evidence,
    queries_pages,
    queries_parts,
    queries_shapes,
    queries_state,
    queries_streams,
)
from evidentia.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
