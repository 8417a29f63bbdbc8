"""All registered queries."""

from foliary.plans import ledger, library, recognition, retrieval, search, streams  # noqa: F401
from foliary.plans.registry import QUERIES

__all__ = ["QUERIES"]
