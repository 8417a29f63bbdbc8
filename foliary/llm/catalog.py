"""All queries of this package."""

from foliary.llm import (  # noqa: F401
    chunks,
    compression,
    contamination,
    context_tree,
    conversations,
    packing,
    quality,
    resampling,
    sharding,
    simhash,
    sketches,
    substrings,
    surrogates,
)
from foliary.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
