"""Registered queries over the driver's tables."""

from vigilake.plans import (  # noqa: F401
    document_queries, label_queries, listing_queries, page_queries, store_queries, stream_queries, text_queries,
)
from vigilake.plans.registry import COVERS, ORACLES, QUERIES

__all__ = ["COVERS", "ORACLES", "QUERIES"]
