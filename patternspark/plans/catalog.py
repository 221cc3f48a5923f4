"""All registered queries of the rule operators."""

from __future__ import annotations

from . import mining_queries, registry, source_queries

QUERIES, ORACLES, flagship = registry.QUERIES, registry.ORACLES, registry.flagship

__all__ = ["ORACLES", "QUERIES", "flagship", "mining_queries", "source_queries"]
