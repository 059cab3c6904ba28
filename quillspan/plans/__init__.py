"""Queries over the driver's tables."""

from __future__ import annotations

from types import ModuleType


def load() -> ModuleType:
    """The registry, with all queries of this folder in it."""
    from quillspan.plans import build_queries, eval_queries, graph_queries, more_queries, rank_queries, registry, relational_queries, source_queries, staging_queries, text_queries  # noqa: F401

    return registry
