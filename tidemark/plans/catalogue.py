"""All query modules, loaded once."""

from __future__ import annotations

from functools import cache


@cache
def load() -> None:
    from tidemark.plans import discovery_queries, feature_queries, research_queries, universe_queries

    for module in (feature_queries, discovery_queries, universe_queries, research_queries):
        module.load()
