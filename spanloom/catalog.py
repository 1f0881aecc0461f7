"""Registered queries of the engine's own operators, and their SQL oracles."""

from __future__ import annotations

from .plans import building, contracts, descents, indexed, levels, lifecycle, more, navigation, owners, registry, retrieval, sources, structure

ALL = {**retrieval.QUERIES, **structure.QUERIES, **lifecycle.QUERIES, **sources.QUERIES, **more.QUERIES, **contracts.QUERIES, **registry.QUERIES, **building.QUERIES, **descents.QUERIES, **navigation.QUERIES, **levels.QUERIES, **owners.QUERIES, **indexed.QUERIES}
FLAGSHIP = retrieval.keyword_search


def queries() -> dict:
    return {name: query for name, (query, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
