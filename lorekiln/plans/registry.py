"""All queries of the core and their SQL."""

from __future__ import annotations

from lorekiln.plans import concept_queries, hierarchy_queries, record_queries, store_queries, system_queries, text_queries

_MODULES = (concept_queries, hierarchy_queries, record_queries, store_queries, system_queries, text_queries)
FLAGSHIP = "search_cross_ns"
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
