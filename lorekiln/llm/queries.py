"""All queries of the training-data operators and their SQL."""

from __future__ import annotations

from lorekiln.llm import p1_queries, p2_queries, p3_queries, p5_queries, p6_queries, p7_queries, p8_queries, p9_queries

_MODULES = (p1_queries, p2_queries, p3_queries, p5_queries, p6_queries, p7_queries, p8_queries, p9_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
