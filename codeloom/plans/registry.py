"""All core queries and their SQL."""

from __future__ import annotations

from codeloom.plans import base, graph_queries, problems, ranking_queries, review_queries, search_queries, source_queries, tool_queries, gate_queries  # noqa: F401

QUERIES = {**problems.QUERIES, **base.QUERIES}
ORACLES = {**problems.ORACLES, **base.ORACLES}
