"""All queries by name, and their SQL."""

from __future__ import annotations

from . import area_queries, camera_queries, graph_queries, job_queries, place_queries, release_queries, source_queries

_MODULES = (camera_queries, graph_queries, place_queries, release_queries, job_queries, source_queries, area_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
