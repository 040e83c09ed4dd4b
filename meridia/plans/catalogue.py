"""All named queries of the library and their DuckDB SQL."""

from __future__ import annotations

from meridia.plans import curation_queries, diagnostic_queries, evaluation_queries, join_queries, metric_queries, pairing_queries, patch_queries, review_queries, route_queries, scene_queries, scoring_queries, sequence_queries, warp_queries, window_queries  # noqa: F401  they register themselves
from meridia.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
