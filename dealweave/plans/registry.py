"""All registered queries of the matching engine, with their SQL."""

from __future__ import annotations

from dealweave.plans import ingest_queries, match_queries, rule_queries, serve_queries, upkeep_queries  # noqa: F401
from dealweave.plans.base import ORACLES, QUERIES  # noqa: F401
