"""Loads every query module, so that the registry is complete."""

from shardlens.plans import (  # noqa: F401
    queries_nodes,
    queries_placement,
    queries_published,
    queries_reconcile,
    queries_sources,
    queries_streams,
    queries_tasks,
)
from shardlens.plans.registry import ORACLES, QUERIES  # noqa: F401
