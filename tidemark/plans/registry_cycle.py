"""discover -> promote -> re-stamp, on versioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import discovery, promotion, verdicts
from ..session import durable
from ..sources.registry import save_transition


def promote_and_save(
    requests: DataFrame,
    candidates: DataFrame,
    registry: DataFrame,
    refs: DataFrame,
    stored: DataFrame,
    live: DataFrame,
    official: DataFrame,
    checked_at: str,
    sources: list[str],
    root: str,
    version: int,
) -> DataFrame:
    """Decide once, then commit the next registry and queue together. Returns decisions."""
    decided = promotion.decide(requests, candidates, registry, refs, stored, live, official)
    decisions = durable(decided, "decisions")
    next_registry, next_queue = promotion.transition(
        decisions, candidates, registry, live, official, checked_at, sources
    )
    save_transition(next_registry, next_queue, root, version)
    return decisions


def recheck(registry: DataFrame, live: DataFrame, official: DataFrame, checked_at: str, sources: list[str]):
    """(re-stamped registry, audit)."""
    stamped = verdicts.restamp(registry, live, official, checked_at, sources)
    return stamped, verdicts.audit(stamped)


def discover_into_queue(pages: DataFrame, registry: DataFrame, queue: DataFrame, run_date: str) -> DataFrame:
    fresh = discovery.discover(pages, registry, queue, run_date)
    return queue.unionByName(fresh, allowMissingColumns=True)
