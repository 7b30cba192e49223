"""Which breaking changes between two spec versions each repository uses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import specdiff, usage


def spec_impact(spec_docs: DataFrame, usage_rows: DataFrame, root: str, old: str = "A", new: str = "B") -> DataFrame:
    found = specdiff.spec_diff(spec_docs, old, new)
    return usage.impact(usage.affected_sites(found, usage_rows, root))
