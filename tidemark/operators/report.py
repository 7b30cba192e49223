"""Texts of verdicts and classes, and the sections of a machine-readable report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tiers as T

REASON_TEXT = {
    "usage_unverified": "assigned to a model-like name that reaches no supported call in this file",
    "replacement_unverified": "a live model argument whose replacement has not cleared verification",
    "platform_blocked": "names a provisioned deployment and not a model",
    "dynamic_model_value": "the model is assembled at runtime",
    "insufficient_dataflow": "the value was not traced to a definite use",
    "type_cast_masked": "behind a cast to a type of the repository's own",
}
USAGE_VERDICT = {"replacement_unverified": "confirmed"}
PURPOSE_TEXT = {
    "comparison": "compared with another value",
    "lookup_key": "key of a map or table",
    "list_entry": "one of several values in a list",
    "catalog_entry": "entry of a model catalog",
    "generic": "plain value",
}
TIER_TEXT = {"A": "auto-fixable", "B": "review required", "C": "informational"}
STATE_TEXT = {
    "verified": "verified",
    "quarantined": "held by a person",
    "withheld": "stamped verified, but a switch is off",
    "unverifiable": "no public catalog covers this class",
    "unstamped": "carries no verification block",
    "unverified": "did not clear verification",
}


def _lookup(column: Column, texts: dict[str, str]) -> Column:
    items = list(texts.items())
    start = F.when(column == items[0][0], F.lit(items[0][1]))
    return reduce(lambda acc, kv: acc.when(column == kv[0], F.lit(kv[1])), items[1:], start)


def usage_verdict(tier: Column, reason: Column) -> Column:
    return (
        F.when(tier == "A", F.lit("confirmed"))
        .when(tier == "C", F.lit("n/a"))
        .when(reason.isin(*USAGE_VERDICT), F.lit("confirmed"))
        .otherwise(F.lit("unverified"))
    )


def described(occ: DataFrame) -> DataFrame:
    """Findings with their texts."""
    return occ.select(
        "repo", "path", "line", "col", "value", "replacement", "entry_id", "tier", "reason",
        F.col("verdict").alias("replacement_verdict"),
        usage_verdict(F.col("tier"), F.col("reason")).alias("usage_verdict"),
        _lookup(F.col("tier"), TIER_TEXT).alias("classification"),
        F.when(F.col("tier") == "B", _lookup(F.col("reason"), REASON_TEXT))
        .when(F.col("tier") == "C", _lookup(F.col("purpose"), PURPOSE_TEXT))
        .alias("text"),
        _lookup(F.col("verdict"), STATE_TEXT).alias("state_text"),
        "checked_at",
    )


#: The columns of occurrences that a report reads.
COLUMNS = (
    "repo", "path", "line", "col", "value", "tier", "reason", "verdict", "position", "purpose", "auto_apply",
    "entry_id", "replacement", "lifecycle", "shutdown_date", "checked_at", "v_status", "v_official", "v_replacement",
)


def sections(occ: DataFrame) -> dict[str, DataFrame]:
    """Report sections: the findings, their counts, evidence and swap labels."""
    return {
        "findings": described(occ),
        "counts": T.rollup(occ),
        "unique": T.unique_occurrences(occ),
        "evidence": T.patch_evidence(occ),
        "swaps": T.swap_labels(occ),
    }
