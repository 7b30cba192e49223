"""Verification state of one registry record, read from its ``v_*`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import trim_ws


def auto_apply_ok() -> Column:
    """All four fields agree; a missing block fails closed."""
    return F.coalesce(
        (F.col("v_status") == "verified")
        & F.col("v_official")
        & F.col("v_replacement")
        & F.col("v_auto"),
        F.lit(False),
    )


def effective_state() -> Column:
    stamped = F.coalesce(F.col("v_status"), F.lit("unstamped"))
    return F.when(stamped != "verified", stamped).otherwise(
        F.when(auto_apply_ok(), F.lit("verified")).otherwise(F.lit("withheld"))
    )


def withheld_switches() -> Column:
    """Names of the switches that are off (none without a block)."""
    columns = ("v_official", "v_replacement", "v_auto")
    off = [
        F.when(~F.coalesce(F.col(c), F.lit(False)), F.lit(name))
        for c, name in zip(columns, C.SWITCHES)
    ]
    return F.when(F.col("v_status").isNull(), F.array().cast("array<string>")).otherwise(
        F.array_compact(F.array(*off))
    )


def has_text(column: Column) -> Column:
    return F.coalesce(F.length(trim_ws(column)) > 0, F.lit(False))


def non_empty(column: Column) -> Column:
    return F.coalesce(column != "", F.lit(False))


def official_source_confirmed() -> Column:
    """A source url plus any lifecycle claim."""
    return has_text(F.col("source_url")) & (
        non_empty(F.col("status")) | non_empty(F.col("shutdown_date"))
    )


def caveat_markers(reasons: Column) -> Column:
    """Lint only: markers found in free-text reasons."""
    haystack = F.lower(F.array_join(F.coalesce(reasons, F.array().cast("array<string>")), "\n"))
    return F.filter(
        F.array(*[F.lit(m) for m in C.CAVEAT_MARKERS]), lambda m: haystack.contains(m)
    )


def swap_label(deprecated: Column, replacement: Column, status: Column, date: Column) -> Column:
    when_ = (
        F.when(status == "retired", F.lit(" (retired)"))
        .when(
            (status == "deprecated") & non_empty(date),
            F.concat(F.lit(" (shuts down "), date, F.lit(")")),
        )
        .otherwise(F.lit(""))
    )
    return F.concat(F.lit('"'), deprecated, F.lit('"'), when_, F.lit(' -> "'), replacement, F.lit('"'))
