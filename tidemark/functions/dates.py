"""Dates as they appear on provider pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def normalize_dashes(text: Column) -> Column:
    return F.regexp_replace(text, C.UNICODE_DASHES, "-")


def shutdown_date(cell: Column) -> Column:
    """ISO date anywhere in the cell, else ``Mon[th] d, yyyy``; null otherwise."""
    text = normalize_dashes(cell)
    iso = F.regexp_extract(text, r"(\d{4}-\d{2}-\d{2})", 1)
    named = rf"\b([A-Z][a-z][a-z])[a-z]*\.?{C.WS}+(\d{{1,2}}),{C.WS}*(\d{{4}})\b"
    month = F.array_position(
        F.array(*[F.lit(m) for m in C.MONTHS]), F.lower(F.regexp_extract(text, named, 1))
    )
    spelled = F.concat_ws(
        "-",
        F.regexp_extract(text, named, 3),
        F.lpad(month.cast("string"), 2, "0"),
        F.lpad(F.regexp_extract(text, named, 2), 2, "0"),
    )
    return F.when(iso != "", iso).when(month > 0, spelled)


def lifecycle_on(shutdown: Column, run_date: Column | str) -> Column:
    """retired once the date has come, deprecated before, null when undated."""
    today = F.lit(run_date) if isinstance(run_date, str) else run_date
    return F.when(shutdown.isNotNull(), F.when(shutdown <= today, "retired").otherwise("deprecated"))


def older_than_days(stamp: Column, days: int, as_of: str) -> Column:
    """Stamp is more than ``days`` old; an unreadable stamp counts as old."""
    then = F.try_to_timestamp(stamp)
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    return F.coalesce(then < limit, F.lit(True))
