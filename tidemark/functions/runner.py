"""Pass / fail counts read from a test runner's output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

_LINE = rf"(?m)^{C.WS}*Tests:?{C.WS}+([^\r\n]+)$"


def _scope(output: Column) -> Column:
    line = F.regexp_extract(output, _LINE, 1)
    return F.when(line != "", line).otherwise(output)


def _count(output: Column, verb: str) -> Column:
    found = F.regexp_extract(_scope(output), rf"(\d+){C.WS}+{verb}(?:ed|ing)\b", 1)
    return F.when(found != "", found.try_cast("bigint"))


def recognised(output: Column) -> Column:
    return _count(output, "pass").isNotNull() | _count(output, "fail").isNotNull()


def passed_count(output: Column) -> Column:
    """Null when the output has no recognisable summary."""
    return F.when(recognised(output), F.coalesce(_count(output, "pass"), F.lit(0)))


def failed_count(output: Column) -> Column:
    return F.when(recognised(output), F.coalesce(_count(output, "fail"), F.lit(0)))
