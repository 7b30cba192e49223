"""Path scope, languages and dotted access paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C


def unix_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def _any(path: Column, patterns: tuple[str, ...]) -> Column:
    """Any pattern matches. The path is named once: a path that is composed would be composed for each mention."""
    return unix_path(path).rlike("|".join(f"(?:{p})" for p in patterns))


def is_ts_test_path(path: Column) -> Column:
    return _any(path, C.TS_TEST_PATTERNS)


def is_py_test_path(path: Column) -> Column:
    return _any(path, C.PY_TEST_PATTERNS)


def _dirs(names: tuple[str, ...]) -> str:
    return f"(?:^|/)(?:{'|'.join(re.escape(n) for n in names)})/"


def under_dirs(path: Column, names: tuple[str, ...]) -> Column:
    return _any(path, (_dirs(names),))


def language(path: Column) -> Column:
    return F.when(path.rlike(C.TS_EXTENSIONS), F.lit("ts")).when(path.endswith(".py"), F.lit("py"))


def in_scan_scope(path: Column) -> Column:
    """File belongs to a scan: known language, not vendored, not test support."""
    # The rules of a language are one expression, so that a path is searched once.
    ts = ~path.endswith(".d.ts") & ~_any(path, (_dirs(C.TS_EXCLUDED_DIRS), *C.TS_TEST_PATTERNS))
    py = ~_any(path, (_dirs(C.PY_EXCLUDED_DIRS), *C.PY_TEST_PATTERNS))
    # Its ending is looked at once as well: what is no TypeScript path falls through.
    return F.when(path.rlike(C.TS_EXTENSIONS), ts).when(path.endswith(".py"), py).otherwise(F.lit(False))


def in_fact_scope(path: Column, lang: Column) -> Column:
    """Scope rule for facts whose language is already known."""
    ts = ~path.endswith(".d.ts") & ~_any(path, (_dirs(("node_modules",)), *C.TS_TEST_PATTERNS))
    return F.when(lang == "ts", ts).otherwise(~is_py_test_path(path))


def basename(path: Column) -> Column:
    return F.substring_index(unix_path(path), "/", -1)


def catalog_like(path: Column, distinct_ids: Column) -> Column:
    return (distinct_ids > C.CATALOG_DISTINCT_IDS) | basename(path).rlike(C.CATALOG_BASENAME)


def strip_root(path: Column, root: str) -> Column:
    """Drop a leading ``Root.`` written in any case."""
    return F.regexp_replace(path, rf"^(?i:{root})\.", "")


def access_prefixes(path: Column) -> Column:
    """``T.a.b`` -> [``T.a``, ``T.a.b``]."""
    parts = F.split(path, r"\.")
    return F.when(
        F.size(parts) > 1,
        F.transform(
            F.sequence(F.lit(2), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))
