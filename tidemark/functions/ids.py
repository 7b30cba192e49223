"""Identifier forms: canonical, family, record ids, model class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C
from .text import trim_ws


def canonical_id(raw: Column) -> Column:
    """Lower case, no alias marker, variant, namespace; dots read as dashes."""
    out = F.lower(trim_ws(raw))
    out = F.regexp_replace(out, "^~", "")
    out = F.substring_index(out, ":", 1)
    out = F.substring_index(out, "/", -1)
    return trim_ws(F.replace(out, F.lit("."), F.lit("-")))


def family_id(raw: Column) -> Column:
    """Canonical form without a trailing release date (short tags stay)."""
    out = F.regexp_replace(canonical_id(raw), r"-\d{4}-\d{2}-\d{2}$", "")
    return F.regexp_replace(out, r"-\d{8}$", "")


def ids_equal(left: Column, right: Column) -> Column:
    return canonical_id(left) == canonical_id(right)


def ids_family_match(left: Column, right: Column) -> Column:
    return family_id(left) == family_id(right)


def model_class(raw: Column) -> Column:
    return class_of_canonical(canonical_id(raw))


def class_of_canonical(canon: Column) -> Column:
    cases = reduce(
        lambda acc, item: acc.when(canon.rlike(item[1]), F.lit(item[0])),
        C.MODEL_CLASSES[1:],
        F.when(canon.rlike(C.MODEL_CLASSES[0][1]), F.lit(C.MODEL_CLASSES[0][0])),
    )
    return cases.otherwise(F.lit(C.DEFAULT_CLASS))


def catalog_verifiable(class_: Column) -> Column:
    return ~class_.isin(*C.OUT_OF_CLASS)


def entry_id(provider: Column, deprecated: Column, shutdown_date: Column) -> Column:
    """``provider.id.retirement-<date>``; an empty date counts as undated."""
    when_ = F.coalesce(F.nullif(shutdown_date, F.lit("")), F.lit("undated"))
    return F.concat(provider, F.lit("."), deprecated, F.lit(".retirement-"), when_)


def display_id(stamped: Column, derived: Column) -> Column:
    return F.coalesce(stamped, derived)


def candidate_id(provider: Column, deprecated: Column) -> Column:
    return F.concat(provider, F.lit(":"), canonical_id(deprecated))


def replacement_family(id_: Column) -> Column:
    """Everything through the first digit run, or the whole id."""
    head = F.regexp_extract(id_, r"^(.*?\d+)", 1)
    return F.when(head != "", head).otherwise(id_)


def dash_prefixes(id_: Column) -> Column:
    """Every prefix of ``id_`` that ends before a dash, and ``id_`` itself."""
    parts = F.split(id_, "-")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"),
    )


def excerpt_names(excerpt: Column, deprecated: Column) -> Column:
    """Does a quote mention the id it is cited for (case and dots ignored)."""

    def flat(text: Column) -> Column:
        return F.replace(F.lower(text), F.lit("."), F.lit("-"))

    haystack = flat(excerpt)
    return haystack.contains(flat(deprecated)) | haystack.contains(canonical_id(deprecated))


def finding_key(file: Column, line: Column, col: Column, value: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"), col.cast("string"), value)
