"""Retirement candidates read off provider deprecation pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import dates, ids
from ..functions.text import cell_text, collapse_ws, content_hash, normalize_for_hash
from ..session import spread
from .joins import first_by, lookup_join

_CELL = r"(?is)<t[dh][^>]*>.*?</t[dh]>"
_ROW = r"(?is)<tr.*?</tr>"
_TABLE = r"(?is)<table.*?</table>"


def _cells(row_html: Column) -> Column:
    return F.transform(F.regexp_extract_all(row_html, F.lit(_CELL), F.lit(0)), cell_text)


def _columns(headers: Column, wanted) -> Column:
    """0-based positions of the header cells that satisfy ``wanted``."""
    marked = F.transform(headers, lambda h, i: F.when(wanted(h), i))
    return F.array_compact(marked)


def model_ids_in(cell: Column, provider: Column, patterns: dict[str, str]) -> Column:
    """Distinct model ids in a cell, in order of appearance."""
    tokens = F.transform(
        F.split(dates.normalize_dashes(cell), rf"(?:{C.WS}|[,|/()])+"),
        lambda t: F.regexp_replace(F.lower(t), r"[.,;:*]+$", ""),
    )

    def wanted(token: Column) -> Column:
        known = reduce(
            lambda acc, item: acc | ((provider == item[0]) & token.rlike(item[1])),
            patterns.items(),
            F.lit(False),
        )
        return token.rlike(C.MODEL_ID_SHAPE) & known

    return F.array_distinct(F.filter(tokens, wanted))


def table_rows(
    pages: DataFrame,
    patterns: dict[str, str] | None = None,
    html: str = "html",
) -> DataFrame:
    """Every data row (and unreadable table) of every page with its ``skip`` reason.

    Keeps the page columns other than the html, and adds table_no, row_no,
    row_text, deprecated, replacement, shutdown_date, skip. ``skip`` is null for
    rows read in full. Rows naming no model at all are headings and are dropped.
    """
    return _read_tables(spread(pages), patterns, html)


def _read_tables(pages: DataFrame, patterns: dict[str, str] | None, html: str = "html") -> DataFrame:
    patterns = patterns or C.PROVIDER_ID_PATTERNS
    keep = [c for c in pages.columns if c != html]
    tables = pages.select(
        *keep,
        F.posexplode(F.regexp_extract_all(F.col(html), F.lit(_TABLE), F.lit(0))).alias(
            "table_no", "_table"
        ),
    )
    tables = tables.withColumn(
        "_rows", F.regexp_extract_all("_table", F.lit(_ROW), F.lit(0))
    ).where(F.size("_rows") >= 2)
    tables = tables.withColumn("_headers", _cells(F.col("_rows")[0])).drop("_table")

    is_repl = lambda h: h.rlike(C.REPLACEMENT_HEADER)
    tables = (
        tables.withColumn("_repl", _columns(F.col("_headers"), is_repl))
        .withColumn(
            "_dep",
            _columns(
                F.col("_headers"),
                lambda h: ~is_repl(h) & h.rlike(C.MODEL_HEADER) & ~h.rlike(C.PRICE_HEADER),
            ),
        )
        .withColumn(
            "_date",
            F.try_element_at(
                _columns(F.col("_headers"), lambda h: ~is_repl(h) & h.rlike(C.DATE_HEADER)), F.lit(1)
            ),
        )
        .withColumn(
            "_table_skip",
            F.when(F.size("_repl") != 1, F.lit("replacement_columns")).when(
                F.size("_dep") != 1, F.lit("model_columns")
            ),
        )
    )
    # An unreadable table gives one row (its header); a readable one its data rows.
    unreadable = F.col("_table_skip").isNotNull()
    body = F.when(unreadable, F.slice("_rows", 1, 1)).otherwise(
        F.slice("_rows", F.lit(2), F.size("_rows"))
    )
    provider = F.col("provider")

    def at(cells: Column, position: Column) -> Column:
        return F.coalesce(F.try_element_at(cells, position + 1), F.lit(""))

    # Each step binds its result, so no cell is cleaned twice; and rows that name
    # no model are dropped before they become rows.
    cells = F.transform(body, lambda row, i: F.struct(i.alias("n"), _cells(row).alias("c")))
    named = F.transform(
        cells,
        lambda x: F.struct(
            x["n"].alias("n"),
            x["c"].alias("c"),
            model_ids_in(at(x["c"], F.try_element_at("_dep", F.lit(1))), provider, patterns).alias("d"),
            model_ids_in(at(x["c"], F.try_element_at("_repl", F.lit(1))), provider, patterns).alias("r"),
        ),
    )
    claims = F.filter(named, lambda x: unreadable | (F.size(x["d"]) > 0))
    rows = tables.select(*keep, "table_no", "_date", "_table_skip", F.explode(claims).alias("_x"))

    d, r = F.col("_x.d"), F.col("_x.r")
    dep, rep = F.try_element_at(d, F.lit(1)), F.try_element_at(r, F.lit(1))
    skip = (
        F.when(F.col("_table_skip").isNotNull(), F.col("_table_skip"))
        .when(F.size(d) > 1, F.lit("several_models"))
        .when(F.size(r) == 0, F.lit("no_replacement"))
        .when(F.size(r) > 1, F.lit("several_replacements"))
        .when(ids.ids_equal(dep, rep), F.lit("maps_to_itself"))
    )
    rows = rows.withColumn("skip", skip)
    read = F.col("skip").isNull()
    when_ = F.when(
        F.col("_date").isNotNull(), dates.shutdown_date(at(F.col("_x.c"), F.col("_date")))
    )
    return rows.select(
        *keep,
        "table_no",
        F.col("_x.n").alias("row_no"),
        collapse_ws(F.array_join(F.col("_x.c"), " | ")).alias("row_text"),
        F.when(read, dep).alias("deprecated"),
        F.when(read, rep).alias("replacement"),
        F.when(read, when_).alias("shutdown_date"),
        "skip",
    )


def readable_rows(pages: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    return table_rows(pages, patterns).where("skip is null").drop("skip")


def skipped_rows(pages: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    return table_rows(pages, patterns).where("skip is not null").drop(
        "deprecated", "replacement", "shutdown_date"
    )


def known_ids(registry: DataFrame, queue: DataFrame) -> DataFrame:
    """Canonical ids already in the registry or in the queue."""
    active = registry.where(F.col("kind") == "model_id").select("deprecated")
    return (
        active.unionByName(queue.select("deprecated"))
        .select(ids.canonical_id(F.col("deprecated")).alias("canon"))
        .distinct()
    )


def propose(rows: DataFrame, run_date: str) -> DataFrame:
    """Candidate columns for readable rows (no deduplication)."""
    return (
        rows.withColumn("canon", ids.canonical_id(F.col("deprecated")))
        .withColumn("candidate_id", ids.candidate_id(F.col("provider"), F.col("deprecated")))
        .withColumn("status", dates.lifecycle_on(F.col("shutdown_date"), run_date[:10]))
        .withColumn("proposed_by", F.lit("discovery"))
        .withColumn("proposed_at", F.lit(run_date))
    )


def discover(
    pages: DataFrame,
    registry: DataFrame,
    queue: DataFrame,
    run_date: str,
    patterns: dict[str, str] | None = None,
) -> DataFrame:
    """New candidates, each identifier once, with the page hash as evidence.

    ``pages`` needs provider, provider_pos (order of providers in the run),
    page_id, url, html. The first sighting in (provider_pos, page_id, table,
    row) order wins.
    """
    hashed = spread(pages).withColumn("content_hash", content_hash(normalize_for_hash(F.col("html"))))
    fresh = propose(_read_tables(hashed, patterns).where("skip is null").drop("skip"), run_date)
    fresh = lookup_join(fresh, known_ids(registry, queue), ["canon"], "left_anti")
    first = first_by(fresh, ["canon"], ["provider_pos", "page_id", "table_no", "row_no"])
    return first.select(
        "candidate_id",
        "provider",
        "deprecated",
        "replacement",
        "status",
        "shutdown_date",
        F.col("url").alias("source_url"),
        "content_hash",
        F.col("row_text").alias("excerpt"),
        "proposed_by",
        "proposed_at",
    )


def page_summary(pages: DataFrame, fresh: DataFrame, patterns: dict[str, str] | None = None) -> DataFrame:
    """Per provider: readable rows, skipped rows, new candidates."""
    seen = table_rows(pages, patterns).groupBy("provider").agg(
        F.count_if(F.col("skip").isNull()).alias("readable"),
        F.count_if(F.col("skip").isNotNull()).alias("skipped"),
    )
    added = fresh.groupBy("provider").agg(F.count(F.lit(1)).alias("added"))
    return seen.join(added, "provider", "left").fillna(0, ["added"])
