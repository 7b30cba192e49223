"""Captured provider documents: hashes, drift, staleness, excerpt windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import dates
from ..functions.text import (
    collapse_ws,
    content_hash,
    normalize_for_hash,
    snapshot_key,
    utf8_prefix,
)
from .corpus import passes, sieve
from .joins import first_by, lookup_join


def hashed(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds content_hash (noise removed first) and the doc_key it is stored under."""
    return docs.withColumn("content_hash", content_hash(normalize_for_hash(F.col(text)))).withColumn(
        "doc_key", snapshot_key(F.col("content_hash"))
    )


def stale(refs: DataFrame, days: int, as_of: str) -> DataFrame:
    return refs.withColumn("stale", dates.older_than_days(F.col("retrieved_at"), days, as_of))


def ordered_lag(
    df: DataFrame, key: str, order: str | list[str], value: str, out: str, bucket: Column
) -> DataFrame:
    """Previous ``value`` of the same key in ``order``, with no key in one task.

    Rows are lagged inside (key, bucket). The first row of a bucket takes the
    last value of the nearest earlier bucket, which comes from a table with one
    row per (key, bucket). ``bucket`` must not decrease as ``order`` grows.
    """
    order = [order] if isinstance(order, str) else order
    keyed = df.withColumn("_bucket", bucket)
    ends = keyed.groupBy(key, "_bucket").agg(
        F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("_end")
    )
    across = Window.partitionBy(key).orderBy("_bucket")
    carried = ends.select(
        key, "_bucket", F.lag("_end").over(across).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    local = keyed.withColumn("_local", F.lag(F.struct(F.col(value))).over(inside))
    out_rows = local.join(carried, [key, "_bucket"], "left")
    previous = F.coalesce(F.col("_local"), F.col("_carried"))
    return out_rows.withColumn(out, previous[value]).drop("_bucket", "_local", "_carried")


def drift(captures: DataFrame, bucket: Column | None = None) -> DataFrame:
    """(url, retrieved_at, content_hash, previous_hash, changed) per capture.

    A capture has changed when its noise-free hash differs from that of the
    capture before it; captures of one time stand in order of their hashes. A url
    with much of the table is split by day.
    """
    rows = captures.select(
        "url", "retrieved_at", content_hash(normalize_for_hash(F.col("text"))).alias("content_hash")
    )
    day = F.substring("retrieved_at", 1, 10) if bucket is None else bucket
    lagged = ordered_lag(rows, "url", ["retrieved_at", "content_hash"], "content_hash", "previous_hash", day)
    return lagged.select(
        "url",
        "retrieved_at",
        "content_hash",
        "previous_hash",
        F.coalesce(F.col("content_hash") != F.col("previous_hash"), F.lit(False)).alias("changed"),
    )


def drift_sessions(drifted: DataFrame) -> DataFrame:
    """Runs of equal hashes per url: number of changes and the span covered."""
    return drifted.groupBy("url").agg(
        F.count(F.lit(1)).alias("captures"),
        (F.count_if("changed") + 1).alias("sessions"),
        F.min("retrieved_at").alias("first_seen"),
        F.max("retrieved_at").alias("last_seen"),
    )


# --- excerpt windows of over-long documents ----------------------------------


def excerpt_anchor(haystack: Column, excerpt: Column) -> Column:
    """0-based position of an excerpt in a text in lower case: the quote itself, else its
    longest token of six or more characters that occurs. -1 when nothing does."""
    flat = F.lower(collapse_ws(excerpt))
    tokens = F.filter(F.split(flat, r"[^a-z0-9._-]+"), lambda t: F.length(t) >= C.MIN_ANCHOR_TOKEN)
    # Longest first; equal lengths keep their order in the excerpt.
    ranked = F.array_sort(
        F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    )
    found = lambda places: F.try_element_at(F.filter(places, lambda p: p > 0), F.lit(1))
    direct = found(F.array(F.position(flat, haystack)))
    hits = found(F.transform(ranked, lambda r: F.position(r["t"], haystack)))
    return F.when(F.length(flat) == 0, F.lit(-1)).otherwise(F.coalesce(direct, hits, F.lit(0)) - 1)


def _merged(spans: Column) -> Column:
    """Sorted spans with those that touch or overlap made one."""
    last = lambda s: F.element_at(s, -1)
    span = lambda start, end: F.array(F.struct(start.alias("start"), end.alias("end")))
    joined = lambda s, x: F.concat(
        F.slice(s, F.lit(1), F.size(s) - 1), span(last(s)["start"], F.greatest(last(s)["end"], x["end"]))
    )
    return F.aggregate(
        F.slice(spans, F.lit(2), F.greatest(F.size(spans), F.lit(1))),
        F.slice(spans, F.lit(1), F.lit(1)),
        lambda s, x: F.when(x["start"] > last(s)["end"], F.concat(s, span(x["start"], x["end"]))).otherwise(joined(s, x)),
    )


def _affordable(islands: Column, text: Column, budget: Column) -> Column:
    """The first islands of the text whose bytes fit the budget; the one that crosses it is clipped."""
    piece = lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"])

    def clipped(x: Column, room: Column) -> Column:
        length = F.length(utf8_prefix(piece(x), room.cast("int")))
        return F.struct(x["start"].alias("start"), (x["start"] + length).alias("end"))

    def take(state: Column, x: Column) -> Column:
        kept = F.when(state["room"] > 0, F.concat(state["kept"], F.array(clipped(x, state["room"])))).otherwise(state["kept"])
        return F.struct((state["room"] - F.octet_length(piece(x))).alias("room"), kept.alias("kept"))

    start = F.struct(budget.cast("bigint").alias("room"), F.slice(islands, 1, 0).alias("kept"))
    taken = F.aggregate(islands, start, lambda state, x: take(state, x), lambda state: state["kept"])
    return F.filter(taken, lambda x: x["end"] > x["start"])


def _windowed(
    docs: DataFrame,
    excerpts: DataFrame,
    key: str,
    max_bytes: int,
    window_bytes: int,
    marker_bytes: int,
    reserve: int,
    how: str,
) -> DataFrame:
    """(key, text, _kept): each document's windows as an array of its row; null if it is short or not cited.

    The distinct excerpts of a document meet its text in one lookup. Anchors, merging and budget are folds
    inside the row, so the text is moved once, however many excerpts it has.
    """
    head_bytes = int((max_bytes - marker_bytes) * C.SNAPSHOT_HEAD_SHARE)
    half = window_bytes // 2
    quotes = excerpts.groupBy(key).agg(F.collect_set("excerpt").alias("_quotes"))
    is_long = F.octet_length("text") > max_bytes
    rows = lookup_join(docs.select(key, "text"), quotes, [key], how)
    rows = rows.select(
        key,
        "text",
        "_quotes",
        F.when(is_long, F.lower("text")).alias("_low"),
        F.when(is_long, utf8_prefix(F.col("text"), head_bytes)).alias("_head"),
    ).select(
        key,
        "text",
        F.length("_head").alias("_head_end"),
        (F.lit(max_bytes - marker_bytes - reserve) - F.octet_length("_head")).alias("_budget"),
        F.transform("_quotes", lambda q: excerpt_anchor(F.col("_low"), q)).alias("_at"),
    )
    here = F.filter("_at", lambda at: (at >= 0) & (at >= F.col("_head_end")) & (F.col("_budget") > 0))
    span = lambda at: F.struct(
        F.greatest(F.col("_head_end"), at - half).alias("start"), F.least(F.length("text"), at + half).alias("end")
    )
    spans = F.sort_array(F.array_distinct(F.transform(here, span)))
    islands = rows.select(key, "text", "_budget", _merged(spans).alias("_islands"))
    kept = F.when(F.size("_islands") > 0, _affordable(F.col("_islands"), F.col("text"), F.col("_budget")))
    return islands.select(key, "text", kept.alias("_kept"))


def excerpt_windows(
    docs: DataFrame,
    excerpts: DataFrame,
    key: str,
    max_bytes: int = C.SNAPSHOT_MAX_BYTES,
    window_bytes: int = C.SNAPSHOT_WINDOW_BYTES,
    marker_bytes: int = 0,
    reserve: int = C.SNAPSHOT_MARKER_RESERVE,
) -> DataFrame:
    """(key, start, end) of the stretches kept around cited rows, within budget.

    Only documents above ``max_bytes`` have windows. Overlapping windows merge;
    they are kept in order while the byte budget lasts, and the one that
    crosses it is clipped. Offsets are 0-based characters, end exclusive.
    """
    long_docs = docs.where(F.octet_length("text") > max_bytes)
    rows = _windowed(long_docs, excerpts, key, max_bytes, window_bytes, marker_bytes, reserve, "inner")
    # The plain form would put "has a window" before the join, and with it a second run of all that finds windows.
    return rows.select(key, F.inline_outer("_kept")).where(F.col("start").isNotNull())


def snapshot_bodies(
    docs: DataFrame,
    excerpts: DataFrame,
    key: str,
    max_bytes: int = C.SNAPSHOT_MAX_BYTES,
    window_bytes: int = C.SNAPSHOT_WINDOW_BYTES,
    marker: str = "\n\n[snapshot truncated -- the hash covers the whole document]\n",
) -> DataFrame:
    """(key, body): the stored form of each document, whole when it fits.

    A long document keeps its head and the windows around cited rows, with a
    note of how many characters each gap drops.
    """
    marker_bytes = len(marker.encode())
    budget = max_bytes - marker_bytes
    joined = _windowed(
        docs, excerpts, key, max_bytes, window_bytes, marker_bytes, C.SNAPSHOT_MARKER_RESERVE, "left"
    ).withColumn("_kept", F.when(F.size("_kept") > 0, F.col("_kept")))
    text = F.col("text")
    head = utf8_prefix(text, int(budget * C.SNAPSHOT_HEAD_SHARE))

    def dropped(count: Column) -> Column:
        return F.when(count > 0, F.format_string("\n\n[%d chars dropped]\n\n", count)).otherwise(F.lit(""))

    kept = F.col("_kept")
    previous_end = lambda i: F.when(i == 0, F.length(head)).otherwise(
        F.element_at(kept, F.greatest(i, F.lit(1)))["end"]
    )
    middle = F.transform(
        kept,
        lambda w, i: F.concat(
            dropped(w["start"] - previous_end(i)),
            F.substring(text, w["start"] + 1, w["end"] - w["start"]),
        ),
    )
    tail = dropped(F.length(text) - F.element_at(kept, -1)["end"])
    windowed = F.concat(head, F.array_join(middle, ""), tail)
    body = (
        F.when(F.octet_length(text) <= max_bytes, text)
        .when(kept.isNull(), F.concat(utf8_prefix(text, budget), F.lit(marker)))
        .otherwise(F.concat(utf8_prefix(windowed, budget), F.lit(marker)))
    )
    return joined.select(key, body.alias("body"))


#: A capture's identity in 128 bits: its text with its place; the second hash starts from another seed.
CAPTURE = ["_c1", "_c2"]
PLACE_WORDS = 1 << 17  # words of 64 bits in the bitmap of places: of other places, 3 in 100 pass with 800,000 new documents


def _place() -> Column:
    return F.to_json(F.struct("retrieved_at", "url"))


def _identified(captured: DataFrame) -> DataFrame:
    return captured.withColumn("_c1", F.xxhash64("text", _place())).withColumn("_c2", F.xxhash64(F.lit(1), "text", _place()))


def document_keys(captured: DataFrame) -> DataFrame:
    """The captures without their texts, each with its hash, its key and its identity.

    Cleaning a text costs far more than moving it, so the captures are dealt out evenly first.
    """
    tasks = int(captured.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return hashed(_identified(captured).repartition(tasks, *CAPTURE)).drop("text")


def new_keys(keys: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_key, content_hash, place, identity) of the first capture of each hash that is not in the store yet."""
    first = keys.groupBy("doc_key").agg(
        F.min_by(F.struct("content_hash", _place().alias("_place"), *CAPTURE), F.struct("retrieved_at", "url", *CAPTURE)).alias("_f")
    )
    return lookup_join(first, stored.select("doc_key").distinct(), ["doc_key"], "left_anti").select("doc_key", "_f.*")


def with_texts(captured: DataFrame, fresh: DataFrame) -> DataFrame:
    """The captures that ``new_keys`` name, whole.

    Only those texts pass that lie at the place of such a capture: a bitmap of fixed size holds
    the places, and what it lets through is told apart by identity.
    """
    places = sieve(fresh.select(F.col("_place").alias("gram")), PLACE_WORDS).scalar()
    likely = captured.withColumn("_place", _place()).where(passes("_place", places, PLACE_WORDS)).drop("_place")
    picked = _identified(likely).join(fresh.drop("_place").hint("shuffle_hash"), CAPTURE)
    # The same capture may have come twice.
    return first_by(picked, CAPTURE, ["retrieved_at", "url"]).drop(*CAPTURE)


def new_documents(captured: DataFrame, stored: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Captured documents whose hash is not in the store yet, one per hash.

    ``keys`` are the captures' ``document_keys`` if they are at hand; no text is cleaned then.
    """
    return with_texts(captured, new_keys(document_keys(captured) if keys is None else keys, stored))
