"""Continuous scan, incremental discovery, drift monitor, finding rates.

Every job takes an unbounded DataFrame and a folder, and runs the work that is
available (or continuously, with another trigger). Sinks are folders keyed by
the epoch, so a repeated epoch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import canonical_id
from ..functions.text import content_hash, normalize_for_hash
from ..operators import discovery, documents
from ..operators.joins import lookup_join
from ..plans import code_scan


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of a parquet table that is one file or a folder of files."""
    folder = folder.rstrip("/")
    table = spark.read.parquet(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(table.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    single = table.inputFiles()[0].endswith(f"/{name}.parquet")
    if single:
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    return reader.parquet(f"{folder}/{name}.parquet")


def run_batches(
    stream: DataFrame, work: Callable[[DataFrame, int], None], folder: str, wait: bool = True
) -> StreamingQuery:
    query = (
        stream.writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


def run_append(stream: DataFrame, folder: str, wait: bool = True) -> StreamingQuery:
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .option("path", f"{folder}/out")
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        query.awaitTermination()
    return query


# --- continuous scan ---------------------------------------------------------


def _now(source: DataFrame | Callable[[], DataFrame]) -> DataFrame:
    """A lookup as it is now: a function is called anew in every epoch."""
    return source() if callable(source) else source


def continuous_scan(
    files: DataFrame, registry: DataFrame | Callable[[], DataFrame], folder: str, marker: str = "scan"
) -> DataFrame:
    """New source files against a registry; occurrences per epoch.

    Give a function that reads the registry to scan each epoch against the
    registry of that moment; a DataFrame stays as it was when it was made.
    """

    def epoch(batch: DataFrame, number: int) -> None:
        occ, _ = code_scan.scan(batch, _now(registry), marker)
        occ.write.mode("overwrite").parquet(f"{folder}/out/epoch={number}")

    run_batches(files, epoch, folder)
    return files.sparkSession.read.parquet(f"{folder}/out")


# --- incremental discovery ---------------------------------------------------


def _earlier(spark: SparkSession, root: str, number: int, schema: str) -> DataFrame:
    """What the epochs before this one wrote; a repeated epoch doesn't see itself."""
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, epoch int").parquet(root).where(F.col("epoch") < number).drop("epoch")


def discovery_log(
    pages: DataFrame,
    registry: DataFrame | Callable[[], DataFrame],
    queue: DataFrame | Callable[[], DataFrame],
    run_date: str,
    folder: str,
    patterns: dict[str, str] | None = None,
) -> DataFrame:
    """New candidates, each identifier once over all epochs, as in the batch form.

    The log of what was proposed is the memory: an epoch proposes what is neither
    in the registry or queue nor in an earlier epoch, however long ago that was,
    and overwrites its own folder when it is run again. The first epoch that sees
    an identifier gives its row. No watermark and no state store is needed; the
    memory holds one row per identifier.
    """
    root = f"{folder}/out"

    def epoch(batch: DataFrame, number: int) -> None:
        found = discovery.discover(batch, _now(registry), _now(queue), run_date, patterns)
        found = found.withColumn("canon", canonical_id(F.col("deprecated")))
        known = _earlier(batch.sparkSession, root, number, "canon string")
        lookup_join(found, known, ["canon"], "left_anti").write.mode("overwrite").parquet(f"{root}/epoch={number}")

    run_batches(pages, epoch, folder)
    return pages.sparkSession.read.parquet(root)


def discovery_stream(
    pages: DataFrame,
    registry: DataFrame,
    queue: DataFrame,
    run_date: str,
    patterns: dict[str, str] | None = None,
    event_time: str = "retrieved_at",
    watermark: str = "30 days",
) -> DataFrame:
    """Each new identifier once within the watermark, as an unbounded DataFrame.

    The watermark bounds the state and the memory: an id that comes back later
    is proposed again. ``discovery_log`` remembers for good.
    """
    timed = pages.withWatermark(event_time, watermark)
    fresh = discovery.propose(discovery.readable_rows(timed, patterns), run_date)
    fresh = fresh.join(discovery.known_ids(registry, queue), "canon", "left_anti")
    return fresh.dropDuplicatesWithinWatermark(["canon"]).select(
        "canon", "candidate_id", "provider", "deprecated", "replacement", event_time
    )


# --- drift monitor -----------------------------------------------------------

COMPACT_EVERY = 16


def drift_monitor(captures: DataFrame, folder: str) -> DataFrame:
    """Captures whose noise-free hash differs from the one before it, per url.

    Files may come in any order: the rows at the end are those of the batch form.
    The log keeps (url, time, hash) of every capture, in small deltas with a full
    copy every few epochs. An epoch reads the urls it touches and lags old and new
    captures together, in order of time and then of their hashes; it writes a verdict for each new capture and, where a late
    one splits an interval, a new verdict for the capture behind it. The latest
    verdict on a capture counts. A url with much of a batch is split like in the
    batch form.
    """
    spark = captures.sparkSession
    state = "url string, retrieved_at string, content_hash string"

    def log_paths(number: int) -> list[str]:
        base = (number // COMPACT_EVERY) * COMPACT_EVERY
        base = base - COMPACT_EVERY if base == number else base
        first = max(base, 0)
        return [f"{folder}/state/epoch={n}" for n in range(first, number)]

    def known_before(number: int) -> DataFrame:
        paths = log_paths(number)
        return spark.read.schema(state).parquet(*paths) if paths else spark.createDataFrame([], state)

    def epoch(batch: DataFrame, number: int) -> None:
        fresh = code_scan.durable(
            batch.select(
                "url", "retrieved_at", content_hash(normalize_for_hash(F.col("text"))).alias("content_hash")
            ).distinct(),
            "captures",
        )
        known = known_before(number)
        # A capture that comes again, with the same url, time and hash, is known and tells nothing new.
        fresh = fresh.join(known, fresh.columns, "left_anti")
        touched = known.join(fresh.select("url").distinct(), "url", "left_semi")
        both = touched.withColumn("old", F.lit(True)).unionByName(fresh.withColumn("old", F.lit(False)))
        lagged = documents.ordered_lag(
            both.withColumn("_now", F.struct("content_hash", "old")),
            "url", ["retrieved_at", "content_hash"], "_now", "_before", F.substring("retrieved_at", 1, 10),
        )
        lagged.where(~F.col("old") | ~F.col("_before.old")).select(
            "url", "retrieved_at", "content_hash", F.col("_before.content_hash").alias("previous_hash")
        ).write.mode("overwrite").parquet(f"{folder}/out/epoch={number}")
        full = number > 0 and number % COMPACT_EVERY == 0
        (known.unionByName(fresh) if full else fresh).write.mode("overwrite").parquet(f"{folder}/state/epoch={number}")

    run_batches(captures, epoch, folder)
    return drifted(spark, folder)


def drifted(spark: SparkSession, folder: str) -> DataFrame:
    """(url, retrieved_at, content_hash, previous_hash) of changed captures, by the latest verdicts."""
    verdicts = spark.read.schema(
        "url string, retrieved_at string, content_hash string, previous_hash string, epoch int"
    ).parquet(f"{folder}/out")
    latest = verdicts.groupBy("url", "retrieved_at", "content_hash").agg(
        F.max_by(F.struct("previous_hash"), "epoch").alias("_v")
    )
    return latest.select("url", "retrieved_at", "content_hash", "_v.previous_hash").where(
        F.col("content_hash") != F.col("previous_hash")
    )


# --- finding rates -----------------------------------------------------------


def rate_windows(
    findings: DataFrame,
    size: str = "1 hour",
    slide: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Findings per tier in tumbling or sliding windows; late rows are dropped."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    timed = findings.withColumn("ts", F.col("ts").cast("timestamp"))
    if findings.isStreaming:
        timed = timed.withWatermark("ts", delay)
    return timed.groupBy(window, "tier").agg(F.count(F.lit(1)).alias("findings")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "tier", "findings"
    )


def rate_sessions(findings: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Bursts of findings per repo and tier separated by quiet time.

    A finding at most ``gap`` after the one before it belongs to its burst.
    """
    timed = findings.withColumn("ts", F.col("ts").cast("timestamp"))
    if findings.isStreaming:
        timed = timed.withWatermark("ts", delay)
    # The span comes from the rows. A filter on the key itself would be moved below the
    # merging of sessions, where it cuts off the rows that a session begins with.
    return timed.groupBy(F.session_window("ts", gap), "repo", "tier").agg(
        F.min("ts").alias("window_start"),
        (F.max("ts") + F.expr(f"interval {gap}")).alias("window_end"),
        F.count(F.lit(1)).alias("findings"),
    ).select("window_start", "window_end", "repo", "tier", "findings")


def last_watermark(query: StreamingQuery) -> str:
    """Event time up to which the windows of a query have been emitted."""
    marks = [p.eventTime["watermark"] for p in query.recentProgress if "watermark" in (p.eventTime or {})]
    return max(marks) if marks else "1970-01-01T00:00:00.000Z"


def with_open_windows(emitted: DataFrame, query: StreamingQuery, batch: DataFrame) -> DataFrame:
    """Emitted windows and those that were still open when a finite input ended.

    ``batch`` is the same aggregation over the input as a table. It adds only
    windows that end after the last watermark, so nothing is counted twice. For
    windows of fixed length the condition reaches the rows before they are
    grouped; a session is judged by its end and keeps all its rows. ``open`` tells the two apart. Rows that came too late for a window
    already emitted stay out of it. An open session comes from the whole input:
    a row that the stream dropped as late counts in it if the session reaches it.
    """
    mark = F.lit(last_watermark(query)).cast("timestamp")
    still = batch.where(F.col("window_end") > mark)
    return emitted.withColumn("open", F.lit(False)).unionByName(still.withColumn("open", F.lit(True)))
