"""Target-distribution importance resampling: documents that look like a target text, drawn without replacement.

Every feature (a run of words) falls into one of a fixed number of buckets.  Bucket counts over the whole
corpus and over the whole target give each bucket a gain; a document's weight is the mean gain of its
features, and a draw adds Gumbel noise made from its id.  The best scores are found by a weighted median of
medians: each round every partition names the median of what it still holds and how much that is, the
median of those medians (weighted by the amounts) becomes the pivot, and one count tells which side goes.
No partition's rows leave it before the exact cutoff is known.

Defined results.  A null or empty text has no features, weight 0, and is never drawn while ``least`` is
positive.  A null doc_id takes part with the noise of ``<seed>:`` and stands behind every other id among
equal scores.  Rows that share a doc_id are drawn one by one; among equal (score, doc_id) the text's checksum
decides.  An empty target or corpus gives the gains that the formula has for zero counts.  Other columns
of the tables are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Remembered, alnum_words, arrow, durable, ship, slices

#: Number of buckets; gains travel to the tasks as one array of that length.
BUCKETS = 10_000
#: The search narrows the table that it reads whenever so small a share of it is left.
NARROWED = 8

SCORED = pa.schema(
    [("doc_id", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64()), ("n_words", pa.int64()), ("tie", pa.int64())]
)


def _buckets(text: str | None, runs: int, known: Remembered) -> tuple[np.ndarray, int]:
    """(bucket of every feature of the text, its number of words)."""
    words = alnum_words(text)
    features = list(words)
    for n in range(2, runs + 1):
        features += [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return np.fromiter(map(known.__getitem__, features), np.int64, len(features)), len(words)


def bucket_counts(table: DataFrame, runs: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: counted inside the tasks, summed by bucket."""
    ship(table.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda f: zlib.crc32(f) % buckets)
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held += np.bincount(_buckets(text, runs, known)[0], minlength=buckets)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(held[full])], names=["bucket", "n"])

    parts = table.select("text").mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    # At most one row per bucket.
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandfold log ratio of the smoothed bucket shares, target over corpus, floored."""
    size, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = ((target + 1.0) * (s_all + size)) / ((corpus + 1.0) * (t_all + size))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def noise(seed: str, doc_id: int | None) -> int:
    """A thousandfold Gumbel variate of the id, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: str, runs: int = 1) -> DataFrame:
    """One row per document: its id, n_features, weight, score, n_words and a checksum of the text."""
    ship(docs.sparkSession)
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(lambda f: zlib.crc32(f) % buckets)
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                rows = []
                for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                    found, n_words = _buckets(text, runs, known)
                    weight = int(gain[found].sum()) // len(found) if len(found) else 0
                    rows.append((doc_id, len(found), weight, weight + noise(seed, doc_id), n_words, zlib.crc32((text or "").encode())))
                yield arrow(dict(zip(SCORED.names, map(list, zip(*rows, strict=True)), strict=True)), SCORED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_features long, weight long, score long, n_words long, tie long"
    )


#: Order of the draw: falling score, then rising doc_id (null last), checksum and place.
KEY = ["k0", "k1", "k2", "k3", "k4"]


def _keyed(rows: DataFrame) -> DataFrame:
    keys = (-F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("tie"), F.monotonically_increasing_id())
    return rows.select("*", *(k.alias(n) for n, k in zip(KEY, keys, strict=True)))


def _below(bound: tuple[int, ...], equal: bool = False) -> F.Column:
    """Whether a row's key comes before the bound, or is the bound where asked."""
    out = F.lit(equal)
    for name, value in reversed(list(zip(KEY, bound, strict=True))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def _up_to(keys: np.ndarray, bound: tuple[int, ...]) -> np.ndarray:
    """Which columns of the keys come before the bound or are the bound."""
    out = np.ones(keys.shape[1], bool)
    for row, value in reversed(list(zip(keys, bound, strict=True))):
        out = (row < value) | ((row == value) & out)
    return out


def _medians(rows: DataFrame, pivot: tuple[int, ...] | None = None) -> tuple[list, list]:
    """(median key, number of keys) of every partition, on this side of the pivot and beyond it.

    One job and at most two rows per partition; without a pivot all keys are on this side.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Forty bytes a row; a partition of a narrow table holds them all.
        parts = [np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if b.num_rows]
        if not parts:
            return
        keys = np.concatenate(parts, axis=1)
        near = _up_to(keys, pivot) if pivot else np.ones(keys.shape[1], bool)
        for beyond, side in ((0, keys[:, near]), (1, keys[:, ~near])):
            if size := side.shape[1]:
                middle = side[:, np.lexsort(side[::-1])[(size - 1) // 2]]
                yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in (*middle, size, beyond)], names=[*KEY, "n", "beyond"])

    found = rows.select(*KEY).mapInArrow(run, ", ".join(f"{k} long" for k in [*KEY, "n", "beyond"])).collect()
    near, beyond = ([(tuple(r)[: len(KEY)], r["n"]) for r in found if r["beyond"] == side] for side in (0, 1))
    return near, beyond


def weighted_median(medians: list[tuple[tuple[int, ...], int]]) -> tuple[int, ...]:
    """The first median whose partitions, and those before it, hold half of all keys."""
    half, so_far = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        so_far += n
        if so_far >= half:
            return key
    raise ValueError("no keys")


def cutoff(rows: DataFrame, k: int) -> tuple[int, ...] | None:
    """Key of the k-th row in order of the key (distinct by its last part); None if there is none.

    With the pivot of a round about a quarter of the keys or more lie on either side of it, so each round
    throws away that share of what is left, whatever the keys and their distribution over partitions.
    """
    left = rows.select(*KEY)
    medians, _ = _medians(left)
    total = read = sum(n for _, n in medians)
    if not 0 < k <= total:
        return None
    while True:
        pivot = weighted_median(medians)
        near, beyond = _medians(left, pivot)
        up_to = sum(n for _, n in near)
        if k == up_to:
            return pivot
        if k < up_to:
            left, total, medians = left.where(_below(pivot, equal=True)), up_to, near
        else:
            left, total, k, medians = left.where(~_below(pivot, equal=True)), total - up_to, k - up_to, beyond
        if total * NARROWED <= read:
            left, read = durable(left, "resample-left"), total


def draw(spark: SparkSession, scored: DataFrame, k: int) -> DataFrame:
    """The scored rows with ``rank``: 1 .. k in order of the key, null for the others.

    ``scored`` has the key columns and ``able`` (who may be drawn) and has been written.
    """
    able = scored.where("able")
    last = cutoff(able, k)
    plain = [c for c in scored.columns if c not in (*KEY, "able")]
    if last is None:
        return scored.select(*plain, F.lit(None).cast("long").alias("rank"))
    chosen = F.col("able") & _below(last, equal=True)
    # The winners alone are sorted: by range, so that places inside a range and sizes of ranges give ranks.
    ranges = scored.where(chosen).repartitionByRange(*KEY).withColumn("_range", F.spark_partition_id())
    ranges = durable(ranges, "resample-winners")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*KEY))
    ranked = ranges.withColumn("_place", place).join(before, "_range").select(*plain, (F.col("before") + F.col("_place")).alias("rank"))
    return ranked.union(scored.where(~chosen).select(*plain, F.lit(None).cast("long")))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, seed: str = "2024", runs: int = 1, least: int = 20, buckets: int = BUCKETS
) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and rank of the draw (null: not drawn).

    ``percent`` of the documents with at least ``least`` words are drawn, rounded down; ``runs`` is the
    longest run of words that is a feature.
    """
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = _keyed(scores(docs, gain, seed, runs)).withColumn("able", F.col("n_words") >= least)
    # Written once: the place of a row is part of its key.
    scored = durable(rows.drop("n_words", "tie"), "resample-scored")
    k = scored.where("able").count() * percent // 100
    return draw(docs.sparkSession, scored, k)


def select(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns; rows that share a doc_id stay if one of them is drawn."""
    drawn = resample(docs, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    names = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.struct(*names).alias("_row"))
    return packed.join(drawn, F.col("_id").eqNullSafe(F.col("_drawn")), "left_semi").select("_row.*")


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
