"""Substring deduplication by prefix-partitioned suffix trees.

A window is a run of ``WINDOW`` words; a word goes if a window over it also starts anywhere else.
Suffixes are grouped by a short run of words: in every window the one of least hash, the leftmost
of equals, so equal windows meet in one group and most suffixes, whose run occurs once, go no
further.  Each group is a subtree of bounded size.  Its nodes are named level by level for depths
1, 2, 4 .. WINDOW; a node at full depth with two leaves is a repeat, and its leaves are the
windows to remove.  Runs so frequent that their group would not fit (``HOT``) get longer prefixes:
there the prefix is the whole window, whose group is one node, counted with partial aggregation.

Texts are told apart by 96 bits of hash; equal texts are one text with a count, so groups of copies
cost nothing beyond their first member.  Words are runs of characters other than space and
\\x09-\\x0D, unchanged.

Null and empty texts have no words and nothing is removed; texts shorter than a window stay whole.
A repeated row repeats all its windows.  doc_id is carried along only: it may be null or repeated.
Texts are read whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, arrow, durable, mix, ship, slices, window_hashes, words

WINDOW = 35
#: Words of the run by which suffixes are grouped.
PREFIX = 8
#: Segments that a group may have before its prefix is lengthened to the whole window: with some
#: 50 words each, what one Python worker names in about 200 MB.
HOT = 32_768
#: Words that are named together.
STEP = 300_000
#: Texts that may be picked by a broadcast of their hashes (12 bytes each).
PICKED = 400_000

_LOW = np.uint64((1 << 24) - 1)
_CHUNK = 1 << 22


def anchors(codes: np.ndarray, window: int = WINDOW, prefix: int = PREFIX) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of ``prefix`` words, place of the chosen run of every window)."""
    runs = window_hashes(codes, prefix)
    n = len(codes) - window + 1
    if n <= 0:
        return runs, np.empty(0, np.int64)
    width = window - prefix + 1
    out = []
    for base in range(0, n, _CHUNK):
        part = runs[base : base + _CHUNK + width - 1]
        # The place in the low bits makes the leftmost of equal hashes the least.
        least = (part & ~_LOW) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size < width:
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        out.append((least & _LOW).astype(np.int64) + base)
    return runs, np.concatenate(out)


def _digest(parts: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(parts)).hexdigest()


INFO = pa.schema(
    [
        ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()),
        ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())),
    ]
)


def _info(docs: DataFrame) -> DataFrame:
    """Per row: hashes of the text, number of words, digest of all of them, and its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            doc_id, h1, h2, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                found = [words(t) for t in texts[a:b]]
                keys, places = [], []
                for w in found:
                    chosen = runs = np.empty(0, np.int64)
                    if len(w) >= WINDOW:
                        runs, chosen = anchors(hashes.of(w))
                        chosen = chosen[np.concatenate(([True], chosen[1:] != chosen[:-1]))]
                        runs = runs[chosen].view(np.int64)
                    keys.append(runs)
                    places.append(chosen)
                yield arrow(
                    {
                        "doc_id": doc_id[a:b], "h1": h1[a:b], "h2": h2[a:b], "n_words": list(map(len, found)),
                        "sha": list(map(_digest, found)), "keys": keys, "places": places,
                    },
                    INFO,
                )

    return docs.select("doc_id", "h1", "h2", "text").mapInArrow(
        run, "doc_id long, h1 long, h2 long, n_words long, sha string, keys array<long>, places array<int>"
    )


SEGMENT = pa.schema([("key", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("segment", pa.binary()), ("w1", pa.int64()), ("w2", pa.int64())])


def _segments(chosen: DataFrame) -> DataFrame:
    """From (h1, h2, text, at: places and whether they are hot): the words around each anchor, or single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, salt = WordHash(), np.uint64(0x2545F4914F6CDD1D)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return arrow(dict(zip(SEGMENT.names, zip(*rows, strict=True), strict=True)), SEGMENT)

        for batch in batches:
            rows, size = [], 0
            for h1, h2, text, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = words(text)
                codes = hashes.of(found)
                runs, place = anchors(codes)
                hot_at = {x["place"]: x["hot"] for x in at}
                bounds = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1], [True])))
                w1 = w2 = None
                for first, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    hot = hot_at.get(int(place[first]))
                    if hot is None:
                        continue
                    key = int(runs[place[first]].view(np.int64))
                    if hot:
                        if w1 is None:
                            w1, w2 = (window_hashes(c, WINDOW).view(np.int64) for c in (codes, mix(codes ^ salt)))
                        rows += [(key, h1, h2, i, None, int(w1[i]), int(w2[i])) for i in range(first, end)]
                        size += 40 * (end - first)
                    else:
                        rows.append((key, h1, h2, first, b" ".join(found[first : end + WINDOW - 1]), None, None))
                        size += len(rows[-1][4])
                    if size > 4_000_000:
                        yield made(rows)
                        rows, size = [], 0
            if rows:
                yield made(rows)

    return chosen.select("h1", "h2", "text", "at").mapInArrow(run, "key long, h1 long, h2 long, start int, segment binary, w1 long, w2 long")


def repeated_windows(segments: list[list[bytes]], window: int = WINDOW) -> list[np.ndarray]:
    """Per segment, which of its windows occur more than once in all the segments: leaves of deep nodes."""
    code: dict[bytes, int] = {}
    sizes = np.array([len(s) for s in segments], np.int64)
    name = np.array([code.setdefault(w, len(code)) for s in segments for w in s], np.int64)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(name))
    depth = 1
    while depth < window:
        # The node of a longer prefix is the pair of the nodes of its two halves, which may overlap.
        step = min(depth, window - depth)
        inside = at + depth + step <= end
        here = at[inside]
        pair = name[here] * (len(name) + 1) + name[here + step]
        named = np.full(len(name), -1, np.int64)
        named[here] = np.unique(pair, return_inverse=True)[1]
        name, depth = named, depth + step
    leaves = np.bincount(name[name >= 0], minlength=1)
    deep = np.zeros(len(name), bool)
    deep[name >= 0] = leaves[name[name >= 0]] > 1
    starts = np.cumsum(sizes) - sizes
    return [deep[a : a + max(0, n - window + 1)] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]


RANGE = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])


def _subtrees(segments: DataFrame) -> DataFrame:
    """(h1, h2, start, end): ranges of words under repeated windows, from groups of equal key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        distinct: dict[bytes, int] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            # Equal segments are one branch of the tree; where it has several leaves, all their windows repeat.
            out, leaves = [], np.bincount([k for *_, k in held])
            deep_of = repeated_windows([s.split() for s in distinct])
            for _, h1, h2, start, k in held:
                deep = np.ones_like(deep_of[k]) if leaves[k] > 1 else deep_of[k]
                edge = np.diff(np.concatenate(([0], deep.astype(np.int8), [0])))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    out.append((h1, h2, start + a, start + b + WINDOW - 1))
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            return arrow(dict(zip(RANGE.names, columns, strict=True)), RANGE)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # Rows come sorted by key: a group is complete when the key changes.
                if size > STEP and held[-1][0] != row[0]:
                    yield flush()
                    held, distinct, size = [], {}, 0
                before = len(distinct)
                held.append((*row[:4], distinct.setdefault(row[4], before)))
                size += 1 if len(distinct) == before else row[4].count(b" ") + 1
        if held:
            yield flush()

    ordered = segments.select("key", "h1", "h2", "start", "segment").repartition("key").sortWithinPartitions("key")
    return ordered.mapInArrow(run, "h1 long, h2 long, start int, end int")


def _ranges(docs: DataFrame, info: DataFrame) -> DataFrame:
    """(h1, h2, start, end) of the repeated windows of distinct texts."""
    every = info.select("h1", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("h1", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    seen = F.xxhash64("h1", "place")
    counted = every.groupBy("key").agg(F.min(seen).alias("x"), F.max(seen).alias("y"), F.count("*").alias("c"))
    again = counted.where("x <> y").select("key", (F.col("c") > HOT).alias("hot"))
    at = every.join(again, "key").groupBy("h1").agg(F.collect_set(F.struct("place", "hot")).alias("at"))
    at = durable(at, "substring-places")
    ids = at.select("h1")
    picked = docs.join(F.broadcast(ids) if at.count() <= PICKED else ids, "h1", "left_semi")
    single = picked.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    segments = durable(_segments(single.join(at, "h1")), "substring-segments")
    whole = segments.where("segment is null")
    seen = F.xxhash64("h1", "h2", "start")
    nodes = whole.groupBy("w1", "w2").agg(F.min(seen).alias("x"), F.max(seen).alias("y")).where("x <> y").select("w1", "w2")
    hot = whole.join(nodes, ["w1", "w2"]).select("h1", "h2", "start", (F.col("start") + WINDOW).alias("end"))
    return _subtrees(segments.where("segment is not null")).union(hot)


PART = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def kept_words(found: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    gone = np.zeros(len(found), bool)
    for a, b in ranges:
        gone[a:b] = True
    return [w for w, g in zip(found, gone.tolist(), strict=True) if not g]


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.crc32(text).alias("h2"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(hashed documents, their info, texts that occur again, partly repeated texts with ranges)."""
    ship(docs.sparkSession)
    hashed = _hashed(docs)
    info = durable(_info(hashed), "substring-info")
    copies = info.where(F.col("n_words") >= WINDOW).groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    ranges = _ranges(hashed, info).join(copies, ["h1", "h2"], "left_anti")
    spans = durable(ranges.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "substring-ranges")
    return hashed, info, copies, spans


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    hashed, info, copies, spans = _found(docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, texts, all_spans = (c.to_pylist() for c in batch.columns)
            found = [words(t) for t in texts]
            kept = [kept_words(w, [(s["start"], s["end"]) for s in sp]) for w, sp in zip(found, all_spans, strict=True)]
            yield arrow({"h1": h1, "h2": h2, "n_removed": [len(w) - len(k) for w, k in zip(found, kept, strict=True)], "kept": list(map(_digest, kept))}, PART)

    ids = spans.select("h1", "h2")
    few = spans.count() <= PICKED
    texts = hashed.join(F.broadcast(ids) if few else ids, ["h1", "h2"], "left_semi").select("h1", "h2", "text")
    parts = texts.join(spans, ["h1", "h2"]).select("h1", "h2", "text", "spans").mapInArrow(cut, "h1 long, h2 long, n_removed long, kept string")
    joined = info.select("doc_id", "h1", "h2", "n_words", "sha").join(copies.withColumn("copied", F.lit(True)), ["h1", "h2"], "left").join(parts, ["h1", "h2"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "doc_id", "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def dedup(docs: DataFrame) -> DataFrame:
    """The documents (columns doc_id, text and any others) with repeated words gone and the others joined by one space."""
    _, _, copies, spans = _found(docs)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64(text).alias("h1"), F.crc32(text).alias("h2"))
    joined = keyed.join(copies.withColumn("copied", F.lit(True)), ["h1", "h2"], "left").join(spans, ["h1", "h2"], "left").select("row", "copied", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, copied, all_spans = (c.to_pylist() for c in batch.columns)
            out = []
            for row, whole, sp in zip(rows, copied, all_spans, strict=True):
                found = words(row["text"])
                kept = [] if whole else kept_words(found, [(s["start"], s["end"]) for s in sp or []])
                out.append(None if row["text"] is None else b" ".join(kept).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["row", "kept"])

    cut_rows = joined.mapInArrow(cut, joined.select("row").withColumn("kept", F.lit(None).cast("string")).schema)
    return cut_rows.select(*(F.col("kept").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
