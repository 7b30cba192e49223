"""MinHash near-deduplication with SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct runs of ``width`` words (A-Z lowered), or its whole sequence
where it has fewer words, but not none; shingles are told apart by 64-bit hashes.  Documents are
linked if intersection / union reaches the threshold.  SuperMinHash lets every shingle walk through
one random permutation of the registers, rank by rank, and stops once all registers are filled;
``REGISTERS`` of them in bands of ``ROWS`` miss a pair at 0.8 about once in twenty million.

Equal sets are collapsed first, so groups of copies cost nothing beyond.  In each bucket the members
are then verified against a leader, components are formed, and further leaders follow while they
settle most of what is open; at last the pairs of a bucket whose members still are in different
components are compared: in small buckets pair by pair, in large ones block by block, by products of
incidence matrices.  So no large bucket is expanded into its pairs.  Every candidate pair between
different components whose sizes leave room for the threshold is decided on full sets.

Null and empty texts have empty sets and are linked with nothing.  Rows that repeat a doc_id are one
document for links and components.  Rows without a doc_id have a null component and are linked with
nothing.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHash, arrow, durable, lower_words, mix, ship, slices, tidied, window_hashes
from .components import UnionFind, components

REGISTERS, ROWS = 128, 4
#: Least similarity, in per cent.
THRESHOLD = 80
#: Shingles whose signatures are computed together.
STEP = 1 << 15
#: Buckets of at most so many members are joined with themselves; larger ones are compared in blocks.
SMALL = 64
BLOCK = 1024
#: Shared shingles that one matrix product of a block covers.
COLUMNS = 4096
#: doc_ids that may be broadcast to pick texts (8 bytes each).
PICKED = 200_000
#: Further leaders follow while buckets hold more open pairs than this many per document.
OPEN = 1


def shingles(words: list[bytes], width: int, hashes: WordHash) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(window_hashes(hashes.of(words), min(width, len(words))))


def signatures(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """One row of registers per non-empty set; equal registers mean the same shingle at the same rank."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), registers), np.uint64(0xFFFFFFFFFFFFFFFF))
    owner = np.repeat(np.arange(len(sets)), sizes)
    codes = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    places = None  # permutations, of shingles whose documents still have empty registers
    for rank in range(registers):
        draw = mix(codes + np.uint64(rank * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        other = rank + ((draw & np.uint64(0xFFFFFF)) % np.uint64(registers - rank)).astype(np.int64)
        rows = np.arange(len(codes))
        if places is None:
            at = other
        else:
            at = places[rows, other].astype(np.int64)
            places[rows, other] = places[:, rank]
            places[:, rank] = at
        # A register that an earlier rank has filled can't be lowered by a later one.
        flat = owner * registers + at
        free = out.reshape(-1)[flat] >= np.uint64(rank) << np.uint64(56)
        np.minimum.at(out.reshape(-1), flat[free], (np.uint64(rank) << np.uint64(56)) | (draw[free] >> np.uint64(8)))
        unfilled = (out == np.uint64(0xFFFFFFFFFFFFFFFF)).any(axis=1)
        more = unfilled[owner]
        if not more.any():
            break
        if places is None:
            codes, owner, first = codes[more], owner[more], other[more]
            places = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.uint16), (len(codes), 1))
            rows = np.arange(len(codes))
            places[rows, first], places[:, 0] = 0, first
        elif more.sum() < 0.7 * len(more):
            codes, owner, places = codes[more], owner[more], places[more]
    return out


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Keys of the bands; those of different bands differ."""
    parts = signature.reshape(len(signature), signature.shape[1] // rows, rows)
    out = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out = mix(out ^ parts[:, :, k])
    return out.view(np.int64)


PROFILE = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("bands", pa.list_(pa.int64()))]
)


def profiles(docs: DataFrame, width: int) -> DataFrame:
    """Per document: size and two fingerprints of its set, and band keys."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()

        def made(ids: list, sets: list[np.ndarray]) -> pa.RecordBatch:
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = bands(signatures([sets[k] for k in full]))
            where = dict(zip(full, range(len(full)), strict=True))
            salt = np.uint64(0x51ED270B0A1F39C1)
            return arrow(
                {
                    "doc_id": ids, "n": [len(s) for s in sets],
                    "f1": np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                    "f2": np.array([mix(s ^ salt).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64),
                    "bands": [keys[where[k]] if k in where else [] for k in range(len(sets))],
                },
                PROFILE,
            )

        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            ids, sets, total = [], [], 0
            for doc_id, text in zip(doc_ids, texts, strict=True):
                ids.append(doc_id)
                sets.append(shingles(lower_words(text), width, hashes))
                total += len(sets[-1])
                if total > STEP:
                    yield made(ids, sets)
                    ids, sets, total = [], [], 0
            if ids:
                yield made(ids, sets)

    return docs.select("doc_id", "text").mapInArrow(tidied(run), "doc_id long, n long, f1 long, f2 long, bands array<long>")


def _sized(a: str, b: str, threshold: int) -> F.Column:
    """Sizes that leave room for the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * threshold


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(rep, shingles): the packed full sets of the documents with these doc_ids."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                found = [shingles(lower_words(t), width, hashes).tobytes() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b], pa.int64()), pa.array(found, pa.binary())], names=["rep", "shingles"])

    ids = durable(ids, "near-ids")
    if ids.count() <= PICKED:
        ids = F.broadcast(ids)
    return durable(docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(tidied(sets), "rep long, shingles binary"), "near-sets")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                common = int((x[at] == y).sum())
                keep.append(100 * common >= threshold * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    picked = _sets(docs, ids, width)
    one = picked.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = picked.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "sa", "sb").mapInArrow(tidied(check), "a long, b long").distinct()


def close_pairs(x: list[np.ndarray], y: list[np.ndarray], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of the sets that reach the threshold; intersections come from matrix products."""
    sizes = [np.array([len(s) for s in side], np.int64) for side in (x, y)]
    codes, column, count = np.unique(np.concatenate([*x, *y]), return_inverse=True, return_counts=True)
    # A shingle that one set alone holds is in no intersection.
    shared = np.cumsum(count > 1) - 1
    column = np.where(count[column] > 1, shared[column], -1)
    row = np.repeat(np.arange(len(x) + len(y)), np.concatenate(sizes))
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(x), len(y)), np.float32)
    for base in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (base, base + COLUMNS)))
        held = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        held[row[part], column[part] - base] = 1
        common += held[: len(x)] @ held[len(x) :].T
    both = sizes[0][:, None] + sizes[1][None, :]
    return np.nonzero((100 + threshold) * common.astype(np.int64) >= threshold * both)


def _blocked(large: DataFrame, docs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Links that join components within the large buckets (key, rep, label), by comparing full sets in blocks.

    Buckets that share documents are taken together, so a pair is compared once however many buckets
    it shares.  A block hands on no more links than it has documents.
    """
    least = large.groupBy("key").agg(F.min("rep").alias("a"))
    near = components(large.join(least, "key").select("a", F.col("rep").alias("b")))
    placed = large.select("rep", "label").distinct().join(near.select(F.col("node").alias("rep"), F.col("component").alias("crowd")), "rep")
    sized = placed.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = durable(placed.join(sized, "crowd").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), "near-crowds")
    sets = _sets(docs, placed.select(F.col("rep").alias("doc_id")).distinct(), width)
    spread = placed.join(sets, "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "crowd", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label", "shingles"
    )

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        x, y = (group[group["own"] == k] for k in (i, j))
        places = close_pairs(*([np.frombuffer(s, np.uint64) for s in side["shingles"]] for side in (x, y)), threshold)
        (rx, lx), (ry, ly) = ((side["rep"].to_numpy()[p], side["label"].to_numpy()[p]) for side, p in zip((x, y), places, strict=True))
        joined, out = UnionFind(), []
        for a, b, p, q in zip(*(v[lx != ly].tolist() for v in (rx, ry, lx, ly)), strict=True):
            if joined.find(p) != joined.find(q):
                joined.union(p, q)
                out.append((min(a, b), max(a, b)))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return spread.groupBy("crowd", "i", "j").applyInPandas(compare, "a long, b long")


def grouped(docs: DataFrame, width: int = 4, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(profiles of all rows, (doc_id, component_id) of all documents with a set)."""
    known = durable(profiles(docs, width), "near-profiles")
    full = known.where("n > 0 and doc_id is not null")
    # Which of several texts of one doc_id has been hashed doesn't matter: all of them are its nodes.
    reps = durable(
        full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")),
        "near-reps",
    )
    links = full.select("n", "f1", "f2", F.col("doc_id").alias("b")).join(reps.select("n", "f1", "f2", F.col("rep").alias("a")), ["n", "f1", "f2"]).select("a", "b")
    spread = reps.select("rep", "n", F.explode("bands").alias("key"))
    buckets = spread.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rep", "n")).alias("leader")).where("size > 1")
    members = durable(spread.join(buckets, "key"), "near-members")
    pairs = members.where((F.col("leader.rep") != F.col("rep")) & _sized("leader.n", "n", threshold)).select(F.col("leader.rep").alias("a"), F.col("rep").alias("b")).distinct()
    found = durable(_verified(durable(pairs, "near-pairs"), docs, width, threshold), "near-links")
    labels, total, turn, before = durable(components(found), "near-labels"), reps.count(), 0, float("inf")
    while True:
        turn += 1
        labelled = members.select("key", "rep", "n", "size").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
        # Pairs of a bucket between different components: all pairs less those within each.
        inside = labelled.groupBy("key", "label").agg(F.count("*").alias("c"))
        rest = inside.groupBy("key").agg(F.count("*").alias("labels"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q")).where("labels > 1")
        open_ = durable(labelled.join(rest.select("key", ((F.col("s") * F.col("s") - F.col("q")) / 2).alias("open")), "key"), "near-open")
        crossing = open_.select("key", "open").distinct().agg(F.sum("open")).first()[0] or 0
        # A leader that leaves most of the open pairs open is not followed by another.
        if crossing <= OPEN * total or crossing > before / 2:
            break
        before = crossing
        # Another leader for each bucket, a different one in each turn.
        chosen = open_.groupBy("key").agg(F.min_by(F.struct("rep", "n", "label"), F.xxhash64("rep", F.lit(turn))).alias("leader"))
        more = open_.join(chosen, "key").where((F.col("leader.label") != F.col("label")) & _sized("leader.n", "n", threshold))
        pairs = more.select(F.least("leader.rep", "rep").alias("a"), F.greatest("leader.rep", "rep").alias("b")).distinct()
        found = found.union(durable(_verified(durable(pairs, "near-pairs"), docs, width, threshold), "near-links"))
        labels = durable(components(found), "near-labels")
    small, large = open_.where(F.col("size") <= SMALL), open_.where(F.col("size") > SMALL)
    x, y = (small.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("rep", "n", "label"))) for k in ("a", "b"))
    pairs = x.join(y, "key").where((F.col("rep_a") < F.col("rep_b")) & (F.col("label_a") != F.col("label_b")) & _sized("n_a", "n_b", threshold))
    pairs = durable(pairs.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct(), "near-pairs")
    found = found.union(durable(_verified(pairs, docs, width, threshold), "near-links"))
    if large.limit(1).count():
        found = found.union(durable(_blocked(large, docs, width, threshold), "near-links"))
    # Copies hang on their representative; one more pass joins them to its component.
    return known, components(found.union(links.where("a <> b")))


def report(docs: DataFrame, width: int = 4, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    known, groups = grouped(docs, width, threshold)
    labelled = known.select("doc_id", F.col("n").alias("n_shingles")).join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return labelled.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def keep_one(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents without those that a smaller doc_id of their group stands for.

    Of rows that repeat a doc_id one stays; rows without a doc_id all stay.
    """
    known, groups = grouped(docs, width, threshold)
    gone = groups.where("node <> component").select(F.col("node").alias("doc_id"))
    left = docs.join(gone, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    repeated = known.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not repeated.limit(1).count():
        return left
    once = left.join(repeated, "doc_id", "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns)).dropDuplicates(["doc_id"])
    return left.join(repeated, "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns)).union(once)
