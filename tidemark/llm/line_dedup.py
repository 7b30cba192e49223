"""Line deduplication by a segment-partition edit join.

Lines of at least ``SHORTEST`` characters are near if their edit distance is at most ``EDITS``;
shorter lines only if they are equal; blank lines are left alone.  Every line is split into
EDITS + 1 segments, so two near lines share one of them, close to its place; its hash, together with
the line's length and the segment's number, is an index key, and a longer or equally long line
probes with the few substrings that can match it.  Lines that meet under a key are compared by a
64-bit parity of their characters, then verified by banded bit-parallel edit distance, in lockstep
over arrays of pairs.  Near lines form classes, by union-find; of each class the first line stays,
in the order of (doc_id, hash of text, place), and every other goes.

Each task emits a repeated line once, so a line that many documents share is no hot key.  Keys travel
packed, in buckets of about ``ENTRIES``.  The lines of a hot key (over ``HOT`` squared pairs) are
compared block by block on their texts, and only links that join two groups come out; no key is
left out.

A null text stays null and an empty one empty; both have no lines to lose.  A document may lose all
its lines, then its text is empty.  Rows equal in doc_id and text are one document and are treated
alike; documents without a doc_id come last in the order.  Lines end at \\n alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow, durable, mix, ship, slices, tidied
from .components import components

EDITS = 2
SHORTEST = 24
#: Keys with more pairs than this squared are hot: their lines are compared in blocks of so many lines or characters.
HOT = 32
BLOCK = 2048
BLOCK_CHARS = 8_000_000
#: Entries of a bucket of keys, those that a task holds of one before it looks for hot keys, and those it packs at once.
ENTRIES = 1_000_000
HELD = 2_000_000
FLUSHED = 500_000
#: Rows of keys (24 bytes each, or little more) that may be broadcast to pick lines or documents.
PICKED = 400_000
#: Characters of text whose lines are hashed together.
SLICE = 400_000
#: Line hashes a task remembers so as not to emit a line twice.
REMEMBERED = 500_000

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


# --- lines of a text ----------------------------------------------------------------------------


def split_lines(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The lines, where each begins, and the code points of the whole text."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    lines = text.split("\n")
    starts = np.concatenate(([0], np.flatnonzero(codes == 10) + 1))
    return lines, starts, codes


def parities(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per line, 64 bits: whether each residue of code points occurs an odd number of times.

    One edit changes at most two of the bits.
    """
    line = np.repeat(np.arange(len(starts)), sizes)
    inside = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    counts = np.bincount(line * 64 + (codes[inside] & 63), minlength=64 * len(starts))
    return np.packbits((counts & 1).astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little").view("<u8").ravel()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    up, down = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))), dtype=np.uint64) for b in (_BASE, inverse))
    return up, down


class Rolling:
    """Hashes of any substrings of a text, by prefix sums modulo 2^64."""

    _up, _down = _powers(1 << 12)

    def __init__(self, codes: np.ndarray):
        if len(codes) >= len(Rolling._up):
            Rolling._up, Rolling._down = _powers(2 * len(codes))
        values = mix(codes.astype(np.uint64)) * self._up[: len(codes)]
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self._down[start])


def segment(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of a line: parts as even as can be, the longer ones last."""
    parts = edits + 1
    size, longer = length // parts, length % parts
    short = parts - longer
    return i * size + np.maximum(0, i - short), size + (i >= short)


def offsets(edits: int) -> list[tuple[int, int, int]]:
    """(characters that the other line has less, its segment, how far to the right it stands here) of the probes."""
    # Matches before segment i use up at most i edits, those behind it at most edits - i.
    return [
        (less, i, shift)
        for less in range(edits + 1)
        for i in range(edits + 1)
        for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1)
    ]


def keys(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(index keys, probe keys) of lines, one row each; probes that don't exist repeat the line's first key."""
    rolling = Rolling(codes)

    def key(length: np.ndarray, i: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        head = mix(length.astype(np.uint64) * np.uint64(edits + 1) + np.uint64(i))
        return mix(head ^ rolling.of(starts + start, starts + start + size))

    index = np.stack([key(sizes, i, *segment(sizes, i, edits)) for i in range(edits + 1)], axis=1)
    probes = []
    for less, i, shift in offsets(edits):
        at, size = segment(sizes - less, i, edits)
        start = at + shift
        fits = (start >= 0) & (start + size <= sizes)
        made = key(sizes - less, i, np.where(fits, start, 0), np.where(fits, size, 0))
        probes.append(np.where(fits, made, index[:, 0]))
    return index, np.stack(probes, axis=1)


# --- edit distance ------------------------------------------------------------------------------


def _plain_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """Without the common beginning and the common end."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    head = int(differ[0]) if len(differ) else n
    n -= head
    differ = np.flatnonzero(x[::-1][:n] != y[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    return a[head : len(a) - tail], b[head : len(b) - tail]


def within(pairs: list[tuple[str, str]], edits: int) -> np.ndarray:
    """Which pairs are at most so many edits apart: one machine word per pair holds the band of a column."""
    out = np.zeros(len(pairs), bool)
    hard = []
    for k, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > edits:
            continue
        a, b = sorted(_trimmed(a, b), key=len, reverse=True)
        if len(a) <= 2 * edits + 1:
            out[k] = _plain_distance(a, b) <= edits
        else:
            hard.append((len(b), k, a, b))
    hard.sort(key=lambda x: -x[0])
    for base in range(0, len(hard), 512):
        part = hard[base : base + 512]
        out[[k for _, k, _, _ in part]] = _banded([a for *_, a, _ in part], [b for *_, b in part], edits)
    return out


def _banded(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Pairs with len(a) >= len(b) > 0 and a longer than the band, by descending len(b)."""
    n, m = (np.array([len(s) for s in x]) for x in (a, b))
    wide = int(n.max()) + 2 * edits + 1
    # Rows outside a line match nothing: 0 in a, 1 beyond every code point in b.
    x = np.zeros((len(a), wide + edits), np.int64)
    y = np.full((len(b), int(m.max())), -1, np.int64)
    for k in range(len(a)):
        x[k, edits : edits + n[k]] = np.frombuffer(a[k].encode("utf-32-le"), np.uint32) + 1
        y[k, : m[k]] = np.frombuffer(b[k].encode("utf-32-le"), np.uint32) + 1
    one = np.uint64(1)
    vp = np.full(len(a), ~np.uint64(0) << np.uint64(63 - edits))
    vn = np.zeros(len(a), np.uint64)
    score = np.full(len(a), edits)
    edge = np.full(len(a), one << np.uint64(62))
    top = one << np.uint64(63)
    for j in range(int(m.max())):
        live = int(np.searchsorted(-m, -j, side="left"))  # rows whose b has a column j
        match = np.zeros(live, np.uint64)
        for d in range(2 * edits + 1):
            match |= (x[:live, j + d] == y[:live, j]).astype(np.uint64) << np.uint64(63 - 2 * edits + d)
        p, q = vp[:live], vn[:live]
        d0 = (((match & p) + p) ^ p) | match | q
        hp, hn = q | ~(d0 | p), d0 & p
        diagonal = j < n[:live] - edits
        along = ((hp & edge[:live]) != 0).astype(np.int64) - ((hn & edge[:live]) != 0)
        score[:live] += np.where(diagonal, (d0 & top) == 0, along)
        edge[:live] = np.where(diagonal, edge[:live], edge[:live] >> one)
        down = d0 >> one
        vp[:live], vn[:live] = hn | ~(down | hp), hp & down
    return score <= edits


# --- Spark --------------------------------------------------------------------------------------

LINES = pa.schema(
    [
        ("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("place", pa.int32()), ("id", pa.int64()), ("id2", pa.int64()),
        ("size", pa.int32()), ("parity", pa.int64()), ("number", pa.int32()),
    ]
)


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("h1"), F.crc32(text).alias("h2"))


def line_ids(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    digests = b"".join([xxhash.xxh3_128_digest(s.encode()) for s in lines])
    both = np.frombuffer(digests, ">i8").astype(np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sizes(starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.append(starts[1:] - 1, len(codes)) - starts


def _lines(hashed: DataFrame) -> DataFrame:
    """One row per line that is not blank; ``number`` counts them from 1 in their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, h1, h2, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts, SLICE):
                # All texts of a slice at once: a line break between two texts adds no line.
                lines, starts, codes = split_lines("\n".join(texts[a:b]))
                sizes = _sizes(starts, codes)
                counts = np.array([t.count("\n") + 1 for t in texts[a:b]])
                doc = np.repeat(np.arange(a, b), counts)
                place = np.arange(len(lines)) - np.repeat(np.cumsum(counts) - counts, counts)
                full = np.array([i for i, s in enumerate(lines) if s and not s.isspace()], np.int64)
                ids, ids2 = line_ids([lines[i] for i in full.tolist()])
                owners = doc[full].tolist()
                number = np.arange(len(full)) - np.searchsorted(doc[full], doc[full]) + 1
                yield arrow(
                    {
                        "doc_id": [doc_id[k] for k in owners], "h1": [h1[k] for k in owners], "h2": [h2[k] for k in owners], "place": place[full],
                        "id": ids, "id2": ids2, "size": sizes[full], "parity": parities(codes, starts, sizes)[full].view(np.int64),
                        "number": number,
                    },
                    LINES,
                )

    return hashed.select("doc_id", "h1", "h2", "text").mapInArrow(tidied(run), "doc_id long, h1 long, h2 long, place int, id long, id2 long, size int, parity long, number int")


def _keyed(hashed: DataFrame, edits: int, shortest: int, buckets: int) -> DataFrame:
    """Keys of the lines long enough, each line about once per task, dealt into buckets of keys.

    A row holds many entries of one bucket: in ``index`` and ``probes`` all keys and then all ids.
    """

    # Without the probes that are index keys of the line itself: index entries probe, too.
    moved = [k for k, (less, _, shift) in enumerate(offsets(edits)) if less or shift]

    def packed(parts: list[tuple[np.ndarray, np.ndarray]]) -> dict[int, bytes]:
        key, row = (np.concatenate(x) for x in zip(*parts, strict=True))
        bucket = _bucket(key, buckets)
        order = np.argsort(bucket, kind="stable")
        key, row, bucket = key[order], row[order], bucket[order]
        start = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        end = np.append(start[1:], len(bucket))
        return {int(bucket[s]): key[s:e].tobytes() + row[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist(), strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        index: list[tuple[np.ndarray, np.ndarray]] = []
        probes: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            one, two = packed(index), packed(probes)
            index.clear()
            probes.clear()
            at = sorted({*one, *two})
            columns = [pa.array(at, pa.int32()), *(pa.array([x.get(k, b"") for k in at], pa.binary()) for x in (one, two))]
            return pa.RecordBatch.from_arrays(columns, names=["bucket", "index", "probes"])

        held = 0
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts, SLICE):
                lines, starts, codes = split_lines("\n".join(texts[a:b]))
                sizes = _sizes(starts, codes)
                long = np.flatnonzero(sizes >= shortest)
                new, ids = [], []
                for i, x in zip(long.tolist(), line_ids([lines[i] for i in long.tolist()])[0].tolist(), strict=True):
                    if x not in known and not lines[i].isspace():
                        known.add(x)
                        new.append(i)
                        ids.append(x)
                if len(known) > REMEMBERED:
                    known.clear()
                if new:
                    row = np.array(ids, np.int64)
                    own, others = keys(codes, starts[new], sizes[new], edits)
                    for made, out in ((own, index), (others[:, moved], probes)):
                        out.append((made.ravel(), np.repeat(row, made.shape[1])))
                        held += made.size
                    if held > FLUSHED:
                        yield flush()
                        held = 0
        if held:
            yield flush()

    return hashed.select("text").mapInArrow(tidied(run), "bucket int, index binary, probes binary")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


class Bucket:
    """Entries of one bucket of keys; keys of many lines leave it as soon as they show."""

    def __init__(self, most: int, room: int) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.most, self.held, self.least = most, 0, room
        self.room = room
        self.hot = np.zeros(0, np.uint64)

    def add(self, data: bytes, index: bool) -> pa.RecordBatch | None:
        if not data:
            return None
        key, row = np.frombuffer(data, np.uint64).reshape(2, -1)
        row = row.view(np.int64)
        known, out = np.isin(key, self.hot) if len(self.hot) else np.zeros(len(key), bool), None
        if known.any():
            out = _met(members=(key[known], row[known], np.full(int(known.sum()), index)))
            key, row = key[~known], row[~known]
        self.parts.append((key, row, np.full(len(key), index)))
        self.held += len(key)
        return out

    def _sorted(self) -> tuple[np.ndarray, ...]:
        """Distinct (key, row), index entries first, by key; where each key starts and ends, its lines, its index lines."""
        key, row, index = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((~index, row, key))
        key, row, index = key[order], row[order], index[order]
        fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])))
        return key[fresh], row[fresh], index[fresh]

    def _alone_out(self) -> None:
        """Entries whose key occurs once meet nothing."""
        key, row, index = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
        self.parts = [(key[order], row[order], index[order])]

    def condense(self) -> pa.RecordBatch:
        """Repeats go, and the lines of hot keys, which are handed on."""
        key, row, index = self._sorted()
        start, end, owners = _runs(key, index)
        # Index lines of a long key may still come, so its lines count alone.
        hot = np.repeat(np.maximum(owners, 1) * (end - start) > self.most, end - start)
        self.hot = np.union1d(self.hot, key[hot])
        out = _met(members=(key[hot], row[hot], index[hot]))
        self.parts = [(key[~hot], row[~hot], index[~hot])]
        self.held = int((~hot).sum())
        self.room = max(self.least, 2 * self.held)
        return out

    def close(self) -> pa.RecordBatch:
        self._alone_out()
        key, row, index = self._sorted() if len(self.parts[0][0]) else self.parts[0]
        if not len(key):
            return _met()
        start, end, owners = _runs(key, index)
        some = (end - start > 1) & (owners > 0)
        hot = some & (owners * (end - start) > self.most)
        two = some & ~hot & (end - start == 2)
        a, b = [row[start[two]]], [row[start[two] + 1]]
        for s, e in zip(*(x[some & ~hot & ~two].tolist() for x in (start, end)), strict=True):
            right = row[s:e]
            left = right[index[s:e]]
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            a.append(x[x != y])
            b.append(y[x != y])
        a, b = np.concatenate(a), np.concatenate(b)
        inside = np.repeat(hot, end - start)
        return _met((np.minimum(a, b), np.maximum(a, b)), (key[inside], row[inside], index[inside]))


def _runs(key: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    end = np.append(start[1:], len(key)) if len(key) else start
    on = np.concatenate(([0], np.cumsum(index)))
    return start, end, on[end] - on[start]


def _met(pairs: tuple[np.ndarray, ...] = (), members: tuple[np.ndarray, ...] = ()) -> pa.RecordBatch:
    """Rows (a, b, null) for pairs and (line, whether by an index key, key) for lines of a hot key."""
    none = np.zeros(0, np.int64)
    a, b = pairs or (none, none)
    key, row, index = members or (none, none, none)
    columns = [np.concatenate((a, row)).astype(np.int64), np.concatenate((b, index)).astype(np.int64)]
    absent = np.concatenate((np.ones(len(a), bool), np.zeros(len(key), bool)))
    keys_of = pa.array(np.concatenate((np.zeros(len(a), np.int64), key.astype(np.uint64).view(np.int64))), mask=absent)
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), keys_of], names=["a", "b", "key"])


def _meet(keyed: DataFrame) -> DataFrame:
    """(a, b, key): pairs under a key of an index line and a probing one; lines of hot keys come one by one."""
    most, room = HOT * HOT, HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, Bucket(most, room)
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, *data = (batch.column(c)[k].as_py() for c in range(3))
                if bucket != at:
                    if own.held:
                        yield own.close()
                    at, own = bucket, Bucket(most, room)
                for part, index in zip(data, (True, False), strict=True):
                    if (out := own.add(part, index)) is not None:
                        yield out
                if own.held > own.room:
                    yield own.condense()
        if own.held:
            yield own.close()

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(run), "a long, b long, key long")


def merge(left: np.ndarray, right: np.ndarray, label: np.ndarray, lines: list[str], edits: int) -> list[tuple[int, int]]:
    """Links of labels by near pairs of left and right lines (positions); ``label`` is brought up to date.

    Lines of one label are not compared any more, so a dense group takes about one check per line.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(s) for s in lines], np.int64)
    bits = parities(codes, np.cumsum(sizes) - sizes, sizes)
    out = []
    for r in left.tolist():
        near = right[label[right] != label[r]]
        room = (np.bitwise_count(bits[near] ^ bits[r]) <= 2 * edits) & (np.abs(sizes[near] - sizes[r]) <= edits)
        near = near[room]
        while len(near):
            first = np.unique(label[near], return_index=True)[1]
            tried = near[first]
            found = tried[within([(lines[r], lines[k]) for k in tried.tolist()], edits)]
            if len(found):
                joined = np.unique(np.append(label[found], label[r]))
                out += [(int(joined[0]), int(x)) for x in joined[1:]]
                label[np.isin(label, joined)] = joined[0]
            near = np.delete(near, first)
            near = near[label[near] != label[r]]
    return out


def _in_blocks(members: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Links that connect the near lines of hot keys, verified on texts: first inside blocks, then between them."""
    picked = members.groupBy("key", "id").agg(F.max("index").alias("index")).join(texts, "id")
    count = picked.groupBy("key").agg(
        F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.length("line")) / BLOCK_CHARS)).cast("int").alias("blocks"), F.max("index").alias("met")
    )
    count = durable(count.where("met > 0").select("key", "blocks"), "line-hot")
    placed = picked.join(_few(count), "key").select(
        "key", "id", "line", F.col("index") > 0, "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("own")
    ).toDF("key", "id", "line", "first", "blocks", "own")

    def inside(group: pd.DataFrame) -> pd.DataFrame:
        label, first = group["id"].to_numpy(np.int64, copy=True), group["first"].to_numpy(bool)
        merge(np.flatnonzero(first), np.arange(len(label)), label, group["line"].tolist(), edits)
        return group.assign(label=label)

    kind = "key long, id long, line string, first boolean, blocks int, own int, label long"
    # Dealt by block: a join on the key alone would leave all blocks of a key in one task.
    labelled = durable(placed.repartition("key", "own").groupBy("key", "own").applyInPandas(inside, kind), "line-blocks")
    other = F.explode(F.expr("filter(sequence(0, blocks - 1), b -> b <> own)"))
    crossed = labelled.where("blocks > 1").select("*", other.alias("other"))
    crossed = crossed.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def between(group: pd.DataFrame) -> pd.DataFrame:
        label, first, low = group["label"].to_numpy(np.int64, copy=True), group["first"].to_numpy(bool), (group["own"] == group["i"]).to_numpy(bool)
        lines, out = group["line"].tolist(), []
        for side in (low, ~low):
            out += merge(np.flatnonzero(first & side), np.flatnonzero(~side), label, lines, edits)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    between_blocks = crossed.groupBy("key", "i", "j").applyInPandas(between, "a long, b long")
    return labelled.where("id <> label").select(F.col("label").alias("a"), F.col("id").alias("b")).union(between_blocks)


def _few(df: DataFrame) -> DataFrame:
    """A written table of keys, broadcast as long as it has at most ``PICKED`` rows."""
    return F.broadcast(df) if df.count() <= PICKED else df


def _texts(hashed: DataFrame, lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, line) for the ids, each from its first document."""
    place = lines.join(_few(ids), "id", "left_semi").groupBy("id").agg(F.min(F.struct("h1", "h2", "place")).alias("at"))
    wanted = durable(place.groupBy("at.h1", "at.h2").agg(F.collect_set("at.place").alias("places")), "line-wanted")
    picked = hashed.select("h1", "h2", "text").join(_few(wanted), ["h1", "h2"]).select("text", "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.split("\n")
                found = [lines[p] for p in places if p < len(lines)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(line_ids(found)[0]), pa.array(found, pa.string())], names=["id", "line"])

    return durable(picked.mapInArrow(tidied(run), "id long, line string").groupBy("id").agg(F.first("line").alias("line")), "line-texts")


def links(hashed: DataFrame, lines: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """(a, b): ids of different lines at most so many edits apart; of lines under hot keys enough to connect them."""
    entries = lines.where(F.col("size") >= shortest).count() * (edits + 1) * (edits + 2)
    met = durable(_meet(_keyed(hashed, edits, shortest, max(1, -(-entries // ENTRIES)))), "line-met")
    pairs = durable(met.where("key is null").select("a", "b").distinct(), "line-pairs")
    members = met.where("key is not null").select("key", F.col("a").alias("id"), F.col("b").alias("index"))
    paired = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-paired")
    meta = lines.join(_few(paired), "id", "left_semi").groupBy("id").agg(F.first("size").alias("size"), F.first("parity").alias("parity"))
    meta = durable(meta, "line-meta")
    one, two = (meta.select(F.col("id").alias(c), F.col("size").alias(f"s{c}"), F.col("parity").alias(f"p{c}")) for c in ("a", "b"))
    room = (F.bit_count(F.col("pa").bitwiseXOR(F.col("pb"))) <= 2 * edits) & (F.abs(F.col("sa") - F.col("sb")) <= edits)
    close = durable(pairs.join(one, "a").join(two, "b").where(room).select("a", "b"), "line-close")
    ids = durable(close.select(F.explode(F.array("a", "b")).alias("id")).union(members.select("id")).distinct(), "line-ids")
    texts = _texts(hashed, lines, ids)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = within(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), edits)
            yield batch.select([0, 1]).filter(pa.array(near))

    one, two = (texts.select(F.col("id").alias(c), F.col("line").alias(f"t{c}")) for c in ("a", "b"))
    checked = close.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(tidied(verify), "a long, b long")
    return durable(checked.union(_in_blocks(members, texts, edits)), "line-links")


def _removed(docs: DataFrame, edits: int, shortest: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hashed documents, their lines, (doc_id, h1, h2, places of lines that go))."""
    ship(docs.sparkSession)
    hashed = _hashed(docs)
    lines = durable(_lines(hashed), "lines")
    classes = components(links(hashed, lines, edits, shortest)).select(F.col("node").alias("id"), "component")
    # A line outside all links is a class of its own, told by 128 bits.
    named = lines.join(_few(durable(classes, "line-nodes")), "id", "left").select(
        "doc_id", "h1", "h2", "place", F.coalesce("component", "id").alias("c1"), F.when(F.col("component").isNull(), F.col("id2")).alias("c2")
    )
    named = named.withColumn("c2", F.coalesce("c2", F.lit(0)))
    # Most lines stand alone; only classes of several go on.
    several = durable(named.groupBy("c1", "c2").agg(F.count("*").alias("n")).where("n > 1").select("c1", "c2"), "line-several")
    named = durable(named.join(_few(several), ["c1", "c2"]), "line-classes")
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h1", "h2", "place")
    first = named.groupBy("c1", "c2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last").select("c1", "c2", "first")
    gone = named.join(_few(durable(first, "line-first")), ["c1", "c2"]).where(~order.eqNullSafe(F.col("first")))
    places = gone.groupBy("doc_id", "h1", "h2").agg(F.collect_set("place").alias("places"))
    return hashed, lines, durable(places, "line-gone")


def without(text: str, places: list[int]) -> str:
    gone = set(places)
    return "\n".join(s for i, s in enumerate(text.split("\n")) if i not in gone)


def _same(table: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Join on (doc_id, h1, h2), null ids being equal; the other side's keys don't come along."""
    key = ["doc_id", "h1", "h2"]
    renamed = other.select(*(F.col(c).alias(f"_{c}") for c in key), *(c for c in other.columns if c not in key))
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    return table.join(renamed, match, how).drop(*(f"_{c}" for c in key))


def _split(docs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that keep all lines, those that lose some, with ``text`` cut); only the latter are shuffled."""
    marks = _few(gone.select("doc_id", "h1", "h2"))
    joined = _same(_same(docs, marks, "left_semi"), gone, "inner")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places = (batch.column(k).to_pylist() for k in (at, batch.num_columns - 1))
            columns = batch.columns[:-1]
            columns[at] = pa.array([without(t, p) for t, p in zip(texts, places, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return _same(docs, marks, "left_anti"), joined.mapInArrow(tidied(run), docs.schema)


def report(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """One row per document: doc_id, n_lines (not blank), n_removed, kept_sha256 of its text without the removed lines."""
    hashed, lines, gone = _removed(docs, edits, shortest)
    key = ["doc_id", "h1", "h2"]
    whole, cut = (t.select(*key, F.sha2("text", 256).alias("kept_sha256")) for t in _split(hashed, gone))
    counts = lines.groupBy(*key).agg(F.max("number").cast("long").alias("n_lines"))
    sizes = gone.select(*key, F.size("places").cast("long").alias("n_removed"))
    table = _same(_same(whole.union(cut), counts, "left"), sizes, "left")
    nothing = F.lit(0).cast("long")
    return table.select("doc_id", F.coalesce("n_lines", nothing).alias("n_lines"), F.coalesce("n_removed", nothing).alias("n_removed"), "kept_sha256")


def dedup(docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST) -> DataFrame:
    """The documents with repeated and near-repeated lines gone from ``text``; all rows and columns stay."""
    _, _, gone = _removed(docs, edits, shortest)
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "doc_id", "text", F.xxhash64(text).alias("h1"), F.crc32(text).alias("h2"))
    whole, cut = (t.select("row", "text") for t in _split(keyed, gone))
    return whole.union(cut).select(*(F.col("text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
