"""Token ids in binary shards with a minimal perfect hash index.

``write`` encodes every document, appends the end id and writes the ids in ascending doc_id order:
one shard per range of doc_ids, and in it the raw ids, little-endian, of 2 or 4 bytes as the
vocabulary asks, behind them the index.  The index maps a key (doc_id, and which of its repeats) to
a slot by a minimal perfect hash: levels of bit arrays, each of which places the keys that collide
with no other, with ranks counted over all levels.  A slot holds the key's fingerprint, offset and
length, so one key costs a constant number of reads and an absent key is recognised.

Rows without a doc_id come first and share the null key; equal doc_ids are told apart by their
order in the shard (by hash of text, then by text).  Null and empty texts are documents of the end
id alone.  An empty table gives no shards.

Shard files go through pyarrow's file systems (local, hdfs, s3, gs) to the shared folder, under the
name of the task attempt, and are named in the manifest by the attempt that succeeded; a lost
executor leaves at most an unnamed file.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_path
from .common import arrow, durable, mix, ship, slices
from .pieces import PieceIds

MAGIC = b"TIDSHRD1"
#: Slots of a level for each key that it has to place.
GAMMA = 2
SLOT = np.dtype([("offset", "<u8"), ("size", "<u4"), ("fingerprint", "<u4")])


# --- minimal perfect hash -----------------------------------------------------------------------


def key_hash(ids: np.ndarray, absent: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    """64 bits of (doc_id, whether it is null, which repeat); distinct keys of one id stay distinct."""
    return mix(mix(ids.astype(np.int64).view(np.uint64)) ^ (repeat.astype(np.uint64) * np.uint64(2) + absent.astype(np.uint64)))


class PerfectHash:
    """Levels of bits and, per level, the number of keys placed before each 64-bit word."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        counts = [np.bitwise_count(level).astype(np.int64) for level in levels]
        before = np.cumsum([0, *(int(c.sum()) for c in counts)])
        self.ranks = [b + np.cumsum(c) - c for b, c in zip(before, counts, strict=False)]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-GAMMA * len(keys) // 64) * 64
            at = cls._place(keys, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64)
            levels.append(bits)
            keys = keys[~alone[at]]
            if len(levels) > 200:
                raise ValueError("two keys have the same hash")
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that certainly are absent. Others must match a fingerprint."""
        out, todo = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(todo):
                break
            at = self._place(keys[todo], k, len(bits) * 64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            here = (bits[word] >> bit) & np.uint64(1) == 1
            low = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = ranks[word] + np.bitwise_count(low)
            out[todo[here]] = slot[here]
            todo = todo[~here]
        return out

    def dump(self) -> bytes:
        sizes = struct.pack(f"<I{len(self.levels)}I", len(self.levels), *map(len, self.levels))
        return sizes + b"".join(level.astype("<u8").tobytes() for level in self.levels)

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", data)
        sizes, at, levels = struct.unpack_from(f"<{n}I", data, 4), 4 + 4 * n, []
        for size in sizes:
            levels.append(np.frombuffer(data, "<u8", size, at).astype(np.uint64))
            at += 8 * size
        return cls(levels)


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


# --- shards -------------------------------------------------------------------------------------


def _file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Writer:
    """Payload as it comes, then keys, slots, hash and a fixed trailer."""

    def __init__(self, uri: str, width: int):
        system, path = _file_system(uri)
        self.out, self.type = system.open_output_stream(path), np.dtype(f"<u{width}")
        self.ids: list[int | None] = []
        self.sizes: list[np.ndarray] = []
        self.total = 0

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.astype(self.type).tobytes())
        self.ids += doc_ids
        self.sizes.append(sizes)
        self.total += len(ids)

    def close(self) -> None:
        absent = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], np.int64)
        sizes = np.concatenate(self.sizes)
        # Rows are sorted by key, so repeats of a key stand together.
        same = np.concatenate(([False], (ids[1:] == ids[:-1]) & (absent[1:] == absent[:-1])))
        at = np.arange(len(ids))
        repeat = at - np.maximum.accumulate(np.where(same, 0, at))
        keys = key_hash(ids, absent, repeat)
        hashed = PerfectHash.build(keys)
        slots = np.zeros(len(ids), SLOT)
        place = hashed.find(keys)
        slots["offset"][place] = (np.cumsum(sizes) - sizes) * self.type.itemsize
        slots["size"][place], slots["fingerprint"][place] = sizes, fingerprint(keys)
        dump = hashed.dump()
        for part in (absent.astype(np.uint8).tobytes(), ids.astype("<i8").tobytes(), repeat.astype("<u4").tobytes(), slots.tobytes(), dump):
            self.out.write(part)
        self.out.write(struct.pack("<QQQI", self.total, len(ids), len(dump), self.type.itemsize) + MAGIC)
        self.out.close()


class Shard:
    """Keyed access to one shard file."""

    TRAILER = struct.calcsize("<QQQI") + len(MAGIC)

    def __init__(self, uri: str):
        system, path = _file_system(uri)
        self.file = system.open_input_file(path)
        end = self.file.size()
        trailer = self.file.read_at(self.TRAILER, end - self.TRAILER)
        if trailer[-len(MAGIC) :] != MAGIC:
            raise ValueError(f"{uri} is no complete shard")
        total, n, size, width = struct.unpack("<QQQI", trailer[: -len(MAGIC)])
        self.type, at = np.dtype(f"<u{width}"), total * width
        data = self.file.read_at(end - self.TRAILER - at, at)
        self.absent = np.frombuffer(data, np.uint8, n).astype(bool)
        self.ids = np.frombuffer(data, "<i8", n, n)
        self.repeat = np.frombuffer(data, "<u4", n, 9 * n)
        self.slots = np.frombuffer(data, SLOT, n, 13 * n)
        self.hash = PerfectHash.load(data[13 * n + SLOT.itemsize * n :])

    def slots_of(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where the stored fingerprint says that the key isn't here."""
        if not len(self.slots):
            return np.full(len(keys), -1, np.int64)
        place = self.hash.find(keys)
        known = (place >= 0) & (self.slots["fingerprint"][place] == fingerprint(keys))
        return np.where(known, place, -1)

    def read(self, slot: int) -> np.ndarray:
        size = int(self.slots["size"][slot])
        return np.frombuffer(self.file.read_at(size * self.type.itemsize, int(self.slots["offset"][slot])), self.type).astype("<u4")


# --- encoding -----------------------------------------------------------------------------------


#: A blank and characters that are not white space.
PLAIN = re.compile(r" \S+")


class Encoder:
    """The tokenizers library over new pieces; pieces are joined for one call and told apart by bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = list(special)
        vocabulary = self.tokenizer.get_vocab(True)
        #: Of the byte-level alphabet each character stands for one byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)
        self.pieces = PieceIds(self._encode, self.special[0] if self.special else None)

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Joined are only pieces of a blank and characters that are not white space: between these
        # the tokenizer cuts by itself. The others are encoded one by one.
        # White space other than a blank isn't printable, so most pieces need no regular expression.
        odd = [
            k for k, p in enumerate(pieces)
            if (p[:1] != " " or len(p) < 2 or " " in p[1:] or not p.isprintable()) and not PLAIN.fullmatch(p)
        ]
        single = np.zeros(len(pieces), bool)
        single[odd] = True
        chosen = [p for p, alone in zip(pieces, single.tolist(), strict=True) if not alone] if odd else pieces
        joined = "".join(chosen)
        if any(s in joined for s in self.special):
            odd, chosen, joined = range(len(pieces)), [], ""
            single[:] = True
        sizes = np.zeros(len(pieces), np.int64)
        found = np.zeros(0, np.uint32)
        if chosen:
            found = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.cumsum(self.bytes_of[found])
            bounds = np.cumsum(np.fromiter(map(len, chosen), np.int64, len(chosen)))
            if not joined.isascii():
                # From characters to bytes: where each character begins, and the end.
                raw = np.frombuffer(joined.encode(), np.uint8)
                bounds = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))[bounds]
            sizes[~single] = np.diff(np.searchsorted(ends, bounds) + 1, prepend=0)
            if not len(odd):
                return found, sizes
        each = [e.ids for e in self.tokenizer.encode_batch_fast([pieces[k] for k in odd], add_special_tokens=False)]
        sizes[odd] = [len(ids) for ids in each]
        out = np.zeros(int(sizes.sum()), np.uint32)
        alone = np.repeat(single, sizes)
        out[alone] = [i for ids in each for i in ids]
        out[~alone] = found
        return out, sizes

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each closed by the end id, numbers of ids)."""
        ids, sizes = self.pieces.of(texts)
        ends = np.cumsum(sizes)
        return np.insert(ids, ends, np.uint32(end_id)), sizes + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- Spark --------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write all shards below the folder; returns the manifest (shard, file, n_docs, n_ids, start).

    Documents are dealt out by ranges of (doc_id, hash of text), so a doc_id that many rows carry
    is no single task.
    """
    spark = docs.sparkSession
    ship(spark)
    _file_system(folder)[0].create_dir(_file_system(folder)[1], recursive=True)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    dealt = keyed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, uri, first = encoder(path), None, "", None
        width = 2 if max(len(own.bytes_of), end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                if out is None:
                    uri, first = f"{folder}/{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin", doc_ids[0]
                    out = Writer(uri, width)
                out.add(doc_ids[a:b], *own.encode(texts[a:b], end_id))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"shard": [TaskContext.get().partitionId()], "file": [uri], "n_docs": [len(out.ids)], "n_ids": [out.total]},
                schema=pa.schema([("shard", pa.int64()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
            )

    shards = durable(dealt.mapInArrow(encode, "shard long, file string, n_docs long, n_ids long"), "shards")
    # One row per shard: the running sum over shards is small at any size of the corpus.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


REPORT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_back(manifest: DataFrame) -> DataFrame:
    """One row per document, read from the files by keyed access: doc_id, start, n_tokens, ids_crc32."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(uri)
                slots = shard.slots_of(key_hash(shard.ids, shard.absent, shard.repeat))
                if (slots < 0).any() or len(np.unique(slots)) != len(slots):
                    raise ValueError(f"the index of {uri} misses a key")
                for a in range(0, len(slots), 4096):
                    part = slots[a : a + 4096].tolist()
                    yield arrow(
                        {
                            "doc_id": [None if no else i for i, no in zip(shard.ids[a : a + 4096].tolist(), shard.absent[a : a + 4096].tolist(), strict=True)],
                            "start": [base + int(shard.slots["offset"][s]) // shard.type.itemsize for s in part],
                            "n_tokens": [int(shard.slots["size"][s]) for s in part],
                            "ids_crc32": [zlib.crc32(shard.read(s).tobytes()) for s in part],
                        },
                        REPORT,
                    )

    # Every shard is a task of its own.
    spread = manifest.select("file", "start").repartition(max(1, manifest.count()))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, manifest: list[str], doc_id: int | None, repeat: int = 0) -> np.ndarray | None:
    """ids of one document from the shard files given, or None."""
    key = key_hash(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([repeat]))
    for uri in manifest:
        shard = Shard(uri)
        slot = int(shard.slots_of(key)[0])
        if slot >= 0:
            return shard.read(slot)
    return None


def report(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Write the documents to a fresh folder under the shared root and read them back from there."""
    return read_back(write(docs, path, shared_path(docs.sparkSession, "token-files"), end_id))
