"""Byte-level BPE, encoding and decoding, over the ranks of a .tiktoken file.

Each match of the pattern is merged by itself.  New matches are bucketed by length into padded
numpy matrices; in each round every row merges its leftmost pair of minimum rank, found in a hashed
pair table, and the matrix closes over the gap.  Rows that are done leave the matrix.  Matches of
more than ``merges.LONG`` bytes are merged one at a time with a heap, by the same order.  Texts are
cut at safe places first (``pieces``), so a piece is merged once per Python worker.

Null and empty texts have no ids and decode to no bytes.  Every text is read whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow, give_back, ship, slices
from .merges import LONG, NONE, PairTable, merge_long
from .pieces import PieceIds


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        rules = [
            (self.ranks[token[:k]], self.ranks[token[k:]], rank)
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        ]
        left, right, rank = (np.array(x, np.int64) for x in zip(*rules, strict=True))
        self.table = PairTable(left, right, rank, rank)
        self.pieces = PieceIds(self.encode_pieces)

    def merge(self, parts: list[bytes]) -> list[list[int]]:
        """ids of each part; the parts fill matrices whose width is the next power of two."""
        out: list[list[int]] = [[]] * len(parts)
        buckets: dict[int, list[int]] = {}
        for i, part in enumerate(parts):
            if (whole := self.ranks.get(part)) is not None:
                out[i] = [whole]
            elif len(part) > LONG:
                out[i] = merge_long(self.byte[np.frombuffer(part, np.uint8)], self.table)
            else:
                buckets.setdefault((len(part) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            width = 1 << bits
            sizes = np.array([len(parts[i]) for i in rows])
            padded = np.frombuffer(b"".join(parts[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(-1, width)
            symbols = np.where(np.arange(width) < sizes[:, None], self.byte[padded], -1)
            for i, ids in zip(rows, self._rounds(symbols), strict=True):
                out[i] = ids
        return out

    def _rounds(self, symbols: np.ndarray) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(symbols)
        rows = np.arange(len(symbols))
        rank, merged = self._pairs(symbols)
        while len(rows):
            best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            at = np.arange(len(rows))
            active = rank[at, best] < NONE if rank.shape[1] else np.zeros(len(rows), bool)
            for i, ids in zip(rows[~active].tolist(), symbols[~active].tolist(), strict=True):
                out[i] = [x for x in ids if x >= 0]
            rows, symbols, rank, merged, best = (x[active] for x in (rows, symbols, rank, merged, best))
            if not len(rows):
                break
            at = np.arange(len(rows))
            symbols[at, best] = merged[at, best]
            # Close the gap right of the merged symbol, and that of its pair.
            keep = np.ones(symbols.shape, bool)
            keep[at, best + 1] = False
            symbols = symbols[keep].reshape(len(rows), -1)
            keep = keep[:, 1:]
            rank, merged = (x[keep].reshape(len(rows), -1) for x in (rank, merged))
            # Only the two pairs beside the merged symbol have changed.
            for side in (best - 1, best):
                near = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                if len(near):
                    k = side[near]
                    rank[near, k], merged[near, k] = self._found(symbols[near, k], symbols[near, k + 1])
        return out

    def _found(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Padding is -1; as a key it would sign-extend over the left half, so mask it out.
        real = right >= 0
        rank, merged = self.table.find(np.where(real, left, 0), np.where(real, right, 0))
        return np.where(real & (left >= 0), rank, NONE), merged

    def _pairs(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = symbols[:, :-1].ravel(), symbols[:, 1:].ravel()
        rank, merged = self._found(left, right)
        return rank.reshape(len(symbols), -1), merged.reshape(len(symbols), -1)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [self.pattern.findall(p) for p in pieces]
        distinct = list(dict.fromkeys(chain.from_iterable(parts)))
        ids = dict(zip(distinct, self.merge([m.encode() for m in distinct]), strict=True))
        found = [list(chain.from_iterable(map(ids.__getitem__, p))) for p in parts]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum())), sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, number of ids of each text)."""
        return self.pieces.of(texts)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker; its tables are built once."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


REPORT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            doc_id, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                ids, sizes = own.encode(texts[a:b])
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(doc_id[a:b], pa.int64()), lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes): what the ids (null: none) stand for."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            plain = [own.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(plain, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def report(docs: DataFrame, path: str, pattern: str, remember: bool = True) -> DataFrame:
    """One row per document: number and digest of its ids, digest of the bytes that they decode to.

    ``remember``: whether a worker keeps its tables and pieces for the tasks that follow; a stage of a
    longer job gives the memory back at the end of each task.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from encoded(batches)
        finally:
            if not remember:
                _codecs.pop((path, pattern), None)
                give_back()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            doc_id, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                ids, sizes = own.encode(texts[a:b])
                parts = np.split(ids.astype("<u4"), np.cumsum(sizes)[:-1])
                yield arrow(
                    {
                        "doc_id": doc_id[a:b], "n_tokens": sizes,
                        "ids_sha256": [hashlib.sha256(x.tobytes()).hexdigest() for x in parts],
                        "decoded_sha256": [hashlib.sha256(own.decode(x)).hexdigest() for x in parts],
                    },
                    REPORT,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
