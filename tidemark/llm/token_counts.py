"""Token counts by rank-synchronous array merging.

The library's own normalizer and pre-tokenizer turn new pieces of text into pre-tokens.  These lie
side by side in ragged numpy arrays; in each round every sequence merges its leftmost pair of lowest
rank, all sequences at once, and the survivors are counted at the end.  Text is cut at ASCII white
space first, where this tokenizer cuts in any case, and counts are remembered per piece.  Sequences
of more than ``merges.LONG`` symbols are merged one at a time, by the same order.

Null and empty texts have 0 bytes and 0 tokens.  Special strings inside a text count as one token,
as the library has it by default.  Every text is read whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHE_ENTRIES, arrow, ship, slices
from .merges import LONG, NONE, PairTable, merge_long

LIMIT = 2048


class Counter:
    """Tokens of a piece without white space, by a tokenizers .json file of kind BPE with word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocabulary = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(self.vocabulary[a], self.vocabulary[b], self.vocabulary[a + b]) for a, b in pairs], np.int64)
        self.table = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special)))
        self.counts: dict[bytes, int] = {}

    def symbols(self, token: str) -> list[int]:
        """Characters that the vocabulary doesn't have vanish, as there is no unknown token."""
        found = [self.vocabulary.get(c) for c in token[:-1]] + [self.vocabulary.get(token[-1] + self.end)]
        return [x for x in found if x is not None]

    def pre_tokens(self, piece: str) -> tuple[int, list[str]]:
        """Special strings in the piece, and the pre-tokens around them."""
        special, parts = 0, [piece]
        if "<|" in piece:
            parts = self.special.split(piece)
            special = len(parts) - 1
        out = []
        for part in parts:
            if part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                out += [token for token, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]
        return special, out

    def merged(self, sequences: list[list[int]]) -> np.ndarray:
        """Symbols that survive in each sequence."""
        survivors = np.zeros(len(sequences), np.int64)
        short = []
        for i, s in enumerate(sequences):
            if len(s) > LONG:
                survivors[i] = len(merge_long(np.array(s, np.int64), self.table))
            elif len(s) < 2:
                survivors[i] = len(s)
            else:
                short.append(i)
        owner = np.array(short, np.int64)
        size = np.array([len(sequences[i]) for i in short], np.int64)
        flat = np.fromiter((x for i in short for x in sequences[i]), np.int64, int(size.sum()))
        while len(owner):
            ends = np.cumsum(size)
            rank, merged = self.table.find(flat[:-1], flat[1:])
            rank, merged = np.append(rank, NONE), np.append(merged, -1)
            rank[ends - 1] = NONE  # the last symbol of a sequence has no right neighbour
            lowest = np.minimum.reduceat(rank, ends - size)
            # Leftmost position of the lowest rank: the first match in each sequence.
            match = np.flatnonzero(rank == np.repeat(lowest, size))
            of = np.repeat(np.arange(len(owner)), size)[match]
            first = match[np.concatenate(([True], of[1:] != of[:-1]))]
            active = lowest < NONE
            at = first[active]
            flat[at] = merged[at]
            survivors[owner[~active]] = size[~active]
            keep = np.repeat(active, size)
            keep[at + 1] = False
            flat, owner, size = flat[keep], owner[active], size[active] - 1
        return survivors

    def learn(self, pieces: list[bytes]) -> None:
        special, tokens, sizes = [], [], []
        for piece in pieces:
            n, found = self.pre_tokens(piece.decode())
            special.append(n)
            tokens += found
            sizes.append(len(found))
        place: dict[str, int] = {}
        index = [place.setdefault(t, len(place)) for t in tokens]
        counts = self.merged([self.symbols(t) for t in place])[index] if tokens else np.zeros(0, np.int64)
        sums = np.concatenate(([0], np.cumsum(counts)))
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        total = sums[bounds[1:]] - sums[bounds[:-1]] + special
        self.counts.update(zip(pieces, total.tolist(), strict=True))

    def of(self, texts: list[bytes]) -> list[int]:
        if len(self.counts) > CACHE_ENTRIES:
            self.counts.clear()
        pieces = [t.split() for t in texts]
        keys = list(chain.from_iterable(pieces))
        counts = np.fromiter(map(self.counts.get, keys, repeat(-1)), np.int64, len(keys))
        if len(missing := np.flatnonzero(counts < 0)):
            new = [keys[i] for i in missing.tolist()]
            self.learn(list(dict.fromkeys(new)))
            counts[missing] = [self.counts[p] for p in new]
        sums = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum([len(found) for found in pieces], dtype=np.int64)
        return np.diff(sums[np.concatenate(([0], ends))]).tolist()


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def report(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: UTF-8 bytes, tokens, and whether the tokens are more than the limit."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            doc_id, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                raw = [(t or "").encode() for t in texts[a:b]]
                counts = own.of(raw)
                yield arrow(
                    {"doc_id": doc_id[a:b], "n_bytes": list(map(len, raw)), "n_tokens": counts, "over_limit": [c > limit for c in counts]},
                    REPORT,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
