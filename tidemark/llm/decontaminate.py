"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lowered.  An item's windows
are its runs of ``n`` words, or the whole item where it has fewer, but not none.  A document word
inside any occurrence of a window is hit; a document is contaminated if at least one word and at
least ``min_share`` of its words are hit.

The test items are read in slices of bounded size (``SLICE_BYTES`` of text); each is broadcast in a
pass of its own, so what is broadcast never grows with the data.  Hashes only propose: every hit is
confirmed on the words themselves.

Null or empty texts (on either side) have no words and hit nothing.  Repeated items count once by
item_id; items without an id mark words but are not listed.  Repeated documents are judged row by
row.  Other columns of the documents pass through ``remove`` untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow, durable, ship, slices, tidied, window_hashes

#: Text of test items, in bytes, that one pass broadcasts.
SLICE_BYTES = 16 << 20
WINDOW = 13
#: Hit words times this reach the number of words in a contaminated document.
SHARE = 20

# --- fixed values: word characters, and A-Z lowered -------------------------------------------
TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else 32
    for b in range(256)
)
WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")


def item_words(text: str | None) -> list[bytes]:
    return text.encode().translate(TABLE).split() if text else []


class Windows:
    """The windows of a slice of test items, found by hash and confirmed by word codes."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items: dict[int, dict[bytes, set[str]]] = {}
        for item_id, text in items:
            found = item_words(text)
            if not found:
                continue
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64)
            size = min(n, len(codes))
            of_size = self.items.setdefault(size, {})
            for i in range(len(codes) - size + 1):
                ids = of_size.setdefault(codes[i : i + size].tobytes(), set())
                if item_id is not None:
                    ids.add(item_id)
        self.hashes = {
            size: np.unique(
                window_hashes_of(np.frombuffer(b"".join(keys), np.uint64).reshape(-1, size))
            )
            for size, keys in self.items.items()
        }

    def scan(self, text: str | None, hit: np.ndarray | None, ids: set[str]) -> tuple[int, np.ndarray | None]:
        """Number of words of the text; the mask of hit words, if any; adds to ids."""
        found = item_words(text)
        codes = np.fromiter(map(self.vocabulary.get, found, zeros()), np.uint64, len(found))
        known = codes != 0
        if not known.any():
            return len(found), hit
        for size, hashes in self.hashes.items():
            if len(codes) < size:
                continue
            # Only windows made of test words throughout can occur in a test item.
            runs = np.cumsum(np.concatenate(([0], known)))
            at = np.flatnonzero(runs[size:] - runs[:-size] == size)
            if not len(at):
                continue
            h = window_hashes(codes, size)[at]
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            for i in at[hashes[place] == h].tolist():
                owners = self.items[size].get(codes[i : i + size].tobytes())
                if owners is not None:
                    ids |= owners
                    hit = np.zeros(len(found), bool) if hit is None else hit
                    hit[i : i + size] = True
        return len(found), hit


def zeros() -> Iterator[int]:
    while True:
        yield 0


def window_hashes_of(rows: np.ndarray) -> np.ndarray:
    """The hash of each row, as window_hashes gives it for a run of the same codes."""
    from .common import mix

    out = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out ^ rows[:, k])
    return out


def _without(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and the gap after each."""
    out, last = [], 0
    spans = [m.span() for m in WORD.finditer(text)]
    for k, (start, _) in enumerate(spans):
        if hit[k]:
            out.append(text[last:start])
            last = spans[k + 1][0] if k + 1 < len(spans) else len(text)
    return "".join([*out, text[last:]])


Finish = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def scan(docs: DataFrame, items: DataFrame, n: int = WINDOW, finish: tuple[Finish, StructType] | None = None) -> DataFrame:
    """(row: the document's columns, text, hits: packed mask of hit words or null, items: ids, n: words).

    The last three hold what all slices of the items (item_id, text) have found together.  ``finish``
    makes other rows of these in the Python worker that found the last of them: a step of its own would
    need a second worker for every task.
    """
    spark = docs.sparkSession
    ship(spark)
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    count = total // SLICE_BYTES + 1
    out = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text",
        F.lit(None).cast("binary").alias("hits"), F.array().cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n"),
    )
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        windows = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def mark(batches: Iterator[pa.RecordBatch], windows=windows) -> Iterator[pa.RecordBatch]:
            index = Windows(windows.value, n)
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in slices(texts):
                    rows = batch.slice(a, b - a)
                    old = zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)
                    hits, ids, counts = [], [], []
                    for text, (mask, listed) in zip(texts[a:b], old, strict=True):
                        before = None if mask is None else np.unpackbits(np.frombuffer(mask, np.uint8)).astype(bool)
                        found = set(listed)
                        size, hit = index.scan(text, before, found)
                        hits.append(None if hit is None else np.packbits(hit).tobytes())
                        ids.append(sorted(found))
                        counts.append(size)
                    last = [pa.array(v, f.type) for v, f in zip((hits, ids, counts), list(rows.schema)[-3:], strict=True)]
                    yield pa.RecordBatch.from_arrays([*rows.columns[:-3], *last], schema=rows.schema)

        if k + 1 == count and finish is not None:
            end, schema = finish

            def ended(batches: Iterator[pa.RecordBatch], mark=mark) -> Iterator[pa.RecordBatch]:
                return end(mark(batches))

            return out.mapInArrow(tidied(ended), schema)
        out = out.mapInArrow(tidied(mark), out.schema)
        if k + 1 < count:
            out = durable(out, "decontaminate")
    return out


REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def report(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: int = SHARE) -> DataFrame:
    """One row per document: words, hit words, items found, digest of their ids, verdict."""
    marked = scan(docs.select("doc_id", "text"), items, n).select("row.doc_id", "hits", "items", "n")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, hits, ids, counts = (c.to_pylist() for c in batch.columns)
            n_hit = [0 if h is None else int(np.unpackbits(np.frombuffer(h, np.uint8)).sum()) for h in hits]
            yield arrow(
                {
                    "doc_id": doc_id, "n_words": counts, "n_hit": n_hit, "n_items": [len(x) for x in ids],
                    "items_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in ids],
                    "contaminated": [h > 0 and share * h >= w for h, w in zip(n_hit, counts, strict=True)],
                },
                REPORT,
            )

    return marked.mapInArrow(judge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, items: DataFrame, n: int = WINDOW, share: int = SHARE, spans: bool = False) -> DataFrame:
    """The documents without the contaminated ones; with ``spans``, all documents without their hit words."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = [None if h is None else np.unpackbits(np.frombuffer(h, np.uint8)) for h in batch.column(2).to_pylist()]
            if spans:
                texts = batch.column(1).to_pylist()
                cut = pa.array([t if m is None else _without(t, m) for t, m in zip(texts, masks, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0), cut], names=["row", "text"])
            else:
                counts = batch.column(4).to_pylist()
                clean = [m is None or share * int(m.sum()) < c for m, c in zip(masks, counts, strict=True)]
                yield batch.select([0, 1]).filter(pa.array(clean, pa.bool_()))

    schema = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text").schema
    kept = scan(docs, items, n, (keep, schema))
    return kept.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
