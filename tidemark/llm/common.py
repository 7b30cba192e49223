"""What the operators share: shipping code, cutting lineage, batches of texts, word hashes."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_path

#: Characters of text that one numpy step inside a task holds at a time.
SLICE_CHARS = 2_000_000
#: Entries a task-side word cache may hold before it starts anew.
CACHE_ENTRIES = 400_000

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    package = os.path.join(root, __name__.partition(".")[0])
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def give_back() -> None:
    """Return to the system what this process has freed; Python workers are used again and would hold it."""
    pa.default_memory_pool().release_unused()
    # glibc alone has it.
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of a task's batches; the worker gives memory back when they end."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def durable(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage ends, executors may go."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(texts: list[str | None], chars: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about so many characters each; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def words(text: str | None) -> list[bytes]:
    """Runs of characters other than space and \\x09-\\x0D, as UTF-8."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """The same with A-Z, and nothing else, in lower case."""
    return text.encode().lower().split() if text else []


#: A-Z in lower case, digits and everything beyond ASCII as they are, the rest of ASCII blank.
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Runs of 0-9, A-Z in lower case, a-z and characters beyond ASCII, as UTF-8."""
    return text.encode().translate(_ALNUM).split() if text else []


class Remembered(dict):
    """A function of words, computed once per word while the words held take at most so many bytes."""

    def __init__(self, of: Callable[[bytes], int], held: int = 24_000_000) -> None:
        super().__init__()
        self.function, self.held, self.room = of, held, held

    def __missing__(self, word: bytes) -> int:
        value = self.function(word)
        # About what an entry costs besides the word itself.
        self.room -= len(word) + 150
        if self.room < 0:
            self.clear()
            self.room = self.held
        if len(word) <= 1000:
            self[word] = value
        return value


class WordHash(dict):
    """64-bit xxh3 of each word, computed once per word while the cache lasts."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, items: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, items), np.uint64, len(items))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64) over an array."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n codes, in order; empty if there are fewer codes."""
    count = len(codes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = mix(out ^ codes[k : k + count])
    return out


def arrow(columns: dict[str, list | np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) for f in schema], schema=schema
    )
