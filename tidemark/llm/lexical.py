"""Ranked lexical search by pipelined term partitioning.

Documents are cut into blocks of bounded size; a block holds, for each term that some item asks for, the
documents with that term.  Terms are dealt to owners by how frequent they are, rare terms first.  Items
travel in bundles: a bundle of one block passes the owners one after the other, and at each one a cogroup
brings its sparse accumulators (item, document, score so far) together with the owner's postings of that
block, whose integer contributions are added.  Between two owners a document leaves a bundle only on proof:
if its score so far and all that the owners ahead can add stay below the scores that enough documents of
the block have already.  Behind the last owner the best documents of each block remain, and a ranking over
blocks ends the search.

No text is shuffled: a fixed-size bitmap of hashed item terms, sent to the tasks, keeps words that no item
asks for from becoming postings, and a join by the term itself settles what the bitmap lets through.

Defined results.  Null texts and texts without terms are in no result and count nothing.  Documents without
a doc_id count and are ranked, last among equal scores.  Rows that share a doc_id are documents of their own.
Rows that share an item_id (null too) are one item with the terms of all of them.  Items without terms have
no rows; so have items of which no document holds a term.  Other columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import alnum_words, durable, ship

#: Bounds of a block: documents, words, and bytes of different words.
BLOCK_DOCS, BLOCK_WORDS, BLOCK_BYTES = 8_192, 4_000_000, 48_000_000
#: Items of a bundle; an item of more than LONG different terms is a bundle of its own.
BUNDLE, LONG = 256, 4_096
#: Bits of the bitmap of item terms: two megabytes whatever the number of items.
SIEVE_BITS = 1 << 24
#: An owner takes the terms that at most such a share of the documents holds; the last one takes the rest.
OWNERS = (1 / 64, 1 / 8, 1 / 3)
KEY = ["block", "bundle"]


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times): repeated terms counted, rows of one item added up."""
    ship(items.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                names, times = np.unique(np.array(alnum_words(text), object), return_counts=True)
                if len(names):
                    ids = pa.chunked_array([batch.column(0).slice(row, 1)] * len(names)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([ids, pa.array([t.decode() for t in names]), pa.array(times)], names=["item_id", "term", "times"])

    kind = items.schema["item_id"].dataType.simpleString()
    found = items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, term string, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _bit(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) % SIEVE_BITS


def sieve(terms: DataFrame) -> np.ndarray:
    """Bitmap of the hashed terms, as bytes; its size is fixed, so it may be sent to every task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([_bit(t.encode()) for t in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bits >> 5), pa.array(np.int64(1) << (bits & 31))], names=["place", "bits"])

    parts = terms.select("term").mapInArrow(run, "place long, bits long").groupBy("place").agg(F.bit_or("bits"))
    out = np.zeros(SIEVE_BITS >> 5, np.uint32)
    # At most one row per 32 bits of the bitmap.
    for place, bits in parts.collect():
        out[place] = bits
    return out.view(np.uint8)


class Block(dict):
    """Postings of some documents in the making: word -> code, -1 for words that no item asks for."""

    def __init__(self, bitmap: np.ndarray) -> None:
        super().__init__()
        self.bitmap, self.terms, self.bytes, self.words = bitmap, [], 0, 0
        self.ids: list[int | None] = []
        self.codes: list[np.ndarray] = []

    def __missing__(self, word: bytes) -> int:
        self.bytes += len(word)
        bit, code = _bit(word), -1
        if self.bitmap[bit >> 3] >> (bit & 7) & 1:
            code = len(self.terms)
            self.terms.append(word)
        self[word] = code
        return code

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        self.ids.append(doc_id)
        self.codes.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        self.words += len(words)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.words >= BLOCK_WORDS or self.bytes >= BLOCK_BYTES

    def rows(self, block: int) -> pa.RecordBatch:
        """A row of all documents (term null), then one per term; documents are numbered by rising doc_id."""
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        sizes = np.array([len(self.codes[k]) for k in order], np.int64)
        codes = np.concatenate([self.codes[k] for k in order])
        places = np.repeat(np.arange(len(order)), sizes)
        wanted = codes >= 0
        pairs, tf = np.unique(codes[wanted] * len(order) + places[wanted], return_counts=True)
        docs, term = pairs % len(order), pairs // len(order)
        offsets = np.concatenate(([0, len(order)], len(order) + np.cumsum(np.bincount(term, minlength=len(self.terms))))).astype(np.int32)
        lists = (np.concatenate((np.arange(len(order)), docs)), np.concatenate((np.zeros(len(order), np.int64), tf)), np.concatenate((sizes, sizes[docs])))
        ids = [[self.ids[k] for k in order], *[None] * len(self.terms)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(ids), block)), pa.array([None, *(t.decode() for t in self.terms)], pa.string()),
                *(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in lists), pa.array(ids, pa.list_(pa.int64())),
            ],
            names=["block", "term", "docs", "tf", "n", "ids"],
        )


def index(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """(block, term, docs, tf, n, ids), written: postings by block and term, and the ids of every block."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, made = Block(sent.value), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words := alnum_words(text):
                    block.add(doc_id, words)
                    if block.full():
                        yield block.rows(made)
                        block, made = Block(sent.value), made + 1
        if block.ids:
            yield block.rows(made)

    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "block long, term string, docs array<int>, tf array<int>, n array<int>, ids array<long>"
    )
    return durable(found, "lexical-index")


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Saturated, length-normalised frequency in parts of a thousand million."""
    m = 75 + 25 * n * n_docs // max(1, n_terms)
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).astype(np.int64) for chunk in column.chunks for x in chunk]


def term_statistics(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """(term, df, top): documents that hold the term, and its greatest impact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tf, n = (_arrays(pa.chunked_array([c])) for c in batch.columns[1:])
            top = [int(impacts(a, b, n_docs, n_terms).max()) for a, b in zip(tf, n, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(a) for a in tf], pa.int64()), pa.array(top, pa.int64())], names=["term", "df", "top"])

    parts = postings.select("term", "tf", "n").mapInArrow(run, "term string, df long, top long")
    return parts.groupBy("term").agg(F.sum("df").alias("df"), F.max("top").alias("top"))


def bundles(terms: DataFrame) -> DataFrame:
    """(item_id, bundle, item): items dealt to bundles, written."""
    sizes = durable(terms.groupBy("item_id").agg(F.count("*").alias("n")), "lexical-sizes")
    parts = max(1, -(-sizes.count() // (64 * BUNDLE)))
    placed = sizes.repartition(parts, "item_id").withColumn("at", F.monotonically_increasing_id())
    alone = F.col("n") > LONG
    bundle = F.when(alone, -F.col("at") - 1).otherwise(F.floor(F.col("at") / BUNDLE))
    return durable(placed.select("item_id", bundle.alias("bundle"), F.when(alone, 0).otherwise(F.col("at") % BUNDLE).cast("int").alias("item")), "lexical-items")


def asked(terms: DataFrame, items: DataFrame, statistics: DataFrame, n_docs: int) -> DataFrame:
    """(bundle, owner, term, item, gain, rest): what every owner needs to know, one row per bundle and term.

    ``gain`` is the item's times of the term by its weight; ``rest`` bounds what the owners behind can add.
    """
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    owner = sum((F.col("df") > share * n_docs).cast("int") for share in OWNERS)
    known = terms.join(statistics, "term").withColumn("gain", F.col("times") * weight).withColumn("owner", owner)
    known = known.join(items, known["item_id"].eqNullSafe(items["item_id"])).select("bundle", "item", "owner", "term", "gain", (F.col("gain") * F.col("top")).alias("most"))
    ahead = known.groupBy("bundle", "item").agg(*(F.sum(F.when(F.col("owner") > k, F.col("most")).otherwise(0)).alias(f"r{k}") for k in range(len(OWNERS) + 1)))
    rest = F.element_at(F.array(*(f"r{k}" for k in range(len(OWNERS) + 1))), F.col("owner") + 1)
    rows = known.join(ahead, ["bundle", "item"]).select("bundle", "owner", "term", F.struct("item", "gain", rest.alias("rest")).alias("x"))
    # At most one entry for each item of a bundle.
    packed = rows.groupBy("bundle", "owner", "term").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return packed.select("bundle", "owner", "term", *(F.col(f"x.{c}").alias(c) for c in ("item", "gain", "rest")))


CARRIED = "block long, bundle long, item int, docs array<int>, score array<long>"
_CARRIED = pa.schema([("block", pa.int64()), ("bundle", pa.int64()), ("item", pa.int32()), ("docs", pa.list_(pa.int32())), ("score", pa.list_(pa.int64()))])


def pass_owner(carried: pa.Table, postings: pa.Table, n_docs: int, n_terms: int, k: int, last: bool) -> pa.Table:
    """Accumulators of one bundle in one block, after an owner has added its contributions."""
    key = [(carried if carried.num_rows else postings).column(c)[0].as_py() for c in KEY]
    held: dict[int, np.ndarray] = {}
    rest: dict[int, int] = {}

    def row_of(item: int, reach: int) -> np.ndarray:
        row = held.get(item)
        if row is None or len(row) < reach:
            grown = np.zeros(max(BLOCK_DOCS, reach), np.int64)
            if row is not None:
                grown[: len(row)] = row
            row = held[item] = grown
        return row

    for item, docs, score in zip(carried.column("item").to_pylist(), _arrays(carried.column("docs")), _arrays(carried.column("score")), strict=True):
        row_of(item, int(docs.max()) + 1)[docs] = score
    columns = (_arrays(postings.column(c)) for c in ("docs", "tf", "n", "item", "gain", "rest"))
    for docs, tf, n, items, gains, bounds in zip(*columns, strict=True):
        adds, reach = impacts(tf, n, n_docs, n_terms), int(docs.max()) + 1
        for item, gain, bound in zip(items.tolist(), gains.tolist(), bounds.tolist(), strict=True):
            row_of(item, reach)[docs] += gain * adds
            rest[item] = bound
    out: dict[str, list] = {"item": [], "docs": [], "score": []}
    for item, row in held.items():
        docs = np.flatnonzero(row)
        if len(docs) > k:
            score = row[docs]
            if last:
                docs = np.sort(docs[np.argsort(-score, kind="stable")[:k]])
            elif item in rest:
                docs = docs[score + rest[item] >= np.partition(score, len(score) - k)[len(score) - k]]
        if len(docs):
            out["item"].append(item)
            out["docs"].append(docs)
            out["score"].append(row[docs])
    size = len(out["item"])
    return pa.table([pa.array([key[0]] * size, pa.int64()), pa.array([key[1]] * size, pa.int64()), *(pa.array(out[c], _CARRIED.field(c).type) for c in out)], schema=_CARRIED)


def _stage(n_docs: int, n_terms: int, k: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    return lambda carried, postings: pass_owner(carried, postings, n_docs, n_terms, k, last)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The k best documents (all with a score above 0, if fewer) of every item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    terms = durable(item_terms(items), "lexical-terms")
    found = index(docs, sieve(terms.select("term").distinct()))
    blocks, postings = found.where("term is null").select("block", "ids", "n"), found.where("term is not null").drop("ids")
    total = blocks.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    n_docs, n_terms = (int(x or 0) for x in total)
    numbered = bundles(terms)
    wanted = durable(asked(terms, numbered, term_statistics(postings, n_docs, n_terms), n_docs), "lexical-asked")

    carried = spark.createDataFrame([], CARRIED)
    for owner in range(len(OWNERS) + 1):
        own = postings.join(wanted.where(F.col("owner") == owner).drop("owner"), "term").drop("term")
        stage = _stage(n_docs, n_terms, k, owner == len(OWNERS))
        carried = carried.groupBy(*KEY).cogroup(own.groupBy(*KEY)).applyInArrow(stage, CARRIED)
    best = carried.select(*KEY, "item", F.explode(F.arrays_zip("docs", "score")).alias("x")).where("x.score > 0")
    named = best.join(blocks.select("block", "ids"), "block").select(
        "bundle", "item", F.element_at("ids", F.col("x.docs") + 1).alias("doc_id"), F.col("x.score").alias("score")
    )
    order = Window.partitionBy("bundle", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(numbered, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")
