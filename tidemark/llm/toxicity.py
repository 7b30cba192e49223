"""Toxicity: gradient-boosted trees over dense text features, calibrated by isotonic regression.

Learning uses labelled rows that are not held out (crc32 of the doc_id's text, mod 5, is not 0), at
most about ``SAMPLE`` of them, chosen by hash of doc_id.  They fall into three parts: one from which
the lexicon is drawn (words, and beginnings of words, that mark toxic documents), one on which the
trees grow, one on which the scores are calibrated.  Scoring reads texts alone, whole, in place,
without a join or shuffle.

Features: density and weight of lexicon words, their density within a few words of a second person,
capitals, words in capitals, marks, digits, obfuscated words (digits or symbols between letters,
drawn-out letters) and those of them that read as lexicon words, length.

Null and empty texts have all features 0 and a score like any other.  A document labelled more than
once has the mean of its labels; null labels are ignored.  Without labels of both kinds to learn
from, every score is the share of toxic rows, one half where there are none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import durable, give_back, ship, tidied

#: Labelled rows that learning reads at most, but for chance of the hash.
SAMPLE = 20_000
#: Entries of the lexicon.
LEXICON = 400
#: Tokens that a task remembers the reading of, and forms that it counts before it hands their counts on.
TOKENS = FORMS = 100_000
#: Words on either side of a second person that count as near.
NEAR = 4

# --- fixed values: second persons of the four languages, and signs that stand for letters ------
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch euer sie tu toi te vous votre vos tú ti usted ustedes vosotros vuestro".split())
LEET = str.maketrans("013457@$!|", "oieastasil")

_EDGE = ".,;:!?\"'()[]{}«»…-–*"
_UPPER = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_DIGIT = bytes(range(48, 58))
_INSIDE = re.compile(r"[^\W\d_][\d@$!|*#_]+[^\W\d_]")
_DRAWN = re.compile(r"(\w)\1\1")
FEATURES = 14


def forms(word: str) -> list[str]:
    """The word and its beginnings, as the lexicon has them."""
    return [word, *(f"{word[:n]}~" for n in (4, 5, 6) if len(word) > n)]


def plain(token: str) -> str:
    return token.strip(_EDGE).lower()


class Reader(dict):
    """Per token: bits for lexicon word, second person, capitals, obfuscation, obfuscated lexicon word; weight above."""

    HIT, SECOND, CAPITALS, ODD, HIDDEN = 1, 2, 4, 8, 16

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def weight(self, word: str) -> float:
        return max((self.lexicon.get(f, 0.0) for f in forms(word)), default=0.0)

    def __missing__(self, token: str) -> int:
        if len(self) >= TOKENS:
            self.clear()
        word = plain(token)
        weight = self.weight(word) if word else 0.0
        code = self.HIT * (weight > 0) | self.SECOND * (word in SECOND) | self.CAPITALS * (len(word) > 2 and token.isupper())
        if not token.isalpha() and _INSIDE.search(token) or _DRAWN.search(word):
            code |= self.ODD
            read = _DRAWN.sub(r"\1", plain(token.translate(LEET)))
            hidden = max(self.weight(read), self.weight(word.replace("*", "").replace("_", "")))
            if not weight and hidden:
                code |= self.HIDDEN
                weight = hidden
        code |= int(weight * 64) << 8
        self[token] = code
        return code

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * FEATURES
        tokens = text.split()
        if not tokens:
            return [0.0] * FEATURES
        n = len(tokens)
        code = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        bits = code & 255
        hit = (bits & (self.HIT | self.HIDDEN)) != 0
        weight = (code >> 8) / 64.0
        near = 0
        if hit.any() and (second := np.flatnonzero(bits & self.SECOND)).size:
            at = np.flatnonzero(hit)
            place = np.searchsorted(second, at)
            left = at - second[np.maximum(place - 1, 0)]
            right = second[np.minimum(place, len(second) - 1)] - at
            near = int((((left >= 0) & (left <= NEAR)) | ((right >= 0) & (right <= NEAR))).sum())
        raw = text.encode()
        size = len(raw)
        hits = int(hit.sum())
        return [
            hits / n,
            float(weight.sum()) / n,
            float(weight.max()),
            math.log1p(hits),
            float(np.sort(weight)[-3:].sum()),
            near / n,
            (size - len(raw.translate(None, _UPPER))) / size,
            int((bits & self.CAPITALS).astype(bool).sum()) / n,
            (size - len(raw.translate(None, _MARKS))) / size,
            text.count("!") / n,
            (size - len(raw.translate(None, _DIGIT))) / size,
            int((bits & self.ODD).astype(bool).sum()) / n,
            int((bits & self.HIDDEN).astype(bool).sum()) / n,
            math.log1p(n),
        ]


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document may not be learned from; false without a doc_id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    steps: IsotonicRegressionModel | None
    prior: float


def _featured(docs: DataFrame, lexicon: dict[str, float], keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and ``features``, an array of doubles; of a document only the text goes to Python."""
    spark = docs.sparkSession
    ship(spark)
    words = spark.sparkContext.broadcast(lexicon)

    @F.arrow_udf(ArrayType(DoubleType()))
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(words.value)
        for batch in batches:
            # One text at a time becomes a Python string; the batch stays as Arrow has it.
            yield pa.array([reader.features(text.as_py()) for text in batch], pa.list_(pa.float64()))
        reader.clear()
        give_back()

    return docs.select(*keep, features(F.col(text)).alias("features"))


def learn_lexicon(labelled: DataFrame, positives: int, negatives: int, size: int = LEXICON) -> dict[str, float]:
    """Forms that mark toxic documents with their weight, the log odds; the surest ones, at most ``size``."""
    ship(labelled.sparkSession)

    def counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
        keys = list(seen[0].keys() | seen[1].keys())
        return pa.RecordBatch.from_pydict(
            {"form": keys, "pos": [seen[1][k] for k in keys], "neg": [seen[0][k] for k in keys]},
            schema=pa.schema([("form", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]),
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(*batch.columns, strict=True):
                seen[label.as_py()].update({f for w in set((text.as_py() or "").split()) if (p := plain(w)) for f in forms(p)})
                if len(seen[0]) + len(seen[1]) >= FORMS:
                    yield counted(seen)
                    seen = (Counter(), Counter())
        yield counted(seen)

    # Copies of a text are one witness.
    single = labelled.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"))
    counts = single.select("text", "label").mapInArrow(tidied(count), "form string, pos long, neg long")
    sums = counts.groupBy("form").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 2")
    odds = F.log((F.col("pos") + 0.5) / (positives + 1.0)) - F.log((F.col("neg") + 0.5) / (negatives + 1.0))
    sure = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))
    ranked = sums.select("form", odds.alias("odds"), sure.alias("sure")).where("odds >= 1.5 and sure >= 2.2")
    rows = ranked.orderBy(F.desc("sure"), "form").limit(size).collect()
    return {r["form"]: min(r["odds"], 8.0) for r in rows}


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    )
    total = known.count()
    share = min(1.0, sample / max(1, total))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < int(share * 1_000_000))
    # The sample is bounded by its parameter, so it may be broadcast.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(20))
    rows = durable(rows.withColumn("part", part), "toxicity-sample")
    sizes = {(r["lexical"], r["label"]): r["n"] for r in rows.groupBy((F.col("part") < 8).alias("lexical"), "label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = (sum(n for (_, label), n in sizes.items() if label == k) for k in (1, 0))
    prior = (ones + 0.5) / (ones + zeros + 1)
    if any(sizes.get((lexical, label), 0) < 2 for lexical in (True, False) for label in (0, 1)):
        return Model({}, None, None, prior)
    lexicon = learn_lexicon(rows.where("part < 8"), sizes[True, 1], sizes[True, 0])
    featured = durable(_featured(rows.where("part >= 8"), lexicon, ["part", "label"]).coalesce(4), "toxicity-features")
    ready = featured.select("part", F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    grown = ready.where("part < 16")
    if grown.select("label").distinct().count() < 2:
        return Model(lexicon, None, None, prior)
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.3, seed=7, maxBins=64).fit(grown)
    scored = trees.transform(ready.where("part >= 16")).select("label", vector_to_array("probability")[1].alias("raw"))
    steps = IsotonicRegression(featuresCol="raw", labelCol="label").fit(scored) if scored.head(1) else None
    return Model(lexicon, trees, steps, prior)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of the documents and ``score``; ``text`` names the column that is read."""
    if model.trees is None:
        return docs.select(*keep, F.lit(model.prior).alias("score"))
    ready = _featured(docs, model.lexicon, keep, text).withColumn("features", array_to_vector("features"))
    raw = model.trees.transform(ready).select(*keep, vector_to_array("probability")[1].alias("raw"))
    if model.steps is None:
        return raw.withColumnRenamed("raw", "score")
    # A hundredth of the raw score keeps the order inside a step of the calibration.
    calibrated = model.steps.setPredictionCol("calibrated").transform(raw)
    return calibrated.select(*keep, (F.col("calibrated") * 0.99 + F.col("raw") * 0.01).alias("score"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels), ["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below one half, with their columns."""
    # Columns travel as one struct, so that none of their names can clash with the model's.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return score(packed, fit(docs, labels), ["row"], "row.text").where("score < 0.5").select("row.*")
