"""Importance resampling and ranked lexical search against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lexical, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def pairs(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def resampled(docs, items):
    def counts(texts):
        return Counter(zlib.crc32(w.encode()) % 10_000 for t in texts for w in words(t))

    s, t = counts(x for _, x in docs), counts(x for _, x in items)
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + 10_000) / ((s[b] + 1.0) * (t_all + 10_000))))
    out = []
    for doc_id, text in docs:
        g = [gain(zlib.crc32(w.encode()) % 10_000) for w in words(text)]
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: len(able) * 10 // 100], 1):
        row[4] = rank
    return out


def test_resample_documents(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = resampled(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert key(resample.report(docs, items).collect()) == key(want)
    assert sum(r[4] is not None for r in want) == 19 or any(r[4] for r in want)


def test_resample_odd_rows(spark, odd, empty, frame):
    items = spark.createDataFrame([(1, "tok1 tok2 TOK3"), (2, None), (None, ""), (3, "é 漢字")], "item_id long, text string")
    want = resampled(pairs(odd, "doc_id", "text"), pairs(items, "item_id", "text"))
    got = resample.report(odd, items)
    assert key(r[:4] for r in got.collect()) == key(r[:4] for r in want)
    assert got.where("rank is not null").count() == sum(r[4] is not None for r in want)
    drawn = resample.resample(odd, items, percent=50).where("rank is not null").collect()
    assert sorted(r.rank for r in drawn) == list(range(1, len(drawn) + 1)) and len(drawn) == sum(r[1] >= 20 for r in want) // 2
    chosen = resample.select(odd, items, percent=50)
    assert chosen.columns == odd.columns and {r.doc_id for r in chosen.collect()} == {r.doc_id for r in drawn}
    assert resample.report(empty, items).count() == 0
    assert resample.report(odd, items.limit(0)).count() == odd.count()


def test_longer_runs_are_features(frame):
    row = resample.resample(frame([(1, "a b c")]), frame([(1, "b c")]), runs=2).first()
    assert row.n_features == 5


@pytest.mark.parametrize("rows, parts", [(1, 1), (7, 3), (400, 5)])
def test_cutoff_is_the_kth_key(spark, monkeypatch, rows, parts):
    monkeypatch.setattr(resample, "NARROWED", 3)
    chance = random.Random(rows)
    # A third of the rows are copies of one key but for their place.
    made = [(5 if chance.random() < 0.33 else chance.randrange(20), chance.randrange(3), n) for n in range(rows)]
    df = spark.createDataFrame(made, "a long, b long, n long").repartition(parts)
    df = df.select(F.col("a").alias("k0"), F.lit(0).cast("long").alias("k1"), F.col("b").alias("k2"), F.lit(0).cast("long").alias("k3"), F.col("n").alias("k4")).persist()
    order = sorted((a, 0, b, 0, n) for a, b, n in made)
    for k in {1, rows, rows // 3 or 1}:
        assert resample.cutoff(df, k) == order[k - 1]
    assert resample.cutoff(df, 0) is None and resample.cutoff(df, rows + 1) is None
    df.unpersist()


def test_pivot_leaves_a_share_on_both_sides():
    chance = random.Random(1)
    for _ in range(50):
        parts = [sorted(chance.sample(range(10_000), chance.randint(1, 60))) for _ in range(chance.randint(1, 12))]
        pivot = resample.weighted_median([((p[(len(p) - 1) // 2],), len(p)) for p in parts])[0]
        every = [x for p in parts for x in p]
        assert sum(x <= pivot for x in every) * 4 >= len(every)
        assert sum(x >= pivot for x in every) * 4 >= len(every)


def ranked(docs, items, k=20):
    held = [(d, words(t)) for d, t in docs if words(t)]
    n_docs, n_terms = len(held), sum(len(w) for _, w in held)
    freq = [Counter(w) for _, w in held]
    df = Counter(t for f in freq for t in f)
    asked = {}
    for item_id, text in items:
        asked.setdefault(item_id, Counter()).update(words(text))
    out = []
    for item_id, terms in asked.items():
        found = []
        for (doc_id, w), f in zip(held, freq):
            m = 75 + 25 * len(w) * n_docs // n_terms
            score = 0
            for term, times in terms.items():
                if f[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += times * weight * (1_000_000_000 * f[term] // (1000 * f[term] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item_id, rank, x[2], -x[0]) for rank, x in enumerate(found[:k], 1)]
    return out


@pytest.fixture(scope="module")
def given(spark, sf):
    return [spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark")]


def test_search_documents(given):
    docs, items = given
    want = ranked(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert key(lexical.search(docs, items).collect()) == key(want)


def test_small_blocks_and_bundles_give_the_same(given, monkeypatch):
    docs, items = given
    want = ranked(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"), 3)
    monkeypatch.setattr(lexical, "BUNDLE", 7)
    monkeypatch.setattr(lexical, "LONG", 30)
    assert key(lexical.search(docs.repartition(5), items, 3).collect()) == key(want)


def test_search_odd_rows(spark, odd, empty, frame):
    items = spark.createDataFrame(
        [(1, "TOK5 tok6 tok5"), (1, "tok7"), (2, None), (3, ""), (4, "nowhere at all"), (None, "a c"), (5, "漢字 a"), (6, " ".join(f"w{i}x{i}" for i in range(6000)))],
        "item_id long, text string",
    )
    want = ranked(pairs(odd, "doc_id", "text"), pairs(items, "item_id", "text"), 4)
    assert key(lexical.search(odd, items, 4).collect()) == key(want)
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


def test_documents_leave_only_on_proof():
    """An owner ahead can add 50: what is more than 50 behind the second best goes, a tie stays."""
    carried = pa.table(
        {"block": [1], "bundle": [0], "item": [0], "docs": [[0, 1, 2, 3]], "score": [[100, 90, 40, 39]]},
        schema=lexical._CARRIED,
    )
    postings = pa.table(
        {"block": [1], "bundle": [0], "docs": [[5]], "tf": [[1]], "n": [[1]], "item": [[0]], "gain": [[0]], "rest": [[50]]},
        schema=pa.schema([("block", pa.int64()), ("bundle", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("docs", "tf", "n", "item", "gain", "rest"))]),
    )
    out = lexical.pass_owner(carried, postings, 10, 10, 2, False)
    assert out.column("docs").to_pylist() == [[0, 1, 2]]
    assert lexical.pass_owner(carried, postings, 10, 10, 2, True).column("docs").to_pylist() == [[0, 1]]


def test_blocks_are_bounded():
    block = lexical.Block(np.full(lexical.SIEVE_BITS >> 3, 255, np.uint8))
    for doc_id in range(lexical.BLOCK_DOCS):
        assert not block.full()
        block.add(doc_id, [b"x"])
    assert block.full()
    rows = block.rows(0)
    assert rows.num_rows == 2 and len(rows.column("docs")[1].as_py()) == lexical.BLOCK_DOCS
