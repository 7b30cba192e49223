"""Near-, substring and line deduplication, components and top-k search against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import components as cc
from tidemark.llm import line_dedup, near_dedup, substring_dedup, top_k
from tidemark.llm.common import lower_words, words


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# --- components -----------------------------------------------------------------------------------


def test_components(spark, monkeypatch):
    chance, sets = random.Random(1), Sets()
    links = [(chance.randrange(400), chance.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(1000, 1300)] + [(5, 5)]
    for a, b in links:
        sets.join(a, b)
    want = sorted((x, sets.find(x)) for x in {x for a, b in links for x in (a, b) if a != b})
    monkeypatch.setattr(cc, "HELD", 20)
    assert rows_of(cc.components(spark.createDataFrame(links, "a long, b long").repartition(7))) == sorted(want, key=repr)
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near duplicates ------------------------------------------------------------------------------


def near_classes(rows, width=4):
    shingles = defaultdict(set)
    for doc_id, text in rows:
        w = lower_words(text)
        shingles[doc_id] |= {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()
    sets = Sets()
    for a in shingles:
        sets.find(a)
        for b in shingles:
            common = len(shingles[a] & shingles[b])
            if a < b and common and 100 * common >= 80 * len(shingles[a] | shingles[b]):
                sets.join(a, b)
    return shingles, sets


@pytest.mark.parametrize("small, open_", [(64, 8), (1, 0)])
def test_near_duplicates(frame, monkeypatch, small, open_):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "OPEN", open_)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    chance, rows = random.Random(7), []
    for base in range(12):
        text = [f"w{chance.randrange(500)}" for _ in range(chance.randint(3, 80))]
        for _ in range(chance.randint(1, 9)):
            copy = list(text)
            for _ in range(chance.randint(0, 4)):
                copy[chance.randrange(len(copy))] = f"x{chance.randrange(500)}"
            rows.append((len(rows), " ".join(copy)))
    # A chain: each is near the next only.
    chain = [f"c{i}" for i in range(60)]
    for k in range(8):
        rows.append((len(rows), " ".join(chain[3 * k : 3 * k + 36])))
    chance.shuffle(rows)
    shingles, sets = near_classes(rows)
    want = sorted((d, len(shingles[d]), sets.find(d), sets.find(d) == d) for d, _ in rows)
    assert [tuple(r) for r in sorted(near_dedup.report(frame(rows)).collect())] == want
    assert len({sets.find(d) for d, _ in rows}) < len(rows)


def test_pairs_are_decided_on_full_sets_however_few_registers_agree(frame):
    # 1125 shingles each, 1000 of 1250 in common: 0.80 exactly, but no more than 84 of 128 registers agree.
    rows = []
    for start in (113760, 1535280, 3881280, 4494920):
        rows += [(len(rows) + k, " ".join(str(i) for i in range(start + 125 * k, start + 125 * k + 1128))) for k in (0, 1)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.report(frame(rows)).collect()}
    assert got == {d: (1125, d - d % 2) for d in range(8)}


def test_near_duplicates_of_odd_rows(odd, empty):
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.report(odd).collect()}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (9, 4, False), (None, None, None)} <= got
    assert near_dedup.report(empty).count() == 0
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 3, 4, 6, 7, 8, 10, 11, 12, None, None])


def test_rows_that_repeat_an_id_stay_once(frame):
    kept = near_dedup.keep_one(frame([(3, "one two three four five six"), (3, "one two three four five six"), (3, "other"), (8, "lone")]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8]


def test_signatures_estimate_similarity():
    chance = np.random.default_rng(1)
    found = []
    for _ in range(60):
        u = chance.integers(0, 1 << 62, 200).astype(np.uint64)
        s = near_dedup.signatures([u[:120], u[30:150], u[:1], u[:5]])
        assert (near_dedup.signatures([u[30:150]])[0] == s[1]).all() and (s != np.uint64(2**64 - 1)).all()
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 0.6) < 0.02 and np.std(found) < 0.043


# --- repeated passages ----------------------------------------------------------------------------


def without_windows(rows, n=35):
    texts = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in texts for i in range(len(w) - n + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = {k for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for k in range(i, i + n)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [4096, 1])
def test_passages(frame, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "STEP", 200)
    chance = random.Random(3)
    make = lambda n: [f"v{chance.randrange(3000)}" for _ in range(n)]
    passages = [make(n) for n in (34, 35, 36, 60, 200)]
    rows = []
    for i in range(40):
        parts = [make(chance.randint(0, 40))]
        for _ in range(chance.randint(0, 3)):
            parts += [chance.choice(passages), make(chance.randint(0, 20))]
        rows.append((i, chance.choice([" ", "\n", "  "]).join(w for p in parts for w in p)))
    rows += [(100, "same " * 80), (101, rows[0][1]), (102, " ".join(make(20) * 4))]
    assert rows_of(substring_dedup.report(frame(rows))) == without_windows(rows)


def test_passages_of_odd_rows(odd, empty):
    assert rows_of(substring_dedup.report(odd)) == without_windows(pairs(odd))
    assert substring_dedup.report(empty).count() == 0
    cut = substring_dedup.dedup(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert {r.text for r in cut.where("doc_id in (4, 5)").collect()} == {""} and cut.where("doc_id = 1").first().text is None


def test_anchor_of_equal_windows_is_equal():
    chance = np.random.default_rng(4)
    codes = chance.integers(0, 50, 400).astype(np.uint64)
    moved = np.concatenate((chance.integers(60, 99, 17).astype(np.uint64), codes))
    (_, a), (_, b) = substring_dedup.anchors(codes), substring_dedup.anchors(moved)
    assert (a == b[17:] - 17).all() and len(a) == 400 - 34


# --- lines ----------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changed(text, edits, chance):
    text = list(text)
    for _ in range(edits):
        at, how = chance.randrange(max(1, len(text))), chance.randrange(3)
        text[at : at + (how != 2)] = [] if how == 1 else [chance.choice("abcé")]
    return "".join(text)


def deduplicated(rows, edits=2, shortest=24):
    lines = [(d, i, s) for d, t in sorted(set(rows)) for i, s in enumerate((t or "").split("\n")) if s.strip()]
    names, sets = sorted({s for *_, s in lines}), Sets()
    for a in names:
        sets.find(a)
        for b in names:
            if a < b and min(len(a), len(b)) >= shortest and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                sets.join(a, b)
    first, gone = {}, defaultdict(set)
    for d, i, s in lines:
        if first.setdefault(sets.find(s), (d, i)) != (d, i):
            gone[d].add(i)
    sizes = Counter(d for d, *_ in lines)
    kept = {d: "\n".join(s for i, s in enumerate((t or "").split("\n")) if i not in gone[d]) for d, t in rows}
    return sorted(((d, sizes[d], len(gone[d]), hashlib.sha256(kept[d].encode()).hexdigest()) for d, _ in rows), key=repr)


@pytest.mark.parametrize("hot", [32, 1])
def test_lines(frame, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    chance = random.Random(11)
    bases = ["".join(chance.choices("abcé ", k=chance.randint(20, 60))) + "." for _ in range(12)]
    rows = [(i, "\n".join(changed(chance.choice(bases), chance.randint(0, 3), chance) if chance.random() < 0.9 else "" for _ in range(chance.randint(0, 6)))) for i in range(40)]
    want = deduplicated(rows)
    assert rows_of(line_dedup.report(frame(rows))) == want
    assert sum(r[2] for r in want) > 20


def test_buckets_hand_on_hot_keys(spark):
    """Whatever leaves a bucket early, all pairs of an index line and another line under a key come out once, or all lines of the key."""
    chance = np.random.default_rng(4)
    key = np.concatenate((chance.integers(0, 400, 3000), np.full(800, 7), np.full(900, 8), chance.integers(1000, 9000, 800))).astype(np.uint64)
    row = chance.integers(-500, 500, len(key))
    index = (chance.random(len(key)) < 0.3) & (key != 8)
    order = chance.permutation(len(key))
    for room in (100, 10**6):
        bucket, pairs_, members = line_dedup.Bucket(300, room), set(), {}
        outs = []
        for part in np.array_split(order, 40):
            for flag in (True, False):
                one = part[index[part] == flag]
                outs.append(bucket.add(key[one].tobytes() + row[one].tobytes(), flag))
            if bucket.held > bucket.room:
                outs.append(bucket.condense())
        outs.append(bucket.close())
        for out in (o for o in outs if o is not None):
            for a, b, k in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if k is None:
                    pairs_.add((a, b))
                else:
                    members.setdefault(k, set()).add((a, b))
        assert 7 in members and (room > 1000 or 8 in members)
        for k in np.unique(key).tolist():
            left, right = set(row[(key == k) & index].tolist()), set(row[key == k].tolist())
            if k in members:
                assert {a for a, _ in members[k]} == right and {a for a, b in members[k] if b} == left
            else:
                assert {(min(a, b), max(a, b)) for a in left for b in right if a != b} <= pairs_


@pytest.mark.parametrize("entries", [500, 10**6])
def test_lines_by_hot_keys_and_small_buckets(frame, monkeypatch, entries):
    for name, value in (("HOT", 3), ("BLOCK", 8), ("ENTRIES", entries), ("HELD", 60), ("FLUSHED", 90), ("SLICE", 300)):
        monkeypatch.setattr(line_dedup, name, value)
    chance = random.Random(12)
    bases = ["".join(chance.choices("abcé ", k=chance.randint(24, 40))) + "." for _ in range(3)]
    rows = [(i, "\n".join(changed(chance.choice(bases), chance.randint(0, 4), chance) for _ in range(3))) for i in range(60)]
    assert rows_of(line_dedup.report(frame(rows))) == deduplicated(rows)


def test_lines_of_odd_rows(odd, empty):
    want = deduplicated([r for r in pairs(odd) if r[0] is not None and r[0] not in (4, 5, 9)])
    got = [r for r in rows_of(line_dedup.report(odd)) if r[0] is not None and r[0] not in (4, 5, 9)]
    assert got == want
    assert line_dedup.report(empty).count() == 0
    cut = line_dedup.dedup(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    texts = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    assert texts[11] == "the same line of text in here\nanother line of text in here" and texts[12] == "x" and texts[5] == ""


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_distance_and_keys(edits):
    chance = random.Random(edits)
    texts = ["".join(chance.choices("abcé", k=chance.randint(1, 70))) for _ in range(800)]
    both = [(t, changed(t, chance.randint(0, 5), chance)) for t in texts]
    assert line_dedup.within(both, edits).tolist() == [distance(a, b) <= edits for a, b in both]
    for a, b in both:
        if min(len(a), len(b)) >= 24 and distance(a, b) <= edits:
            lines, starts, codes = line_dedup.split_lines(f"{a}\n{b}")
            index, probes = line_dedup.keys(codes, starts, line_dedup._sizes(starts, codes), edits)
            low, high = (0, 1) if len(a) <= len(b) else (1, 0)
            assert set(index[low].tolist()) & set(probes[high].tolist())


# --- top k ----------------------------------------------------------------------------------------


def best(rows, k=20):
    vectors = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            impacts = tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)
            vectors[i] = min(vectors.get(i, impacts), impacts)
    out = []
    for q in vectors:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(vectors[q], w, strict=True)), i) for i, w in vectors.items() if i != q and len(w) == len(vectors[q]))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [8192, 16])
def test_top_k(spark, monkeypatch, size):
    monkeypatch.setattr(top_k, "VECTOR_BLOCK", size)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 4)
    chance = np.random.default_rng(5)
    rows = [(i, chance.normal(0, 0.3, 8).tolist()) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(60)]  # ties
    rows += [(300, None), (301, []), (320, [float("nan")] * 8), (340, [float("inf")] + [0.0] * 7), (360, [None] * 8), (None, rows[0][1])]
    rows += [(20, rows[20][1]), (20, [0.0] * 8), (380, [0.0] * 8), (400, [1.0, 2.0]), (401, [2.0, 1.0]), (420, [3e5] * 8), (421, [-3e5] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k.report(df).collect()) == best(rows)


def test_top_k_of_wide_values_and_of_nothing(spark):
    rows = [(i, [float(10**6 * i), 3.0e7, -1.0e6 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in top_k.report(df).collect()) == best(rows)
    assert top_k.report(df.limit(0)).count() == 0


def test_stopping_early_is_exact():
    chance = np.random.default_rng(9)
    centres = chance.normal(0, 20, (40, 32))
    vectors = np.floor(centres[chance.integers(0, 40, 3000)] + chance.normal(0, 2, (3000, 32))).astype(np.int64)
    ids = chance.permutation(3000)
    index = top_k.ImpactIndex(ids, vectors)
    q, found, scores = index.best(ids[:64], vectors[:64], 20)
    for k in range(64):
        want = sorted((-int(vectors[k] @ vectors[j]), int(ids[j])) for j in range(3000) if j != k)[:20]
        assert [(-s, i) for s, i in zip(scores[q == k].tolist(), found[q == k].tolist(), strict=True)] == want
