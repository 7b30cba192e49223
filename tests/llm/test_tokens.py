"""Token operators against the libraries that they stand for."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import bpe, merges, pieces, token_counts, token_files

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [
    "", "a", "  ", "a  b", "a \n b", "\n\n x", "x \n", "it's we'll  I'M", "\x1c\x1d a\x85b\xa0c", "日本語 テスト  é́", "a" * 3000, " " * 300 + "x",
    "<|endoftext|> x\n <|endoftext|>", "a\n <|startoftext|>b", "\t\t a\tb \t", "ab" * 700, "😀👍🏽 ok", "Σίσυφος ΟΔΥΣΣΕΥΣ İ ǅ", "é ́a", "a\x00b \x1f c",
]


@pytest.fixture(scope="module")
def texts(spark, sf):
    letters, chance = list(" \n\tab'sé1.,;   \x1c日"), random.Random(1)
    made = ["".join(chance.choices(letters, k=chance.randint(1, 60))) for _ in range(1500)]
    return ODD + made + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def public():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def split(ids, sizes):
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


def test_byte_bpe_equals_tiktoken(texts, public):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    got = split(*codec.encode(texts))
    assert got == [public.encode_ordinary(t) for t in texts]
    assert all(codec.decode(np.array(ids, int)) == t.encode() for ids, t in zip(got, texts, strict=True))


def test_forgetting_pieces_changes_nothing(texts, public, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 50)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for k in range(0, 600, 20):
        assert split(*codec.encode(texts[k : k + 20])) == [public.encode_ordinary(t) for t in texts[k : k + 20]]


def test_word_counts_equal_the_library(texts):
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    want = [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(WORD).of([t.encode() for t in texts]) == want


def test_byte_level_encoder_equals_the_library(texts):
    tokenizer = Tokenizer.from_file(BYTE)
    want = [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert split(*token_files.Encoder(BYTE).encode(texts, 2)) == want


def test_long_sequences_merge_in_the_same_order():
    codec, chance = bpe.Codec(RANKS, public_tokenizers.PATTERN), random.Random(5)
    parts = ["".join(chance.choices("thesandro", k=chance.randint(2, 200))).encode() for _ in range(300)]
    matrix = codec.merge(parts)
    for part, ids in zip(parts, matrix, strict=True):
        if codec.ranks.get(part) is None:
            assert merges.merge_long(codec.byte[np.frombuffer(part, np.uint8)], codec.table) == ids


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = token_files.key_hash(np.arange(5000) * 7, np.zeros(5000, bool), np.zeros(5000, int))
    hashed = token_files.PerfectHash.load(token_files.PerfectHash.build(keys).dump())
    assert sorted(hashed.find(keys)) == list(range(5000))
    others = token_files.key_hash(np.arange(5000) * 7 + 1, np.zeros(5000, bool), np.zeros(5000, int))
    found = hashed.find(others)
    same = (found >= 0) & (token_files.fingerprint(others) == token_files.fingerprint(keys[np.argsort(hashed.find(keys))])[found])
    assert not same.any()


def test_token_files_round_trip(odd):
    rows = [tuple(r) for r in token_files.report(odd, BYTE).collect()]
    tokenizer = Tokenizer.from_file(BYTE)
    source = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in odd.collect()))
    ids = {k: [*tokenizer.encode(k[2], add_special_tokens=False).ids, 2] for k in source}
    want = sorted(((k[1] if k[0] else None), len(ids[k]), zlib.crc32(np.array(ids[k], "<u4").tobytes())) for k in source if k[0])
    assert sorted((d, n, c) for d, _, n, c in rows if d is not None) == want
    assert len(rows) == len(source)
    # Each document starts where those before it end.
    ends = 0
    for start, n in sorted((s, n) for _, s, n, _ in rows):
        assert start == ends
        ends = start + n
    by_id = sorted(((d, s) for d, s, _, _ in rows if d is not None), key=lambda x: x[1])
    assert [d for d, _ in by_id] == sorted(d for d, _ in by_id)


def test_keyed_lookup(spark, frame, tmp_path):
    manifest = token_files.write(frame([(5, "five"), (7, "seven"), (7, "seven again"), (None, "none")]), BYTE, str(tmp_path / "shards"))
    files = [r.file for r in manifest.collect()]
    tokenizer = Tokenizer.from_file(BYTE)
    both = {tuple(token_files.lookup(spark, files, 7, k)) for k in (0, 1)}
    assert both == {(*tokenizer.encode(t).ids, 2) for t in ("seven", "seven again")}
    assert list(token_files.lookup(spark, files, None)) == [*tokenizer.encode("none").ids, 2]
    assert token_files.lookup(spark, files, 6) is None


def test_reports_on_odd_rows(odd, public):
    rows = bpe.report(odd, RANKS, public_tokenizers.PATTERN).collect()
    want = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in rows} == want and len(rows) == odd.count()
    counts = {(r.doc_id, r.n_bytes, r.n_tokens > 2048) for r in token_counts.report(odd, WORD).collect()}
    assert {(d, n) for d, n, _ in counts} == {(r.doc_id, len((r.text or "").encode())) for r in odd.collect()}
    assert (6, True) in {(d, o) for d, _, o in counts}


def test_encode_then_decode(odd):
    encoded = bpe.encode(odd, RANKS, public_tokenizers.PATTERN)
    plain = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(bytes(r.bytes) for r in plain) == sorted((r.text or "").encode() for r in odd.collect())


def test_empty_tables(empty):
    assert bpe.report(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert token_counts.report(empty, WORD).count() == 0
    assert token_files.report(empty, BYTE).count() == 0
