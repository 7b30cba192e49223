import pytest
from evaluate import one
from pyspark.sql import functions as F

from tidemark.functions import dates, ids, lifecycle, paths, runner, text


@pytest.mark.parametrize(
    "raw, want",
    [
        ("~OpenAI/gpt-4.1:free", "gpt-4-1"),
        ("  acme/Acme.X1  ", "acme-x1"),
        ("a/b/c:d/e", "c"),
        ("plain", "plain"),
        (" Wide.1﻿", "wide-1"),
    ],
)
def test_canonical(spark, raw, want):
    assert one(spark, ids.canonical_id, raw) == want


@pytest.mark.parametrize(
    "raw, want", [("m-2025-01-31", "m"), ("m-20250131", "m"), ("m-0613", "m-0613"), ("m-20250101-2025-01-01", "m")]
)
def test_family(spark, raw, want):
    assert one(spark, ids.family_id, raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("omni-moderation-1", "moderation"),
        ("text-embedding-3", "embedding"),
        ("x-embed", "embedding"),
        ("embedded", "chat"),
        ("gpt-tts", "tts"),
        ("whisper-1", "audio"),
        ("dall-e-3", "image"),
        ("images-2", "chat"),
    ],
)
def test_model_class(spark, raw, want):
    assert one(spark, ids.model_class, raw) == want
    assert one(spark, lambda c: ids.catalog_verifiable(ids.model_class(c)), raw) == (want in ("chat", "embedding"))


def test_entry_id_empty_date_is_undated(spark):
    assert one(spark, ids.entry_id, "p", "d", "") == "p.d.retirement-undated"
    assert one(spark, ids.entry_id, "p", "d", "2026-01-01") == "p.d.retirement-2026-01-01"


def test_dash_prefixes_stop_at_dashes(spark):
    assert one(spark, ids.dash_prefixes, "m-1-mini") == ["m", "m-1", "m-1-mini"]


@pytest.mark.parametrize(
    "cell, want",
    [
        ("shuts down 2026-10-23.", "2026-10-23"),
        ("2026‑10‑23", "2026-10-23"),
        ("Oct 23, 2026", "2026-10-23"),
        ("September 3,2026", "2026-09-03"),
        ("Sept. 3, 2026", "2026-09-03"),
        ("9999-99-99", "9999-99-99"),
        ("Foo 23, 2026", None),
        ("soon", None),
    ],
)
def test_shutdown_date(spark, cell, want):
    assert one(spark, dates.shutdown_date, cell) == want


def test_cell_text_entities(spark):
    assert one(spark, text.cell_text, "<td>A&nbsp;&amp;&lt;b&gt;&quot;&#8209;&#65;</td>") == 'A &<b>"‑A'
    assert one(spark, text.cell_text, "x&#99999999999999999999;y") == "x�y"


def test_normalize_for_hash_ignores_noise_only(spark):
    a = "<p>x</p><script nonce='1'>var a=1;</script> <style nonce=\"q\">"
    b = "<p>x</p><SCRIPT>other</SCRIPT >  <style>"
    norm = lambda s: one(spark, text.normalize_for_hash, s).lower()
    assert norm(a) == norm(b)
    assert norm(a) != norm(a.replace("<p>x", "<p>y"))


@pytest.mark.parametrize("limit", range(0, 12))
def test_utf8_prefix_keeps_whole_characters(spark, limit):
    word = "aé€😀b"
    got = one(spark, lambda c: text.utf8_prefix(c, limit), word)
    want = word.encode()[:limit].decode("utf-8", "ignore")
    assert got == want


def test_clamp_and_clip(spark):
    assert one(spark, text.clamp_excerpt, "x" * 240) == "x" * 240
    assert one(spark, text.clamp_excerpt, "x" * 241) == "x" * 237 + "..."
    clipped = one(spark, lambda c: text.clip_log(c, 10), "abcdefghijkl")
    assert clipped == "abcde\n<< 2 characters left out >>\nhijkl"


def test_requote(spark):
    assert one(spark, text.requote, "a'b\\c", "'") == "'a\\'b\\\\c'"


@pytest.mark.parametrize(
    "log, want",
    [
        ("Test Files  17 passed\nTests  2 failed | 8 passed", (8, 2)),
        ("5 passing\n1 failing", (5, 1)),
        ("7 passed in 0.1s", (7, 0)),
        ("nothing here", (None, None)),
    ],
)
def test_runner_counts(spark, log, want):
    assert (one(spark, runner.passed_count, log), one(spark, runner.failed_count, log)) == want


@pytest.mark.parametrize(
    "path, ts, py",
    [
        ("src/a.test.ts", True, False),
        ("src\\__tests__\\a.ts", True, False),
        ("tests/a.py", True, True),
        ("src/test_a.py", False, True),
        ("src/conftest.py", False, True),
        ("src/contest.ts", False, False),
        ("src/mock-db.ts", True, False),
        ("src/specials.ts", False, False),
    ],
)
def test_test_paths(spark, path, ts, py):
    assert one(spark, paths.is_ts_test_path, path) is ts
    assert one(spark, paths.is_py_test_path, path) is py


def test_every_test_path_match_contains_a_gate_word(spark):
    """The byte search in front of the patterns must never hide a match."""
    import re

    from tidemark import config as C

    samples = [f"{d}/x.ts" for d in (
        "__tests__ __mocks__ __fixtures__ test tests test-helper test-helpers test-utils testing mock mocks fixture fixtures e2e"
    ).split()] + ["a.vitest.ts", "a.spec.tsx", "a.e2e.mts", "a.test.cjs", "mock.db.ts", "x-mock.ts", "x.mocks.js"]
    for sample in samples:
        assert any(re.search(p, sample) for p in C.TS_TEST_PATTERNS), sample
        assert one(spark, paths.is_ts_test_path, sample) is True, sample


def test_strip_root_and_prefixes(spark):
    assert one(spark, lambda c: paths.strip_root(c, "Api"), "API.S.a") == "S.a"
    assert one(spark, paths.access_prefixes, "T.a.b") == ["T.a", "T.a.b"]
    assert one(spark, paths.access_prefixes, "T") == []


def test_lifecycle_gate_truth_table(spark):
    import itertools

    statuses = ["verified", "quarantined", "unverified", "unverifiable", None]
    flags = [True, False, None]
    rows = list(itertools.product(statuses, flags, flags, flags))
    df = spark.createDataFrame(rows, "v_status string, v_official boolean, v_replacement boolean, v_auto boolean")
    got = df.select("*", lifecycle.auto_apply_ok().alias("ok"), lifecycle.effective_state().alias("state")).collect()
    for r in got:
        ok = r.v_status == "verified" and bool(r.v_official and r.v_replacement and r.v_auto)
        assert r.ok is ok
        want = "unstamped" if r.v_status is None else r.v_status
        assert r.state == ("withheld" if want == "verified" and not ok else want)


def test_prose_never_moves_the_gate(spark):
    base = dict(v_status="verified", v_official=True, v_replacement=True, v_auto=True)
    for reasons in (["do not auto-apply"], ["stale"], None):
        schema = "v_status string, v_official boolean, v_replacement boolean, v_auto boolean, reasons array<string>"
        df = spark.createDataFrame([(*base.values(), reasons)], schema)
        assert df.select(lifecycle.auto_apply_ok().alias("ok")).first().ok is True


def test_older_than_days_is_strict_and_unreadable_is_old(spark):
    old = lambda s: one(spark, lambda c: dates.older_than_days(c, 30, "2025-12-01"), s)
    assert old("2025-11-01T00:00:00Z") is False
    assert old("2025-10-31T23:59:59Z") is True
    assert old("nonsense") is True


def test_access_prefix_sizes(spark):
    df = spark.createDataFrame([("a.b.c.d",)], "p string")
    assert df.select(F.size(paths.access_prefixes(F.col("p"))).alias("n")).first().n == 3
