import json

from pyspark.sql import functions as F

from tidemark.operators import discovery, promotion, registry as R, verdicts
from tidemark.sources import catalogs, registry as source

GOOD = {
    "provider": "acme", "kind": "model_id", "deprecated": "m-1", "replacement": "m-2", "status": "retired",
    "verification": {"status": "verified", "officialSourceConfirmed": True, "replacementConfirmed": True,
                     "autoApplyAllowed": True, "quarantineReason": None, "reasons": ["x"]},
    "evidence": [{"sourceUrl": "u", "contentHash": "sha256:" + "a" * 64, "retrievedAt": "t", "excerpt": "m-1"}],
}


def broken(**change):
    out = json.loads(json.dumps(GOOD))
    for path, value in change.items():
        node = out
        *parents, last = path.split("__")
        for p in parents:
            node = node[int(p)] if p.isdigit() else node[p]
        if value is ...:
            del node[last]
        else:
            node[last] = value
    return out


CASES = [
    (GOOD, []),
    (broken(verification=...), []),
    (broken(verification__autoApplyAllowed=...), []),
    (broken(verification__autoApplyAllowed="true"), ["invalid_switch_autoApplyAllowed"]),
    (broken(verification__status="ok"), ["invalid_verification_status"]),
    (broken(verification__status="quarantined"), ["quarantine_without_reason"]),
    (broken(verification=None), ["invalid_verification"]),
    (broken(verification__reasons="x"), ["invalid_reasons"]),
    (broken(replacement=""), ["invalid_replacement"]),
    (broken(status=None), ["invalid_status"]),
    (broken(shutdownDate=None, sourceUrl=None, entryId=None), []),
    (broken(entryId=""), ["invalid_entry_id"]),
    (broken(evidence=[]), ["empty_evidence"]),
    (broken(evidence={}), ["invalid_evidence"]),
    (broken(evidence__0__contentHash="sha256:" + "A" * 64), ["malformed_content_hash"]),
    (broken(evidence__0__excerpt="x" * 241), ["excerpt_too_long"]),
    (broken(evidence__0__retrievedAt=""), ["invalid_evidence_field"]),
    ({"provider": "a", "kind": "param_removal", "param": "t", "on_models": ["m"]}, []),
    ({"provider": "a", "kind": "param_removal", "param": "t", "on_models": ["m", ""]}, ["invalid_on_models"]),
    ({"provider": "a", "kind": "param_rename", "param": "t", "on_models": ["m"]}, ["invalid_param_replacement"]),
    ([1], ["not_an_object"]),
]


def test_shape_rules(spark):
    raw = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(CASES)], "ord int, record string")
    got = {r.ord: r.problems for r in R.check_records(raw).collect()}
    for i, (record, want) in enumerate(CASES):
        assert got[i] == want, record


def test_registry_file_round_trip(spark, tmp_path):
    (tmp_path / "reg.json").write_text(json.dumps([GOOD, broken(replacement=""), broken(verification__autoApplyAllowed=...)]))
    valid, rejects = source.load_registry(spark, str(tmp_path / "reg.json"))
    rows = {r.ord: r for r in valid.collect()}
    assert sorted(rows) == [0, 2] and rejects.count() == 1
    assert rows[0].v_auto is True and rows[2].v_auto is False
    assert source.evidence_refs(valid).count() == 2


def test_records_of_many_files_keep_their_order(spark, tmp_path):
    for name in ("b", "a", "c"):
        both = [{**GOOD, "note": f"{name}{i}"} for i in (0, 1)]
        (tmp_path / f"{name}.json").write_text(json.dumps(both))
    valid, _ = source.load_registry(spark, str(tmp_path))
    assert [r.note for r in valid.orderBy("ord").collect()] == ["a0", "a1", "b0", "b1", "c0", "c1"]
    assert valid.select("ord").distinct().count() == 6


def test_candidate_rules(spark):
    extra = {"candidateId": "a", "proposedBy": "human", "proposedAt": "2025-01-01"}
    rows = [{**GOOD, **extra}, {**GOOD, **extra}, {**GOOD, **extra, "candidateId": "b", "proposedBy": "bot"}]
    raw = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "ord int, record string")
    got = {r.ord: r.problems for r in R.check_candidates(raw).collect()}
    assert got == {0: ["duplicate_candidate_id"], 1: ["duplicate_candidate_id"], 2: ["invalid_proposer"]}


def test_strict_mode_fails(spark):
    import pytest

    raw = spark.createDataFrame([(0, json.dumps(broken(replacement="")))], "ord int, record string")
    _, rejects = R.split_valid(R.check_records(raw), strict=True)
    with pytest.raises(Exception, match="invalid_replacement"):
        rejects.select("problems").collect()


def _live(spark, *names):
    return catalogs.live_forms(spark.createDataFrame([(n,) for n in names], "id string"))


def test_verdict_order(spark):
    official = catalogs.official_table(
        spark.createDataFrame([("old", "new"), ("gone", "next")], "deprecated string, recommended string")
    )
    rows = [
        ("old-tts-1", "gone", "unverifiable"),
        ("a", "gone", "unverified"),
        ("a", "missing", "unverified"),
        ("old", "other", "unverified"),
        ("old", "New", "verified"),
        ("a", "other-20250101", "verified"),
    ]
    df = spark.createDataFrame(rows, "deprecated string, replacement string, want string")
    for r in verdicts.classify(df, _live(spark, "new", "other"), official).collect():
        assert r.verdict == r.want, r


def test_merge_reasons_is_idempotent(spark):
    df = spark.createDataFrame([(["live: a", "by hand", "official is b", "by hand"],)], "prior array<string>")
    fresh = F.array(F.lit("live: a"))
    once = verdicts.merge_reasons(fresh, F.col("prior"))
    twice = verdicts.merge_reasons(fresh, once)
    row = df.select(once.alias("a"), twice.alias("b")).first()
    assert row.a == row.b == ["live: a", "by hand", "by hand"]


def test_chains_and_cycles(spark):
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(21)] + [("x", "y"), ("y", "x"), ("into", "x"), ("self", "self")]
    table = catalogs.official_table(spark.createDataFrame(pairs, "deprecated string, recommended string"))
    got = {r.dep_canon: r for r in verdicts.chain_ends(table).collect()}
    for i in range(21):
        assert (got[f"n{i}"].hops, got[f"n{i}"].final, got[f"n{i}"].cyclic) == (21 - i, "n21", False)
    for k in ("x", "y", "into", "self"):
        assert got[k].cyclic and got[k].final is None


def test_claim_liveness_is_canonical_only(spark):
    cand = spark.createDataFrame(
        [("c1", "m-20240101", "retired", None), ("c2", "m", "retired", None)],
        "candidate_id string, deprecated string, status string, shutdown_date string",
    )
    refs = spark.createDataFrame(
        [("c1", "m-20240101", "M.20240101 retires", "sha256:" + "a" * 64), ("c2", "m", "m", "sha256:" + "a" * 64)],
        "candidate_id string, deprecated string, excerpt string, content_hash string",
    )
    stored = spark.createDataFrame([("a" * 64,)], "doc_key string")
    got = {r.candidate_id: r.claim_reasons for r in promotion.claim_reasons(cand, refs, stored, _live(spark, "m")).collect()}
    assert got == {"c1": [], "c2": ["retired_but_live"]}


HTML = """
<table><tr><th>Shutdown date</th><th>Model</th><th>Recommended replacement</th></tr>
<tr><td>2026‑01‑02</td><td><code>gpt-4-0613</code></td><td>gpt-5*</td></tr>
<tr><td>Oct 23, 2026</td><td>gpt-4-a, gpt-4-b</td><td>gpt-5-x</td></tr>
<tr><td></td><td>gpt-4-c</td><td>contact us</td></tr>
<tr><td></td><td>gpt-4-d</td><td>gpt-5-a or gpt-5-b</td></tr>
<tr><td></td><td>gpt-4.1-e</td><td>GPT-4-1-e</td></tr>
<tr><td colspan=3>Section</td></tr>
<tr><td>soon</td><td>gpt-4-f (gpt-4-f)</td><td>gpt-5-x</td></tr></table>
<table><tr><th>Model</th><th>Substitute</th><th>Replacement</th></tr><tr><td>gpt-1-a</td><td>b</td><td>c</td></tr></table>
<table><tr><th>Model</th><th>Old model</th><th>Replacement</th></tr><tr><td>gpt-1-a</td><td>b</td><td>c</td></tr></table>
<table><tr><th>Model price</th><th>Model</th><th>Substitute</th></tr><tr><td>1</td><td>gpt-9-a</td><td>gpt-9-b</td></tr></table>
<table><tr><th>Model</th></tr></table>
"""


def test_discovery_golden_page(spark):
    pages = spark.createDataFrame([(1, "openai", 0, "u", HTML)], "page_id int, provider string, provider_pos int, url string, html string")
    rows = [(r.deprecated, r.replacement, r.shutdown_date) for r in discovery.readable_rows(pages).collect()]
    assert sorted(rows, key=str) == [
        ("gpt-4-0613", "gpt-5", "2026-01-02"),
        ("gpt-4-f", "gpt-5-x", None),
        ("gpt-9-a", "gpt-9-b", None),
    ]
    skips = sorted(r.skip for r in discovery.skipped_rows(pages).collect())
    assert skips == sorted(
        ["several_models", "no_replacement", "several_replacements", "maps_to_itself", "replacement_columns", "model_columns"]
    )
    again = sorted(map(tuple, discovery.table_rows(pages).collect()), key=repr)
    assert again == sorted(map(tuple, discovery.table_rows(pages).collect()), key=repr)


def test_discovery_proposes_each_id_once(spark):
    pages = spark.createDataFrame(
        [(1, "openai", 1, "u1", HTML), (2, "openai", 0, "u0", HTML)],
        "page_id int, provider string, provider_pos int, url string, html string",
    )
    registry = spark.createDataFrame([("model_id", "OpenAI/GPT.9.a")], "kind string, deprecated string")
    queue = spark.createDataFrame([], "deprecated string")
    got = discovery.discover(pages, registry, queue, "2026-01-02T10:00:00Z").collect()
    assert len({r.candidate_id for r in got}) == len(got)
    assert {r.source_url for r in got} == {"u0"}
    by_id = {r.deprecated: r for r in got}
    assert "gpt-9-a" not in by_id
    assert by_id["gpt-4-0613"].status == "retired" and by_id["gpt-4-f"].status is None
