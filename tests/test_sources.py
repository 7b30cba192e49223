import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.operators import report, tiers
from tidemark.plans import registry_cycle
from tidemark.sources import catalogs, files, registry as source, specs, store


def test_read_sources_keeps_scope(spark, tmp_path):
    for name, text in {
        "repo1/src/a.ts": "const a = 1;\nconst b = 2;",
        "repo1/src/a.d.ts": "x",
        "repo1/node_modules/lib/b.ts": "x",
        "repo1/tests/c.py": "x",
        "repo2/pkg/d.py": "d = 1",
        "repo2/readme.md": "x",
        "repo2/dist/e.ts": "x",
    }.items():
        path = tmp_path / "src-root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    got = {(r.repo, r.path, r.lang): r.text for r in files.read_sources(spark, str(tmp_path / "src-root")).collect()}
    assert got == {
        ("repo1", "src/a.ts", "ts"): "const a = 1;\nconst b = 2;",
        ("repo2", "pkg/d.py", "py"): "d = 1",
    }


def test_catalog_payloads(spark):
    rows = [
        (json.dumps({"data": [{"id": "~openai/gpt-4.1:free"}, {"id": "OpenAI/x"}, {"id": "host/gpt"}, {"id": "bare"}]}),),
        (json.dumps([{"id": "google/gemini-1-20250101"}]),),
    ]
    ids = catalogs.first_party(catalogs.aggregator_ids(spark.createDataFrame(rows, "payload string")))
    assert sorted(r.id for r in ids.collect()) == ["gemini-1-20250101", "gpt-4.1"]
    assert sorted(r.form for r in catalogs.live_forms(ids).collect()) == ["gemini-1", "gemini-1-20250101", "gpt-4-1"]
    nested = [(json.dumps({"openai": {"models": {"a": {}, "b": {"x": 1}}}, "other": {"models": {"c": {}}}, "google": {}}),)]
    got = catalogs.provider_map_ids(spark.createDataFrame(nested, "payload string"))
    assert sorted(r.id for r in got.collect()) == ["a", "b"]
    assert catalogs.official_recommendations(spark).where("dep_canon = 'gpt-3-5-turbo-0613'").first().recommended == "gpt-3.5-turbo"


def test_flatten_reads_files(spark, tmp_path):
    doc = {"components": {"schemas": {"S": {"properties": {"p": {"type": ["b", "a"], "enum": [1, "x"]}, "q": {"properties": {}}}}}}}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    rows = {r.name: r for r in specs.flatten_specs(specs.read_specs(spark, str(tmp_path), "api", "A")).collect()}
    assert rows["p"].type == "a|b" and rows["p"].enum == ["1", "x"] and rows["p"].parent == "S"
    assert rows["q"].type == "object" and rows["q"].is_object and rows["S"].depth == -1


def test_promotion_is_saved_as_new_versions(spark, tmp_path):
    cols = (
        "ord long, kind string, provider string, deprecated string, replacement string, status string, shutdown_date string, "
        "source_url string, entry_id string, v_status string, v_official boolean, v_replacement boolean, v_auto boolean, "
        "quarantine_reason string, checked_at string, reasons array<string>"
    )
    reg = spark.createDataFrame([(4, "model_id", "p", "old", "new") + (None,) * 11], cols)
    cand = spark.createDataFrame(
        [("c1", "p", "m-1", "new", "retired", None, "u"), ("c2", "p", "M.1", "new", "retired", None, "u"), ("c3", "p", "old", "new", "retired", None, "u")],
        "candidate_id string, provider string, deprecated string, replacement string, status string, shutdown_date string, source_url string",
    )
    refs = spark.createDataFrame(
        [(c, d, f"row {d}", "sha256:" + "b" * 64) for c, d in (("c1", "m-1"), ("c2", "M.1"), ("c3", "old"))],
        "candidate_id string, deprecated string, excerpt string, content_hash string",
    )
    requests = spark.createDataFrame([(1, "c2"), (2, "c1"), (3, "c2"), (4, "c3"), (5, "nope")], "pos long, candidate_id string")
    stored = spark.createDataFrame([("b" * 64,)], "doc_key string")
    live = catalogs.live_forms(spark.createDataFrame([("new",)], "id string"))
    official = spark.createDataFrame([], "dep_canon string, recommended string")
    out = registry_cycle.promote_and_save(
        requests, cand, reg, refs, stored, live, official, "2026-01-01", ["cat"],
        str(tmp_path), 7,
    )
    got = {r.pos: r.decision for r in out.collect()}
    assert got == {1: "promoted", 2: "already_active", 3: "repeated", 4: "already_active", 5: "unknown"}
    saved, queue = source.read_transition(spark, str(tmp_path))
    assert {(r.ord, r.deprecated) for r in saved.collect()} == {(4, "old"), (6, "M.1")}
    promoted = saved.where("deprecated = 'M.1'").first()
    assert promoted.v_auto and promoted.entry_id == "p.M.1.retirement-undated"
    assert {r.candidate_id for r in queue.collect()} == {"c1", "c3"}
    assert source.save_version(reg, str(tmp_path / "other"), 1).endswith("version=1")


def test_versions_are_committed_together(spark, tmp_path):
    root, one, two = str(tmp_path), spark.range(3), spark.range(5)
    assert source.committed_version(spark, root) is None
    with pytest.raises(ValueError):
        source.read_transition(spark, root)
    source.save_transition(one, two, root, 1)
    broken = spark.range(2).select(F.raise_error(F.lit("no space")).cast("bigint").alias("id"))
    with pytest.raises(PySparkException):
        source.save_transition(two, broken, root, 2)
    assert [t.count() for t in source.read_transition(spark, root)] == [3, 5]
    source.save_transition(two, one, root, 2)
    assert [t.count() for t in source.read_transition(spark, root)] == [5, 3]
    assert [t.count() for t in source.read_transition(spark, root, 1)] == [3, 5]
    with pytest.raises(ValueError):
        source.save_transition(one, two, root, 2)


def test_report_covers_every_finding(spark, sf, tmp_path):
    from tidemark.workload.queries import _occ

    occ = _occ(spark, sf).cache()
    store.write_report(report.sections(occ), str(tmp_path / "report"))
    rows = spark.read.json(str(tmp_path / "report"), schema="repo string, body string, section string")
    assert rows.where("section = 'findings'").count() == occ.count()
    assert rows.where("section = 'findings' and body not like '%classification%'").count() == 0
    # Tiers add up: the counts per repo are the findings.
    total = tiers.rollup(occ).where("level = 7").first().occurrences
    assert total == occ.count()
    occ.unpersist()
