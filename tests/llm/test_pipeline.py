"""The pipeline, stage by stage, against plain Python on what each stage was given."""

from __future__ import annotations

import os

import __spark_entry__
import corpus_pipeline
from tidemark.llm import decontaminate, toxicity
from tidemark.llm.common import lower_words, tidied


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, given = docs.columns, docs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "benchmark_decontamination", "byte_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, sf)
        assert out.columns == columns
        kept[name] = given = spark.createDataFrame(out.collect(), out.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, given, sf)
    assert last.count() == given.count()

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = {r.doc_id for r in toxicity.report(docs, labels).where("predicted = 0").collect()}
    assert {r.doc_id for r in kept["toxicity"].collect()} == clean

    assert kept["line_dedup"].count() == kept["toxicity"].count()
    lines = [s for r in kept["line_dedup"].collect() for s in r.text.split("\n") if s.strip()]
    assert len(lines) == len(set(lines))

    texts = {r.doc_id: lower_words(r.text) for r in kept["line_dedup"].collect()}
    shingles = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in texts.items()}
    left = sorted(r.doc_id for r in kept["near_dedup"].collect())
    for k, a in enumerate(left):
        for b in left[k + 1 :]:
            common = len(shingles[a] & shingles[b])
            assert not common or 100 * common < 80 * len(shingles[a] | shingles[b])

    found = decontaminate.report(kept["near_dedup"], spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r.doc_id for r in found.where("not contaminated").collect()} == {r.doc_id for r in kept["benchmark_decontamination"].collect()}


def test_stages_take_odd_rows_and_empty_tables(spark, sf, odd, empty):
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, empty):
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count()
            if name != "byte_bpe":
                assert out.columns == docs.columns


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_stages_hold_small_batches(spark, sf):
    """The texts of a task must not lie in one Arrow batch, in the JVM and in Python at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, docs = spark.conf.get(name), spark.read.parquet(f"{sf}/documents.parquet")
    try:
        for given, want in (("10000", "1000"), ("0", "1000"), ("300", "300")):
            for _, stage in corpus_pipeline.STAGES[-2:]:
                spark.conf.set(name, given)
                stage(spark, docs, sf)
                assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)


def test_decontamination_has_one_worker_per_task(spark, sf, capsys):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    decontaminate.remove(docs, items).explain()
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_workers_give_memory_back():
    """What a task has freed below something that stays leaves the process when its batches end."""

    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGESIZE")

    held, stays = [], []

    def run(batches):
        yield from batches
        held.extend(bytes(100_000) for _ in range(1000))
        stays.append(bytes(100_000))
        held.clear()
        sizes.append(resident())

    sizes = []
    assert list(tidied(run)(iter([1, 2]))) == [1, 2]
    assert resident() < sizes[0] - 50_000_000
