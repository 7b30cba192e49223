"""Copies of a text are read once, and every file that holds it has its rows."""

from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.operators import corpus, extract as X, reading
from tidemark.plans import code_scan

TS = 'client.create({ model: "acme-m1" });\n'
PY = 'model = "acme-m1"\nrun(model=model)\n'


def _files(spark, copies):
    rows = [(f"r{k % 7}", f"src/f{k}.{lang}", lang, text) for k in range(copies) for lang, text in (("ts", TS), ("py", PY), ("py", TS))]
    rows += [("r", "src/n.py", "py", None), ("r", "src/e.ts", "ts", ""), ("r", "src/twice.py", "py", PY), ("r", "src/twice.py", "py", PY)]
    return spark.createDataFrame(rows, "repo string, path string, lang string, text string")


def test_every_copy_has_its_rows(spark):
    files = _files(spark, 60)
    key = ["repo", "path", "lang", "line", "col", "start", "value", "enclosure"]
    got = X.literals(X.token_structure(files)).select(key).collect()
    want = X.literals(reading.facts(files)).select(key).collect()
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 60 * 3 + 2


def test_a_text_is_read_once(spark, monkeypatch):
    read = []

    def counted(texts, keys):
        read.append(texts.count())
        return reading.facts(texts, keys)

    monkeypatch.setattr(X, "facts", counted)
    X.token_structure(_files(spark, 60))
    assert read == [5]


def test_a_scan_finds_what_whole_files_hold(spark):
    note = "# scan: ignore-file\n"
    files = _files(spark, 20).drop("lang").union(
        spark.createDataFrame([("r", "src/i.py", note + PY), ("r", "dist/o.ts", TS), ("r", "src/o.py", "m = 'other'")], "repo string, path string, text string")
    ).distinct()
    registry = spark.createDataFrame([(1, "model_id", "acme-m1", None)], "ord long, kind string, deprecated string, on_models array<string>")
    wanted = lambda texts: corpus.prefilter(corpus.unannotated(texts), corpus.registry_tokens(registry))
    got = code_scan.native_facts(corpus.in_scope(files), wanted).literals.select("repo", "path", "start", "value")
    want = X.literals(reading.facts(code_scan.relevant_files(files, registry))).select("repo", "path", "start", "value")
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 61


def test_the_sieve_keeps_out_runs_of_long_lists(spark):
    """Of a million keys the old size let a fifth of all runs through."""
    keys = spark.range(1_000_000).select(F.format_string("k%07d", "id").alias("gram"))
    passed = spark.range(100_000).select(F.format_string("z%07d", "id").alias("gram")).where(corpus._passes("gram", corpus.sieve(keys).scalar()))
    assert passed.count() < 1_000


def test_folders_are_whole_names(spark):
    rows = [("dist/a.ts", True), ("x/dist/a.ts", True), ("xdist/a.ts", False), ("dist.ts", False), ("a/.git/b", True), ("a/xgit/b", False), ("a\\dist\\b", True)]
    got = spark.createDataFrame(rows, "p string, want boolean").select("want", paths.under_dirs(F.col("p"), ("dist", ".git")).alias("got")).collect()
    assert all(r.want == r.got for r in got)
