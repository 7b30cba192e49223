import collections
import random

from pyspark.sql import functions as F

from tidemark.plans import code_scan
from tidemark.operators import discovery, documents, rewrite
from tidemark.session import shared_path
from tidemark.streaming import jobs
from tidemark.workload import fixtures as X
from tidemark.workload.queries import ID_PATTERNS, RUN_DATE

REGISTRY = (
    "ord long, kind string, provider string, deprecated string, replacement string, status string, "
    "shutdown_date string, entry_id string, v_status string, v_official boolean, v_replacement boolean, "
    "v_auto boolean, checked_at string, param string, on_models array<string>"
)


def _registry(spark):
    ok = ("verified", True, True, True, "2025-01-01")
    rows = [
        (0, "model_id", "p", "m-1", "m-2", "retired", None, None, *ok, None, None),
        (1, "model_id", "p", "m-0", "m-9", None, None, None, None, None, None, None, None, None, None),
        (2, "param_removal", "p", None, None, None, None, None, None, None, None, None, None, "temperature", ["m-2"]),
        (3, "param_rename", "p", None, "max_out", None, None, None, None, None, None, None, None, "max_tokens", ["m-2", "m"]),
    ]
    return spark.createDataFrame(rows, REGISTRY)


TS = '''const model = "m-1";
client.create({ model, temperature: 0, "max_tokens": 5 });
client.create({
  model: 'm-1',
  temperature: 1,
});
client.create({ model: "m-0", temperature: 2 });
client.create({ model: "zz", temperature: 2 });
const table = { "m-1": 1 };
'''
PY = 'model = "m-1"\nrun(model=model)\nother = "m-1"\n'


def test_fix_swaps_then_judges_parameters_on_the_new_model(spark):
    files = spark.createDataFrame(
        [("r", "src/a.ts", TS), ("r", "src/b.py", PY), ("r", "src/t.test.ts", TS)], "repo string, path string, text string"
    )
    occ, patched = code_scan.fix(files, _registry(spark))
    got = {r.path: r.new_text for r in patched.collect()}
    assert got["src/a.ts"] == '''const model = "m-2";
client.create({ model, "max_out": 5 });
client.create({
  model: 'm-2',
  
});
client.create({ model: "m-0", temperature: 2 });
client.create({ model: "zz", temperature: 2 });
const table = { "m-1": 1 };
'''
    assert got["src/b.py"] == 'model = "m-2"\nrun(model=model)\nother = "m-1"\n'
    assert "src/t.test.ts" not in got
    tiers = collections.Counter(r.tier for r in occ.collect())
    assert tiers == {"A": 3, "B": 1, "C": 2}
    # Edits never change the number of lines, and patched text holds no swap any more.
    again, _ = code_scan.scan(patched.select("repo", "path", F.col("new_text").alias("text")), _registry(spark))
    assert again.where("tier = 'A'").count() == 0
    assert rewrite.changed_lines(patched).count() == 5


def _bag(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def _in_parts(spark, df, label, parts):
    path = shared_path(spark, label)
    df.repartitionByRange(parts, df.columns[0]).write.parquet(path + f"/{label}.parquet")
    return path


def test_discovery_stream_equals_batch(spark, sf):
    folder = _in_parts(spark, X.table(spark, sf, "customer"), "customer", 4)
    pages = spark.sql(X.SQL["provider_pages"], customer=jobs.file_stream(spark, folder, "customer", 1)).withColumn(
        "retrieved_at", F.to_timestamp(F.lit("2026-01-01T00:00:00Z"))
    )
    reg, queue = X.fixture(spark, sf, "discovery_registry"), X.fixture(spark, sf, "discovery_queue")
    out = shared_path(spark, "out")
    jobs.run_append(jobs.discovery_stream(pages, reg, queue, RUN_DATE, ID_PATTERNS), out)
    batch = discovery.discover(X.fixture(spark, sf, "provider_pages"), reg, queue, RUN_DATE, ID_PATTERNS)
    assert _bag(spark.read.parquet(f"{out}/out"), "candidate_id") == _bag(batch, "candidate_id")


def test_discovery_remembers_across_epochs(spark, sf):
    # Every page comes again in a later file, years after its first capture.
    customers = X.table(spark, sf, "customer")
    folder = shared_path(spark, "again")
    for _ in range(3):
        customers.coalesce(1).write.mode("append").parquet(f"{folder}/customer.parquet")
    pages = spark.sql(X.SQL["provider_pages"], customer=jobs.file_stream(spark, folder, "customer", 1))
    reg, queue = X.fixture(spark, sf, "discovery_registry"), X.fixture(spark, sf, "discovery_queue")
    asked = []

    def current():
        asked.append(1)
        return reg

    got = jobs.discovery_log(pages, current, queue, RUN_DATE, shared_path(spark, "log"), ID_PATTERNS)
    batch = discovery.discover(X.fixture(spark, sf, "provider_pages"), reg, queue, RUN_DATE, ID_PATTERNS)
    assert _bag(got, *batch.columns) == _bag(batch, *batch.columns)
    assert {r.epoch for r in got.select("epoch").distinct().collect()} == {0}
    assert len(asked) == 3


def _drift_in_order(spark, sf, times):
    captures = X.fixture(spark, sf, "captures").select("retrieved_at", "url", "text")
    folder = shared_path(spark, "captures")
    for time in times:
        captures.where(F.col("retrieved_at") == time).coalesce(1).write.mode("append").parquet(f"{folder}/captures.parquet")
    used = spark.read.parquet(f"{folder}/captures.parquet")
    got = jobs.drift_monitor(jobs.file_stream(spark, folder, "captures", 1), shared_path(spark, "drift"))
    want = documents.drift(used).where("changed")
    columns = ("url", "retrieved_at", "content_hash", "previous_hash")
    assert want.count() > 0
    assert _bag(got, *columns) == _bag(want, *columns)


def test_drift_stream_equals_batch_over_many_epochs(spark, sf):
    # More epochs than one compaction interval, and captures that come late.
    times = sorted(r[0] for r in X.fixture(spark, sf, "captures").select("retrieved_at").distinct().collect())
    picked = [t for t in times if t[9] in "1234"] + [t for t in times if t[9] in "5"]
    random.Random(4).shuffle(picked)
    _drift_in_order(spark, sf, picked[:18])


def test_late_capture_splits_an_interval(spark):
    page = "url string, retrieved_at string, text string"
    folder = shared_path(spark, "late")
    for row in [("u", "2025-01-01", "a"), ("u", "2025-01-09", "a"), ("u", "2025-01-05", "b"), ("u", "2024-12-31", "c")]:
        spark.createDataFrame([row], page).coalesce(1).write.mode("append").parquet(f"{folder}/captures.parquet")
    got = jobs.drift_monitor(jobs.file_stream(spark, folder, "captures", 1), shared_path(spark, "drift"))
    assert sorted(r.retrieved_at for r in got.collect()) == ["2025-01-01", "2025-01-05", "2025-01-09"]


def test_rate_stream_and_open_windows_equal_batch(spark, sf):
    # Files arrive in time order, so nothing is late.
    events, folder = X.table(spark, sf, "events"), shared_path(spark, "events")
    size = events.count() // 3 + 1
    for i in range(3):
        part = events.where((F.col("event_id") >= i * size) & (F.col("event_id") < (i + 1) * size))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    for label, aggregate in (("rates", jobs.rate_windows), ("sessions", jobs.rate_sessions)):
        feed = spark.sql(X.SQL["finding_feed"], events=jobs.file_stream(spark, folder, "events", 1))
        out = shared_path(spark, label)
        run = jobs.run_append(aggregate(feed), out)
        batch = aggregate(X.fixture(spark, sf, "finding_feed"))
        emitted = spark.read.parquet(f"{out}/out")
        every = jobs.with_open_windows(emitted, run, batch)
        assert _bag(every, *batch.columns) == _bag(batch, *batch.columns)
        opened = every.where("open").count()
        assert 0 < opened and emitted.count() == batch.count() - opened


def test_scan_stream_equals_batch(spark, sf):
    folder = _in_parts(spark, X.table(spark, sf, "orders"), "orders", 3)
    files = spark.sql(X.SQL["source_files"], orders=jobs.file_stream(spark, folder, "orders", 1))
    reg = X.registry(spark, sf)
    got = jobs.continuous_scan(files, reg, shared_path(spark, "scan"))
    want, _ = code_scan.scan(X.fixture(spark, sf, "source_files"), reg)
    columns = ("repo", "path", "line", "col", "value", "tier")
    assert _bag(got, *columns) == _bag(want, *columns)
