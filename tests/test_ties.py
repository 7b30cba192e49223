"""Queries against their SQL on tables where rows share a url or a moment."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.workload.fixtures import TABLES
from tools.check_queries import rows_of


@pytest.fixture(scope="module")
def tied(spark, sf, tmp_path_factory):
    """Pages that share a url, with equal and other texts, and events that share a moment or lie exactly one gap apart."""
    folder = tmp_path_factory.mktemp("tied")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    pages = [(k, f"https://p.example/{k % 9}", f"<p>page {k % 4 if k % 9 < 3 else k}</p>") for k in range(9 * 12) for _ in range(1 + (k % 5 == 0))]
    start = datetime.datetime(2024, 1, 1)
    minutes = [m for burst in range(40) for m in (burst * 75, burst * 75 + 30, burst * 75 + 44)]
    events = [
        ((7 * n) % 360, start + datetime.timedelta(minutes=m), n % 2, "click", 1.0)
        for n, m in enumerate(m for m in minutes for _ in range(3))
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1).createOrReplaceTempView("tied_pages")
    columns = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    frames = {"pages": spark.table("tied_pages"), "events": spark.createDataFrame(events, columns)}
    for name, df in frames.items():
        con.register("rows", df.toPandas())
        cast = "replace (ts::timestamp as ts)" if name == "events" else ""
        con.execute(f"copy (select * {cast} from rows) to '{folder}/{name}.parquet' (format parquet)")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder if t in frames else sf}/{t}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["doc_drift", "doc_sessions", "stream_drift", "stream_sessions"])
def test_ties_are_settled_by_rule(spark, tied, name):
    folder, duck = tied
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    df = entry.queries()[name](spark, folder)
    assert len(want) > 8
    assert rows_of(df.columns, df.collect()) == want


def test_a_capture_that_comes_again_changes_nothing(spark):
    """The same captures in a second file, in the other order; ties stand in order of their hashes."""
    from tidemark.operators import documents
    from tidemark.session import shared_path
    from tidemark.streaming import jobs

    rows = [("u", "2025-01-01", t) for t in "abcd"] + [("u", "2025-01-02", "b")]
    page = "url string, retrieved_at string, text string"
    folder = shared_path(spark, "again")
    for part in (rows[:3], rows[::-1], rows[1:2]):
        spark.createDataFrame(part, page).coalesce(1).write.mode("append").parquet(f"{folder}/captures.parquet")
    got = jobs.drift_monitor(jobs.file_stream(spark, folder, "captures", 1), shared_path(spark, "drift"))
    want = documents.drift(spark.createDataFrame(rows, page)).where("changed").drop("changed")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
