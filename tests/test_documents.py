from pyspark.sql import functions as F
"""Document operators against a direct reading in plain Python."""

import random
import re

from tidemark.operators import documents as D
from tidemark.sources import store


def anchor(text, excerpt):
    hay, flat = text.lower(), re.sub(r"\s+", " ", excerpt).strip().lower()
    if not flat:
        return -1
    at = hay.find(flat)
    if at >= 0:
        return at
    tokens = sorted((t for t in re.split(r"[^a-z0-9._-]+", flat) if len(t) >= 6), key=lambda t: -len(t))
    return next((hay.find(t) for t in tokens if t in hay), -1)


def cut(text, limit):
    return text.encode()[: max(limit, 0)].decode("utf-8", "ignore")


def windows(text, excerpts, max_bytes, window, reserve):
    if len(text.encode()) <= max_bytes:
        return []
    head = cut(text, int(max_bytes * 0.5))
    budget = max_bytes - reserve - len(head.encode())
    found = []
    for e in sorted(set(excerpts)):
        at = anchor(text, e)
        if at >= 0 and at >= len(head):
            found.append((max(len(head), at - window // 2), min(len(text), at + window // 2)))
    merged = []
    for s, e in sorted(set(found)):
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    kept, spent = [], 0
    for s, e in merged:
        size = len(text[s:e].encode())
        if spent + size <= budget:
            kept.append((s, e))
            spent += size
            continue
        clipped = cut(text[s:e], budget - spent)
        if budget - spent > 0 and clipped:
            kept.append((s, s + len(clipped)))
        break
    return kept


def sample():
    rng = random.Random(11)
    words = ["alpha", "bravo-1.2", "céleste", "délta", "echo_echo", "kilo", "überlang", "😀smile"]
    docs, quotes = [], []
    for d in range(25):
        text = " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.choice([5, 150, 400])))
        docs.append((d, text))
        for _ in range(rng.randint(0, 6)):
            s = rng.randint(0, max(0, len(text) - 30))
            quote = text[s : s + 25]
            quotes.append((d, rng.choice([quote, "zz | " + quote, "no such words here", "  ", quote])))
    return docs, quotes


def test_windows_equal_brute_force(spark):
    docs, quotes = sample()
    got = D.excerpt_windows(
        spark.createDataFrame(docs, "doc int, text string"),
        spark.createDataFrame(quotes, "doc int, excerpt string"),
        "doc", max_bytes=1200, window_bytes=200, reserve=50,
    ).collect()
    want = {(d, s, e) for d, t in docs for s, e in windows(t, [q for k, q in quotes if k == d], 1200, 200, 50)}
    assert {(r.doc, r.start, r.end) for r in got} == want
    assert len(want) > 10


def test_snapshot_bodies_fit_and_keep_quotes(spark):
    docs, quotes = sample()
    bodies = D.snapshot_bodies(
        spark.createDataFrame(docs, "doc int, text string"),
        spark.createDataFrame(quotes, "doc int, excerpt string"),
        "doc", max_bytes=3000, window_bytes=200,
    ).collect()
    texts = dict(docs)
    assert len(bodies) == len(docs)
    for r in bodies:
        whole = texts[r.doc]
        assert len(r.body.encode()) <= 3000
        if len(whole.encode()) <= 3000:
            assert r.body == whole
        else:
            assert whole.startswith(r.body[:200]) and "hash covers the whole document" in r.body


def test_drift_ignores_noise_and_sees_changes(spark):
    page = "<p>{}</p><script>t({})</script>"
    rows = [
        ("u", "2025-01-01T00:00:00Z", page.format("a", 1)),
        ("u", "2025-02-01T00:00:00Z", page.format("a", 2)),
        ("u", "2025-02-02T00:00:00Z", page.format("b", 3)),
        ("u", "2025-03-01T00:00:00Z", page.format("a", 4)),
        ("w", "2025-01-01T00:00:00Z", page.format("a", 1)),
    ]
    out = D.drift(spark.createDataFrame(rows, "url string, retrieved_at string, text string")).collect()
    changed = sorted((r.url, r.retrieved_at[:10]) for r in out if r.changed)
    assert changed == [("u", "2025-02-02"), ("u", "2025-03-01")]


def test_store_keeps_the_first_copy(spark, tmp_path):
    docs = spark.createDataFrame(
        [("u", "2025-01-01", "same  text"), ("v", "2025-01-02", "same text"), ("w", "2025-01-03", "other")],
        "url string, retrieved_at string, text string",
    )
    root = str(tmp_path / "store")
    store.append_documents(docs, spark.createDataFrame([], store.DOCUMENT), root, 0)
    store.append_documents(docs, store.stored_documents(spark, root), root, 1)
    got = store.stored_documents(spark, root)
    assert sorted(r.url for r in got.collect()) == ["u", "w"]
    refs = D.hashed(docs).select("url", "doc_key")
    assert store.load_document(got, refs).where("body is null").count() == 0


def test_store_keeps_whole_texts(spark, tmp_path):
    long = "words and more " * 100000 + "a quote far behind"
    docs = spark.createDataFrame([("u", "2025-01-01", long), ("v", "2025-01-01", None)], "url string, retrieved_at string, text string")
    root = str(tmp_path / "store")
    store.append_documents(docs, spark.createDataFrame([], store.DOCUMENT), root, 0)
    kept = store.stored_documents(spark, root)
    assert kept.where("url = 'u'").first().body == long
    cited = kept.select("doc_key", F.lit("a quote far behind").alias("excerpt"))
    body = store.snapshots(kept.where("url = 'u'"), cited, max_bytes=4096, window_bytes=512).first().body
    assert len(body) <= 4096 and "a quote far behind" in body
