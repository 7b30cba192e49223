"""Decontamination, personal data and toxicity."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import decontaminate, pii, toxicity

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contaminated(docs, items, n=13):
    windows = {}
    for item_id, text in items:
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item_id))
    sizes = {len(k) for k in windows}
    out = []
    for doc_id, text in docs:
        w, hit, ids = WORD.findall(lower(text)), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (key := tuple(w[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[key]
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def pairs(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


@pytest.fixture(scope="module")
def tests_of(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def key(rows):
    return sorted(rows, key=repr)


def test_report_on_documents(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = contaminated(pairs(docs, "doc_id", "text"), pairs(items, "item_id", "text"))
    assert key(map(tuple, decontaminate.report(docs, items).collect())) == key(want)
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_slices_give_the_same(spark, sf, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = key(map(tuple, decontaminate.report(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", items.selectExpr("sum(octet_length(text))").first()[0] // 2)
    assert key(map(tuple, decontaminate.report(docs, items).collect())) == whole


def test_odd_documents(odd, tests_of):
    items = tests_of([(1, "TOK5 tok6 tok7"), (2, None), (3, ""), (4, "a"), (4, "漢字"), (None, "c"), (5, " ".join(f"tok{i}" for i in range(20, 40)))])
    want = contaminated(pairs(odd, "doc_id", "text"), [r for r in pairs(items, "item_id", "text") if r[0] is not None])
    got = {r.doc_id: tuple(r) for r in decontaminate.report(odd, items).collect() if r.doc_id not in (8, None)}
    assert got == {r[0]: r for r in want if r[0] not in (8, None)}
    # The item without an id marks words and is not listed.
    eight = decontaminate.report(odd, items).where("doc_id = 8").first()
    assert (eight.n_hit, eight.n_items) == (2, 1)


def test_remove_keeps_columns(odd, tests_of):
    items = tests_of([(1, " ".join(f"tok{i}" for i in range(20, 40)))])
    clean = decontaminate.remove(odd, items)
    assert clean.columns == odd.columns
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, None, 6, 7, 8, 10, 11, 12}
    spans = decontaminate.remove(odd, items, spans=True)
    assert spans.count() == odd.count() and spans.where("doc_id = 4").first().text == " ".join(f"tok{i}" for i in [*range(20), *range(40, 60)])
    assert spans.where("doc_id = 4").first()["row"] == "row4"


def test_no_items_or_no_documents(odd, empty, tests_of):
    assert decontaminate.remove(odd, tests_of([])).count() == odd.count()
    assert decontaminate.report(empty, tests_of([(1, "a b")])).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True, "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    chance = random.Random(2)
    made = ["".join(chance.choices("a@.+0123456789- (b%é", k=chance.randint(1, 80))) for _ in range(15_000)]
    made += ["1.2.3.4.5.6.7.8.9", "1.2.3 4.5.6.7", "12.3.4.256 1.1.1.1", "4111 1111 1111 1111 x 4111-1111-1111-1111", "a@b@c.d", "a@b.c@d.e", "+1 (555) 123-4567-"]
    for text in made:
        assert [s for s in pii.find_spans(text) if s[0] in pii.BASE] == base_spans(text)


def test_added_spans_are_validated():
    assert [s[0] for s in pii.find_spans("IBAN: GB82 WEST 1234 5698 7654 32.")] == ["account"]
    assert [s[0] for s in pii.find_spans("IBAN: GB82 WEST 1234 5698 7654 33.")] == []
    assert [s[0] for s in pii.find_spans("ssn: 123-45-6789, ftp://joe:pw@host/x")] == ["login", "account"]


def test_pii_report_and_redaction(spark, sf, odd, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, odd):
        want = []
        for d, t in pairs(df, "doc_id", "text"):
            spans = base_spans(t)
            text = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            want.append((d, *(sum(s[0] == k for s in spans) for k in BASE), hashlib.sha256(text.encode()).hexdigest()))
        assert key(tuple(r)[:6] for r in pii.report(df).collect()) == key(want)
    assert pii.report(empty).count() == 0
    assert pii.redact(odd).columns == odd.columns
    assert pii.redact_text("mail a@b.co now") == "mail [email] now" and pii.redact_text(None) is None


@pytest.fixture(scope="module")
def trained(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.fit(docs, labels)


def test_held_out_accuracy(trained):
    docs, labels, model = trained
    scored = toxicity.score(docs, model, ["doc_id"]).join(labels, "doc_id").where(toxicity.held_out(labels["doc_id"]))
    rows = pairs(scored, "score", "toxic")
    score, label = (np.array(x) for x in zip(*rows, strict=True))
    assert ((score >= 0.5) == (label == 1)).mean() > 0.97
    ones, zeros = score[label == 1], score[label == 0]
    assert (ones[:, None] > zeros[None, :]).mean() + 0.5 * (ones[:, None] == zeros[None, :]).mean() > 0.95


def test_labels_of_held_out_rows_are_not_read(spark, trained):
    docs, labels, model = trained
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.fit(docs, turned).lexicon == model.lexicon


def test_held_out_rule(spark):
    rows = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long").withColumn("out", toxicity.held_out(toxicity.F.col("doc_id"))).collect()
    assert all(r.out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_odd_rows_have_scores(odd, empty, spark, trained):
    _, labels, model = trained
    rows = toxicity.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score(empty, model, ["doc_id"]).count() == 0
    # Nothing to learn from: the prior for all.
    none = labels.limit(0)
    assert {r.score for r in toxicity.report(odd, none).collect()} == {0.5}
    one = spark.createDataFrame([(4, 0, None), (7, 0, 0), (7, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.report(odd, one).collect()} == {0}
    kept = toxicity.keep_clean(odd, one)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_toxicity_counts_forms_in_parts(spark, sf, monkeypatch):
    """The lexicon is the same however often a task hands on its counts."""
    from tidemark.llm import toxicity

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.join(spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "toxic label").dropna(), "doc_id").coalesce(1)
    whole = toxicity.learn_lexicon(rows, 20, 100)
    handed = []
    monkeypatch.setattr(toxicity, "FORMS", 50)
    monkeypatch.setattr(toxicity, "ship", lambda spark: handed.append(1))
    assert toxicity.learn_lexicon(rows, 20, 100) == whole and whole and handed


def test_toxicity_remembers_few_tokens():
    from tidemark.llm import toxicity

    reader = toxicity.Reader({"bad": 2.0})
    first = reader.features("a bad word")
    for k in range(150_000):
        reader[f"t{k}"]
    assert len(reader) <= 100_000 and reader.features("a bad word") == first
