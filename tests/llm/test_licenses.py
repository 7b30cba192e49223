"""Licence scan: signatures by themselves, and the scan against a plain reading of the same signatures."""

from __future__ import annotations

import re

from tidemark.llm import license_scan as L
from tidemark.llm.license_rules import CONFIDENCE, Rule, compiled, signatures

WORD = re.compile(L.WORDS)


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, rules=None, phrases=L.PHRASES):
    rules = signatures() if rules is None else rules
    w = words(text)
    base = [(i, i + len(p.split()), label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    tagged = "".join(f" {x}#{k} " for k, x in enumerate(w))
    found = [(a, -z, 0, n, label) for n, (a, z, label) in enumerate(base)]
    for n, r in enumerate(rules, len(base)):
        if r.keyword not in w:  # every match holds it, see the last test
            continue
        for m in re.finditer(compiled(r.pattern), tagged, re.ASCII):
            places = [int(x) for x in re.findall("#([0-9]+) ", m[0])]
            found.append((places[0], -places[-1] - 1, r.level, n, r.label))
    found.sort()
    kept = [d for k, d in enumerate(found) if not any(e[2] <= d[2] and e[1] <= d[1] for e in found[:k])]
    labels = {b[2] for b in base}
    starts = [b[0] for b in base]
    return (
        len(w), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
        ",".join(sorted(labels | {d[4] for d in kept})), max((CONFIDENCE[d[2]] for d in kept), default=0.0),
    )


TEXTS = [
    None, "", " \n", "no license here", "Released under the MIT License.", "under the mit license under the mit license",
    "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "CC BY-NC-SA 4.0", "cc by nc nd",
    "This work is licensed under the GNU General Public License, version 3.", "GNU GPL v2 or later", "gpl",
    "the GNU Lesser General Public License version 2.1 or (at your option) any later version", "SPDX-License-Identifier: MIT",
    "SPDX-License-Identifier: Apache-2.0\nSPDX-License-Identifier: GPL-3.0-only", "see http://www.apache.org/licenses/LICENSE-2.0 for it",
    "All rights reserved. Alle Rechte vorbehalten; tous droits réservés", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "redistributed under BSD 3-Clause license and the two-clause BSD license", "apache license version 2 apache license version 2 0",
    "https://creativecommons.org/licenses/by-nc-sa/4.0/", "unter der Lizenz X", "MIT\x1fLICENSE MIT LICENSE", "İ MIT LICENCE ß",
    " ".join(["x"] * 5000 + ["the mit license"] * 40),
]


def test_scan_equals_plain_reading(frame):
    df = frame(list(enumerate(TEXTS)), extra=True)
    got = {r.doc_id: tuple(r)[1:] for r in L.report(df).collect()}
    for n, text in enumerate(TEXTS):
        assert got[n] == plain(text), text


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted((r.doc_id, *plain(r.text)) for r in docs.collect())
    assert sorted(map(tuple, L.report(docs).collect())) == want


def test_labels_and_suppression(frame):
    def labels(text):
        return L.report(frame([(1, text)])).first()["labels"]

    assert labels("gnu lesser general public license version 3") == "lgpl-3"
    assert labels("licensed under the gnu general public license version 2 or any later version") == "gpl-2-plus"
    assert labels("Released under the MIT License") == "mit"
    assert labels("licensed under something of our own") == "unknown"
    assert labels("MIT license or Apache License 2.0") == "apache-2,mit"
    assert labels("a mitten and a gnu") == ""


def test_better_levels_outlive_worse_ones(frame):
    rules = [Rule("wide", 3, "b", "a b c"), Rule("same", 3, "b", "a b c"), Rule("inner", 3, "b", "b"), Rule("sure", 1, "b", "b c"), Rule("weak", 5, "c", "c")]
    row = L.scan(frame([(1, "a b c")]), phrases=(), rules=rules).first()
    assert [d["label"] for d in row.detections] == ["wide", "sure"]


def test_phrases_that_overlap_themselves(frame):
    row = L.scan(frame([(1, "a a a a b")]), phrases=(("a a", "x"),), rules=[]).first()
    assert [d["start"] for d in row.base] == [0, 1, 2]


def test_odd_rows(odd, empty):
    rows = L.report(odd).collect()
    assert len(rows) == odd.count() and all(r.n_base == 0 and r.first_word is None and r.score == 0 for r in rows)
    assert L.report(empty).count() == 0 and L.detections(odd).count() == 0


def alternatives(pattern):
    """Words of the pattern that every match holds, as sets of alternatives, without optional parts."""
    parts, place = re.findall(r"\(|\)\??|\||[^\s()|]+", pattern), 0

    def choice(stop):
        nonlocal place
        branches = [set()]
        while place < len(parts) and not (stop and parts[place][0] == ")"):
            part = parts[place]
            place += 1
            if part == "(":
                inner = choice(True)
                if parts[place] == ")":
                    branches[-1] |= inner
                place += 1
            elif part == "|":
                branches.append(set())
            else:
                branches[-1].add(part)
        return set.intersection(*branches)

    return choice(False)


def test_every_match_holds_its_keyword():
    rules = signatures()
    assert len(rules) > 200
    for r in rules:
        assert any(atom != "*" and re.fullmatch(atom, r.keyword) for atom in alternatives(r.pattern)), r
        assert re.fullmatch(r"[a-z0-9.-]+", r.label) and 1 <= r.level < len(CONFIDENCE)
