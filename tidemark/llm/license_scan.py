"""Licence scan by ordered signatures, inside each row and by Spark's own functions.

A cheap look at the text tells whether it holds any keyword at all; most texts end there.  For the others
every word is written with its place (`` word#place ``), the signatures whose keyword occurs are matched by
regular expression, and a match tells its interval by the places it holds.  One fold over the intervals in
order of their start then settles overlaps: a detection goes if another one of the same or a better level
covers it (among equal intervals and levels the signature that stands first wins).

Base phrases are signatures of the best level and found at all their places, also where they overlap.

Defined results.  A null or empty text, and one without words, has no places, no labels, score 0 and null
first and last words.  Rows are independent: repeated ids, ties and further columns change nothing.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_rules import CONFIDENCE, Rule, compiled, signatures

#: The contract's phrases and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def phrase_rules(phrases: tuple[tuple[str, str], ...]) -> list[Rule]:
    """Base phrases as signatures; the keyword is their longest word."""
    return [Rule(label, 0, max(phrase.split(), key=len), " ".join(map(re.escape, phrase.split()))) for phrase, label in phrases]


def _table(rules: list[Rule]) -> Column:
    """The signatures as one constant array, in order."""
    rows = [{"label": r.label, "level": r.level, "keyword": r.keyword, "pattern": compiled(r.pattern), "nth": k} for k, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<label string, level int, keyword string, pattern string, nth int>>")


def _interval(match: Column, rule: Column) -> Column:
    """Sorts by start, then the longer, then the better level, then the order of signatures."""
    start = F.regexp_extract(match, "#([0-9]+) ", 1).cast("int")
    stop = F.regexp_extract(match, "#([0-9]+) $", 1).cast("int") + 1
    return F.struct(start.alias("start"), (-stop).alias("neg_stop"), rule["level"].alias("level"), rule["nth"].alias("nth"), rule["label"].alias("label"))


def _matches(tagged: Column, present: Column, rules: list[Rule], everywhere: bool) -> Column:
    """Intervals of all matches; everywhere: a match may start inside another of its own signature."""
    able = F.filter(_table(rules), lambda r: F.array_contains(present, r["keyword"]) & F.regexp_like(tagged, r["pattern"]))
    pattern = (lambda r: F.concat(F.lit("(?=("), r["pattern"], F.lit("))"))) if everywhere else (lambda r: r["pattern"])
    group = F.lit(1 if everywhere else 0)
    return F.flatten(F.transform(able, lambda r: F.transform(F.regexp_extract_all(tagged, pattern(r), group), lambda m: _interval(m, r))))


def resolved(found: Column) -> Column:
    """The intervals that no other of the same or a better level covers; ``found`` in sorted order."""
    levels = len(CONFIDENCE)
    start = F.struct(F.array_repeat(F.lit(0), levels).alias("reach"), F.slice(found, 1, 0).alias("kept"))

    def step(state: Column, d: Column) -> Column:
        stop = -d["neg_stop"]
        covered = F.element_at(state["reach"], d["level"] + 1) >= stop
        # reach[l]: how far detections of level l or better extend so far.
        reach = F.transform(state["reach"], lambda x, level: F.when(level >= d["level"], F.greatest(x, stop)).otherwise(x))
        return F.struct(reach.alias("reach"), F.when(covered, state["kept"]).otherwise(F.concat(state["kept"], F.array(d))).alias("kept"))

    return F.aggregate(found, start, step, lambda state: state["kept"])


def scan(docs: DataFrame, phrases: tuple[tuple[str, str], ...] = PHRASES, rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, base, detections): intervals (start, stop, level, label) in order of their start.

    ``base`` holds every place of a phrase, ``detections`` what is left of all after suppression.
    """
    base, own = phrase_rules(phrases), signatures() if rules is None else rules
    keywords = sorted({r.keyword for r in [*base, *own]})
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    cut = docs.select("doc_id", F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0)).alias("words"))
    seen = cut.select("doc_id", F.size("words").cast("long").alias("n_words"), "words", F.array_intersect("words", F.lit(keywords)).alias("present"))
    tag = F.array_join(F.transform("words", lambda w, k: F.concat(F.lit(" "), w, F.lit("#"), k, F.lit(" "))), "")
    tagged = seen.select("doc_id", "n_words", "present", F.when(F.size("present") > 0, tag).otherwise("").alias("tagged"))
    found = tagged.select(
        "doc_id", "n_words",
        F.array_sort(_matches(F.col("tagged"), F.col("present"), base, True)).alias("base"),
        _matches(F.col("tagged"), F.col("present"), own, False).alias("own"),
    )
    left = found.select("doc_id", "n_words", "base", resolved(F.array_sort(F.concat("base", "own"))).alias("kept"))
    shown = lambda d: F.struct(d["start"].alias("start"), (-d["neg_stop"]).alias("stop"), d["level"].alias("level"), d["label"].alias("label"))
    return left.select("doc_id", "n_words", F.transform("base", shown).alias("base"), F.transform("kept", shown).alias("detections"))


def detections(docs: DataFrame) -> DataFrame:
    """One row per detection: doc_id, start and stop in words, level, label."""
    return scan(docs).select("doc_id", F.inline("detections"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of words and base places, first and last place, labels, score."""
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    names = lambda c: F.transform(c, lambda d: d["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    worth = F.transform("detections", lambda d: F.element_at(F.lit(list(CONFIDENCE)), d["level"] + 1))
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(names(F.col("base"))).alias("base_labels"), joined(F.concat(names(F.col("base")), names(F.col("detections")))).alias("labels"),
        F.coalesce(F.array_max(worth), F.lit(0.0)).alias("score"),
    )
