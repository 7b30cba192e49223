"""Personal data by anchor expansion.

One Aho-Corasick pass finds at-signs, plus signs, digits, schemes and identifier cues; around each
anchor a small deterministic parser expands to the full span and validates it.  The base kinds are
email, ip, card and phone; the method adds ``login`` (user and password in an address) and
``account`` (an IBAN or social security number behind its cue, validated).

Null and empty texts hold nothing.  Offsets count code points, ends are exclusive, and whole texts
are read in time linear in their length.  Repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow, ship, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "login", "account")

# --- fixed values: what the kinds are made of -------------------------------------------------
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+(?=@)")
CUES = {
    "iban": re.compile(r"[\s:=#]{1,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    "ssn": re.compile(r"[\s:=#]{1,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
}

_automaton = None


def automaton() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        built = ahocorasick.Automaton()
        for d in DIGITS:
            built.add_word(d, "digit")
        for word, what in (("@", "at"), ("+", "plus"), ("://", "scheme")):
            built.add_word(word, what)
        for cue in CUES:
            for form in (cue, cue.upper(), cue.capitalize()):
                built.add_word(form, cue)
        built.make_automaton()
        _automaton = built
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _part(text: str) -> bool:
    short = text.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _addresses(text: str, blocks: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Four digit blocks in a row with a dot between; each block serves one address."""
    k = 0
    while k + 3 < len(blocks):
        four = blocks[k : k + 4]
        # The first gap that is not a lone dot ends what can start here.
        gap = next((g for g in range(3) if four[g + 1][0] != four[g][1] + 1 or text[four[g][1]] != "."), None)
        if gap is not None:
            k += gap + 1
            continue
        if all(_part(text[a:b]) for a, b in four):
            yield four[0][0], four[3][1]
        k += 4


def _cards(text: str, blocks: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Digit blocks with one blank or hyphen between, as far as they go."""
    k = 0
    while k < len(blocks):
        end = k
        size = blocks[k][1] - blocks[k][0]
        while end + 1 < len(blocks) and blocks[end + 1][0] == blocks[end][1] + 1 and text[blocks[end][1]] in " -":
            end += 1
            size += blocks[end][1] - blocks[end][0]
        if 13 <= size <= 19 and luhn("".join(text[a:b] for a, b in blocks[k : end + 1])):
            yield blocks[k][0], blocks[end][1]
        k = end + 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind as listed and then by start."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {}
    blocks: list[tuple[int, int]] = []
    n, mail_end, block_end = len(text), 0, 0
    for at, what in automaton().iter(text):
        if what == "digit":
            if at >= block_end:
                block_end = at + 1
                while block_end < n and text[block_end] in DIGITS:
                    block_end += 1
                blocks.append((at, block_end))
        elif what == "at":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                mail_end = m.end()
                found.setdefault("email", []).append((start, mail_end))
        elif what == "plus":
            if (m := PHONE.match(text, at)) and 9 <= sum(c in DIGITS for c in m[0]) <= 15:
                found.setdefault("phone", []).append(m.span())
        elif what == "scheme":
            if m := LOGIN.match(text, at + 1):
                found.setdefault("login", []).append(m.span())
        elif (m := CUES[what].match(text, at + 1)) and (what != "iban" or _iban(m[1])):
            found.setdefault("account", []).append(m.span(1))
    if blocks:
        found["ip"] = list(_addresses(text, blocks))
        found["card"] = list(_cards(text, blocks))
    return [(kind, a, b) for kind in KINDS for a, b in found.get(kind, ())]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


REPORT = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())]
)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, all spans."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (c.to_pylist() for c in batch.columns)
            for a, b in slices(texts):
                found = [find_spans(t) for t in texts[a:b]]
                base = [[s for s in spans if s[0] in BASE] for spans in found]
                yield arrow(
                    {"doc_id": ids[a:b], "spans": [_joined(s) for s in found]}
                    | {f"n_{k}": [sum(s[0] == k for s in spans) for spans in base] for k in BASE}
                    | {"base_sha256": [hashlib.sha256(_joined(s).encode()).hexdigest() for s in base]},
                    REPORT,
                )

    return docs.select("doc_id", "text").mapInArrow(
        scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redact_text(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not text:
        return text
    out, last = [], 0
    for a, b, kind in sorted((a, b, kind) for kind, a, b in find_spans(text)):
        if a >= last:
            out += [text[last:a], f"[{kind}]"]
        last = max(last, b)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in ``text``; other columns unchanged."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([redact_text(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], texts, *batch.columns[at + 1 :]], schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)
