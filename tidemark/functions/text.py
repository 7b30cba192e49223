"""Text clean-up, hashing and clipping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


#: A text's identity in 128 bits: the second hash starts from another seed.
TEXT = ["_t1", "_t2"]


def identified(texts: DataFrame, wanted: Column | None = None) -> DataFrame:
    """Adds the identity of ``text``; null where it is not wanted."""
    wanted = F.lit(True) if wanted is None else wanted
    return texts.withColumn("_t1", F.when(wanted, F.xxhash64("text"))).withColumn("_t2", F.when(wanted, F.xxhash64(F.lit(1), "text")))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{C.WS}+|{C.WS}+$", "")


def collapse_ws(text: Column) -> Column:
    """Every whitespace run becomes one space; none at either end."""
    return F.trim(F.regexp_replace(text, f"{C.WS}+", " "))


def decode_numeric_entities(text: Column) -> Column:
    """``&#8209;`` and friends, read as UTF-16 code units."""
    pattern = r"&#(\d+);"
    codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))

    def one(code: Column) -> Column:
        unit = F.coalesce(code.try_cast("bigint"), F.lit(0xFFFD)) % 0x10000
        hexed = F.lpad(F.hex(unit), 4, "0")
        return F.when(unit.between(0xD800, 0xDFFF), F.lit("\ufffd")).otherwise(
            F.decode(F.unhex(hexed), "UTF-16BE")
        )

    pieces = F.zip_with(
        F.split(text, pattern),
        F.transform(codes, one),
        lambda gap, char: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(char, F.lit(""))),
    )
    return F.when(text.contains("&#"), F.array_join(pieces, "")).otherwise(text)


def cell_text(html: Column) -> Column:
    """Visible text of one table cell."""
    plain = F.regexp_replace(html, "<[^>]+>", " ")
    out = plain
    for entity, char in (
        ("nbsp", " "),
        ("amp", "&"),
        ("lt", "<"),
        ("gt", ">"),
        ("quot", '"'),
    ):
        out = F.regexp_replace(out, f"(?i)&{entity};", char)
    # Most cells have no entity at all.
    return collapse_ws(F.when(html.contains("&"), decode_numeric_entities(out)).otherwise(plain))


#: Whitespace other than a plain space. What is ASCII is settled by a bit set, so that a letter is not
#: compared with every range of ``C.WS``.
ODD_WS = rf"[\t\n\x0b\f\r[\x80-\uffff&&{C.WS}]]"


def _where(needed: Callable[[Column], Column], text: Column, change: Callable[[Column], Column]) -> Column:
    """The text changed where that is needed. A lambda binds the text, so what it comes from runs once."""
    one = lambda x: F.when(needed(x), change(x)).otherwise(x)
    return F.get(F.transform(F.array(text), one), F.lit(0))


def normalize_for_hash(text: Column) -> Column:
    """Drop what changes on every fetch: script bodies, nonces, integrity hashes.

    A replacement decodes, copies and encodes the whole text; to see that there is nothing to replace is cheaper.
    """
    out = F.regexp_replace(
        text, r"(?is)<script\b[^>]*>.*?</script\s*>", "<script></script>"
    )
    # All whitespace counts alike from here, so the patterns behind look for one character.
    out = F.regexp_replace(out, ODD_WS, " ")
    for attribute in ("nonce", "integrity"):
        name = f" (?i:{attribute}) *="
        out = _where(
            lambda x, name=name: x.rlike(name), out, lambda x, name=name: F.regexp_replace(x, rf"""{name} *("[^"]*"|'[^']*')""", "")
        )
    return F.trim(_where(lambda x: x.contains("  "), out, lambda x: F.regexp_replace(x, "  +", " ")))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def snapshot_key(hash_: Column) -> Column:
    """The hex digits a stored document is filed under: all of them, so no two documents share a key."""
    return F.regexp_replace(hash_, "^sha256:", "")


def clamp_excerpt(text: Column, limit: int = C.EXCERPT_MAX_CHARS) -> Column:
    flat = collapse_ws(text)
    return F.when(
        F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 3), F.lit("..."))
    ).otherwise(flat)


def clip_log(text: Column, limit: int = C.LOG_MAX_CHARS) -> Column:
    """Head and tail of a long log with the number of dropped characters."""
    half = limit // 2
    dropped = (F.length(text) - limit).cast("string")
    return F.when(F.length(text) <= limit, text).otherwise(
        F.concat(
            F.substring(text, 1, half),
            F.lit("\n<< "),
            dropped,
            F.lit(" characters left out >>\n"),
            F.right(text, F.lit(half)),
        )
    )


def utf8_prefix(text: Column, max_bytes: Column | int) -> Column:
    """Longest prefix of whole characters that fits in ``max_bytes``."""
    limit = F.lit(max_bytes) if isinstance(max_bytes, int) else max_bytes
    # So many bytes are no more characters; what lies behind them is never encoded.
    raw = F.encode(F.substring(text, F.lit(1), F.greatest(limit + 1, F.lit(0))), "UTF-8")

    def continues(position: Column) -> Column:
        return F.hex(F.substring(raw, position, F.lit(1))).between("80", "BF")

    cut = (
        F.when(~continues(limit + 1), limit)
        .when(~continues(limit), limit - 1)
        .when(~continues(limit - 1), limit - 2)
        .otherwise(limit - 3)
    )
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.decode(F.substring(raw, F.lit(1), F.greatest(cut, F.lit(0))), "UTF-8")
    )


def requote(value: Column, quote: Column) -> Column:
    """``value`` as a literal in the original quote style."""
    backslash = "\\"
    escaped = F.replace(value, F.lit(backslash), F.lit(backslash * 2))
    escaped = F.replace(escaped, quote, F.concat(F.lit(backslash), quote))
    return F.concat(quote, escaped, quote)
