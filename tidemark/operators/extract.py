"""Fact tables from source files.

``token_structure`` reads every text in one fold inside its row (see ``reading``),
so literals, options, constants and sinks come out of Spark expressions for both
languages; only texts and what was found in them are shuffled, never tokens. ``python_facts`` is a second reading of Python
by the standard library's own parser, kept for comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import TEXT, identified
from ..session import durable
from .joins import lookup_join
from .reading import FILE, facts

# A type as tokens with blanks between them: names, generics, arrays, unions, texts, tuples, shapes.
_ATOM = (
    r"(?:(?:keyof|typeof|readonly|unique) )*(?:[A-Za-z_$][\w$]*(?: \. [A-Za-z_$][\w$]*)*(?: <[^;=]*? >(?= [|&\[,;)\]}]|$| [A-Za-z]))?"
    r"|[\"'][^\"']*[\"']|\d[\w.]*|\([^()]*\)|\{[^{}]*\}|\[[^\[\]]*\])(?: \[ \])*"
)
_CAST = rf"^(?:\) )*as ({_ATOM}(?: [|&] {_ATOM})*)"


def token_structure(files: DataFrame, wanted: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(repo, path, lang, lits, parts): what one reading of each file finds, as arrays of the file's row.

    Written, because literals, options, constants and sinks all start from it. What a reading finds depends
    on language and text alone, and reading costs far more than moving a text: files are spread by their text
    before it, copies of a text are read once, and every file meets what was found by its text's identity.
    ``wanted`` keeps some of the different texts (lang, text); files with another text have no row.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = files.select("lang", "text").repartition(parts, "lang", "text").distinct()
    if wanted is not None:
        texts = wanted(durable(texts, "texts")).repartition(parts, "lang", "text")
    found = facts(identified(texts), TEXT)
    return durable(lookup_join(identified(files).select(*FILE, "lang", *TEXT), found, ["lang", *TEXT]).drop(*TEXT), "facts")


def _is_word(tok: Column) -> Column:
    return F.coalesce(tok.rlike(r"^[A-Za-z_$]"), F.lit(False))


def _is_string(tok: Column) -> Column:
    return F.coalesce(tok.rlike("^[\"'`]"), F.lit(False))


def _content(tok: Column) -> Column:
    width = F.when(tok.rlike("^(\"\"\"|''')"), 3).otherwise(1)
    return F.substring(tok, width + 1, F.length(tok) - 2 * width)


def literals(structure: DataFrame) -> DataFrame:
    """Literal facts, one row for each string that can be a value."""
    tok = F.col("tok")
    py = F.col("lang") == "py"
    raw = _content(tok)
    width = (F.length(tok) - F.length(raw)) / 2
    cast = F.regexp_replace(F.regexp_extract("behind", _CAST, 1), r" ?([.<>\[\]]) ?", "$1")
    return structure.select(*FILE, "lang", F.inline("lits")).select(
        *FILE,
        "lang",
        F.col("line").cast("bigint").alias("line"),
        F.col("col").cast("bigint").alias("col"),
        (F.col("start") + width).cast("bigint").alias("start"),
        (F.col("end") - width).cast("bigint").alias("end"),
        F.substring(tok, F.lit(1), width.cast("int")).alias("quote"),
        F.when(py, raw).otherwise(F.regexp_replace(raw, r"\\(.)", "$1")).alias("value"),
        "enclosure",
        "encl_name",
        "in_call",
        "callee",
        F.when(~py & F.col("behind").isNotNull() & (cast != ""), cast).alias("cast_type"),
    )


def _segments(structure: DataFrame) -> DataFrame:
    """One row per comma-separated part of a call or an object literal."""
    return structure.select(*FILE, "lang", F.inline("parts"))


def option_objects(structure: DataFrame) -> DataFrame:
    """Keys of TypeScript object literals, with the spans an edit needs."""
    seg = _segments(structure).where((F.col("role") == "object") & (F.col("lang") == "ts") & (F.col("n") > 0))
    first, third = F.col("t1.tok"), F.col("t3.tok")
    kind = (
        F.when(first == "...", F.lit("spread"))
        .when(F.coalesce(F.col("t2.tok") == ":", F.lit(False)), F.lit("property"))
        .when((F.col("n") == 1) & _is_word(first), F.lit("shorthand"))
        .otherwise(F.lit("method"))
    )
    simple = (kind == "property") & (F.col("n") == 3)
    literal = simple & _is_string(third) & ~(third.startswith("`") & third.contains("${"))
    quoted = _is_string(first)
    return seg.select(
        *FILE,
        F.col("obj_id").cast("bigint").alias("obj_id"),
        F.when(quoted, _content(first)).otherwise(first).alias("key"),
        kind.alias("key_kind"),
        F.when(literal, F.regexp_replace(_content(third), r"\\(.)", "$1")).alias("value_literal"),
        F.when(simple & _is_word(third), third).when(kind == "shorthand", first).alias("value_ident"),
        F.when(literal, (F.col("t3.start") + 1).cast("bigint")).alias("value_start"),
        F.col("t1.line").cast("bigint").alias("line"),
        F.col("t1.col").cast("bigint").alias("col"),
        F.col("t1.start").cast("bigint").alias("key_start"),
        F.col("t1.end").cast("bigint").alias("key_end"),
        F.when(quoted, F.substring(first, 1, 1)).alias("key_quote"),
        F.col("t1.start").cast("bigint").alias("prop_start"),
        F.col("stop").cast("bigint").alias("prop_end"),
    )


def const_bindings(structure: DataFrame) -> DataFrame:
    """Constants bound to one plain literal in a TypeScript file."""
    declared = F.coalesce(F.col("eq_left").isin("const", "let", "var"), F.lit(False))
    found = structure.where(F.col("lang") == "ts").select(*FILE, F.inline("lits")).where(F.col("direct") & declared)
    return found.select(
        *FILE,
        F.col("eq_name").alias("ident"),
        F.regexp_replace(_content(F.col("tok")), r"\\(.)", "$1").alias("literal"),
        (F.col("start") + 1).cast("bigint").alias("literal_start"),
    )


def sink_facts(structure: DataFrame) -> DataFrame:
    """Names that reach a model keyword, a model factory, or a model key of a call."""
    seg = _segments(structure).where(F.col("lang") == "py")
    chain = r"([A-Za-z_][\w.]*)"
    keyword = F.regexp_extract("written", rf"^(\w*)={chain}$", 1)
    key = F.regexp_extract("written", rf"""^["'](.*)["']:{chain}$""", 1)
    value = (
        F.when(
            (F.col("role") == "call") & keyword.rlike(C.MODEL_NAME_PATTERN),
            F.regexp_extract("written", rf"={chain}$", 1),
        )
        .when(
            (F.col("role") == "call") & F.col("callee").isin(*C.PY_FACTORIES),
            F.regexp_extract("written", rf"^{chain}$", 1),
        )
        .when(
            (F.col("role") == "object") & F.col("in_call") & key.rlike(C.MODEL_NAME_PATTERN),
            F.regexp_extract("written", rf":{chain}$", 1),
        )
    )
    name = F.substring_index(value, ".", -1)
    return seg.select(*FILE, name.alias("name")).where(F.coalesce(F.col("name") != "", F.lit(False))).distinct()


# --- exact reading of Python -------------------------------------------------

FACTS = (
    "repo string, path string, lang string, fact string, line bigint, col bigint, start bigint, end bigint, "
    "quote string, value string, enclosure string, encl_name string, in_call boolean, callee string, ident string"
)
_FIELDS = [part.split()[0] for part in FACTS.split(", ")]


def python_facts(files: DataFrame) -> DataFrame:
    """Literal, sink and error facts of Python files in one Arrow pass.

    Run the prefilter first: Spark cannot move a filter below a Python step.
    """

    def read(batches: Iterator) -> Iterator:
        from .scanners import scan_python

        for batch in batches:
            rows = []
            for repo, path, text in zip(batch["repo"], batch["path"], batch["text"]):
                for fact in scan_python(text):
                    fact.update(repo=repo, path=path, lang="py")
                    rows.append([fact.get(f) for f in _FIELDS])
                if len(rows) >= 20_000:
                    yield _frame(rows)
                    rows = []
            yield _frame(rows)

    return files.where(F.col("lang") == "py").select(*FILE, "text").mapInPandas(read, FACTS)


def _frame(rows: list[list]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_FIELDS, dtype=object)
    for name in ("line", "col", "start", "end"):
        frame[name] = frame[name].astype("Int64")
    frame["in_call"] = frame["in_call"].astype("boolean")
    return frame


def python_literals(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact") == "literal").select(
        *FILE, "lang", "line", "col", "start", "end", "quote", "value", "enclosure", "encl_name", "in_call",
        "callee", F.lit(None).cast("string").alias("cast_type"),
    )


def python_sinks(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact") == "sink").select(*FILE, F.col("ident").alias("name"))


def unreadable_files(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("fact") == "error").select(*FILE)


def syntax_errors(texts: DataFrame, side: str) -> DataFrame:
    """(repo, path, side, errors) of Python texts; 1 for a text that does not parse."""

    @F.pandas_udf("int")
    def errors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from .scanners import python_errors

        for batch in batches:
            yield batch.map(python_errors)

    return texts.select(*FILE, F.lit(side).alias("side"), errors(F.col("text")).alias("errors"))


# --- table function for SQL --------------------------------------------------

SCAN_COLUMNS = "line bigint, col bigint, value string, enclosure string, encl_name string, in_call boolean"


def register_scan_function(spark: SparkSession, name: str = "scan_literals") -> None:
    """``SELECT ... FROM files, LATERAL scan_literals(text)`` for Python sources."""
    from pyspark.sql.functions import udtf

    @udtf(returnType=SCAN_COLUMNS)
    class ScanLiterals:
        def eval(self, text: str):
            from tidemark.operators.scanners import scan_python

            for fact in scan_python(text):
                if fact["fact"] == "literal":
                    yield tuple(
                        fact.get(k) for k in ("line", "col", "value", "enclosure", "encl_name", "in_call")
                    )

    spark.udtf.register(name, ScanLiterals)
