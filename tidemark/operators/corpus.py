"""Operators on whole source files: scope, annotations, prefilter, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.paths import in_scan_scope, language, unix_path
from ..functions.text import TEXT, identified
from .joins import lookup_join
from .registry import model_entries, param_entries

def annotation(text: Column, marker: str = "scan") -> Column:
    """``model-catalog`` or ``ignore-file`` when a marker stands alone on one of
    the first five lines; null otherwise."""
    pattern = rf"^{C.WS}*(?://|#){C.WS}*{marker}:{C.WS}*({'|'.join(C.ANNOTATIONS)}){C.WS}*$"
    head = F.slice(F.split(text, r"\r?\n"), 1, C.ANNOTATION_LINES)
    found = F.filter(head, lambda line: line.rlike(pattern))
    return F.regexp_extract(F.try_element_at(found, F.lit(1)), pattern, 1)


def in_scope(files: DataFrame) -> DataFrame:
    path = unix_path(F.col("path"))
    return files.where(in_scan_scope(path)).withColumn("lang", language(path))


def unannotated(texts: DataFrame, marker: str = "scan") -> DataFrame:
    return texts.where(annotation(F.col("text"), marker).isNull())


def scannable(files: DataFrame, marker: str = "scan") -> DataFrame:
    """Files in scope that carry no annotation."""
    return unannotated(in_scope(files), marker)


def registry_tokens(registry: DataFrame) -> DataFrame:
    """Distinct ids and parameter-coupled models: what a relevant file contains."""
    id_tokens = model_entries(registry).select(F.col("deprecated").alias("token"))
    model_tokens = param_entries(registry).select(F.explode("on_models").alias("token"))
    return id_tokens.unionByName(model_tokens).where("token <> ''").distinct()


GRAM = 8  # characters of a key that a longer token is looked up by
SIEVE_WORDS = 1 << 20  # the sieve has that many words of 64 bits, whatever the number of tokens
SIEVE_HASHES = 2


def _grams(text: str, width: Column) -> Column:
    """Distinct runs of ``width`` characters; one that starts inside a character is harmless, as hits are confirmed."""
    return F.array_distinct(F.regexp_extract_all(F.col(text), F.concat(F.lit("(?s)(?=(.{"), width, F.lit("}))")), F.lit(1)))


def _bits(gram: str, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), gram), F.lit(64 * size)) for seed in range(SIEVE_HASHES)]


def sieve(keys: DataFrame, size: int = SIEVE_WORDS) -> DataFrame:
    """One row with one array of fixed length: a bitmap of the hashes of the ``gram`` column."""
    set_bits = keys.select(F.explode(F.array(*_bits("gram", size))).alias("bit")).groupBy(F.expr("bit div 64").alias("id")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits")
    )
    words = keys.sparkSession.range(size).join(set_bits, "id", "left")
    ordered = F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits"))))
    return words.agg(ordered.getField("bits").alias("words"))


def passes(gram: str, bitmap: Column, size: int = SIEVE_WORDS) -> Column:
    """Whether all bits of the gram are set: of other runs than keys, 4 in 100 with 7 million keys."""
    all_set = F.lit(True)
    for bit in _bits(gram, size):
        word = F.get(bitmap, F.floor(bit / 64).cast("int"))
        all_set = all_set & (F.bit_get(word, (bit % 64).cast("int")) == 1)
    return all_set


def _mentioning(texts: DataFrame, tokens: DataFrame) -> DataFrame:
    """Identities of the texts that contain any token, for a list of any size.

    Each token is looked up by that run of its characters which fewest tokens have. The runs of a text
    pass through the sieve of these keys in the task that cuts them, so few of them are ever shuffled;
    the rest meets the keys by equality, and what meets is confirmed on the text.
    """
    tokens = tokens.select("token", F.least(F.length("token"), F.lit(GRAM)).alias("width")).distinct()
    runs = tokens.select("token", "width", F.explode(_grams("token", F.col("width").cast("string"))).alias("gram"))
    shared = runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    keys = runs.join(shared, "gram").groupBy("token").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    widths = tokens.select("width").distinct()  # no more than GRAM rows
    texts = identified(texts.where(F.col("text").isNotNull()).select("text"))
    cut = texts.crossJoin(F.broadcast(widths)).select(*TEXT, F.explode(_grams("text", F.col("width").cast("string"))).alias("gram"))
    met = cut.where(passes("gram", sieve(keys).scalar())).join(keys, "gram").select(*TEXT, "token").distinct()
    return met.join(texts.dropDuplicates(TEXT), TEXT).where(F.col("text").contains(F.col("token"))).select(*TEXT).distinct()


def _marked(files: DataFrame, tokens: DataFrame, wanted: Column) -> DataFrame:
    """The files with ``_hit``: whether a wanted one contains any token. One plan for every list; nothing runs before it."""
    hits = _mentioning(files.where(wanted), tokens).withColumn("_found", F.lit(True))
    return lookup_join(identified(files, wanted), hits, TEXT, "left").withColumn("_hit", F.coalesce("_found", F.lit(False))).drop(*TEXT, "_found")


def prefilter(files: DataFrame, tokens: DataFrame) -> DataFrame:
    """Files whose text contains any registry token."""
    return _marked(files, tokens, F.lit(True)).where("_hit").select(*(F.col(f"`{c}`") for c in files.columns))


def quoted_ids(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct (repo, path, id) of registry ids that stand quoted in a text.

    Quoted strings are cut out and matched by equality; looking for every id in
    every text would be a nested loop.
    """
    tokens = F.array_distinct(
        F.flatten(
            F.array(
                *[
                    F.regexp_extract_all(F.col("text"), F.lit(p), F.lit(1))
                    for p in (r'"([^"\n]*)"', r"'([^'\n]*)'", r"`([^`\n]*)`")
                ]
            )
        )
    )
    words = files.select("repo", "path", F.explode(tokens).alias("id"))
    known = model_entries(registry).select(F.col("deprecated").alias("id")).distinct()
    return lookup_join(words, known, ["id"], "left_semi").select("repo", "path", "id").distinct()


def annotated_files(files: DataFrame, registry: DataFrame, marker: str = "scan") -> DataFrame:
    """(repo, path, annotation, ids): catalogs with their id count, ignored files."""
    marked = in_scope(files).withColumn("annotation", annotation(F.col("text"), marker)).where(
        F.col("annotation").isNotNull()
    )
    catalogs = marked.where(F.col("annotation") == "model-catalog")
    counts = quoted_ids(catalogs, registry).groupBy("repo", "path").agg(F.count(F.lit(1)).alias("ids"))
    out = marked.select("repo", "path", "annotation")
    return out.join(counts, ["repo", "path"], "left").fillna(0, ["ids"])


def coverage(files: DataFrame, registry: DataFrame, marker: str = "scan") -> DataFrame:
    """One row per repo: files per language, prefilter hits, annotations, verdict.

    One aggregation over the files. No analyzable file is an error and not a
    clean bill.
    """
    path = unix_path(F.col("path"))
    scope = in_scan_scope(path)
    note = annotation(F.col("text"), marker)
    marked = _marked(files, registry_tokens(registry), F.coalesce(scope, F.lit(False))).select(
        "repo",
        scope.alias("_in"),
        language(path).alias("_lang"),
        "_hit",
        F.when(scope, note).alias("_note"),
    )
    inside = F.col("_in")
    return (
        marked.groupBy("repo")
        .agg(
            F.count_if(inside).alias("files"),
            F.count_if(inside & (F.col("_lang") == "ts")).alias("ts_files"),
            F.count_if(inside & (F.col("_lang") == "py")).alias("py_files"),
            F.count_if(F.col("_hit")).alias("matched"),
            F.count_if(F.col("_note") == "ignore-file").alias("ignored"),
            F.count_if(F.col("_note") == "model-catalog").alias("catalogs"),
        )
        .withColumn("scan_ok", F.col("files") > 0)
    )


def uncovered(on_disk: DataFrame, loaded: DataFrame) -> DataFrame:
    """In-scope files that were not loaded; case and slashes do not count."""
    key = F.lower(unix_path(F.col("path")))
    have = loaded.select("repo", key.alias("_key")).distinct()
    want = in_scope(on_disk).select("repo", "path", key.alias("_key"))
    return want.join(have, ["repo", "_key"], "left_anti").select("repo", "path")

