"""Bulk text edits as tables of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import requote
from .joins import first_by, lookup_join
from .occurrences import swaps

FILE = ["repo", "path"]


def swap_edits(occ: DataFrame) -> DataFrame:
    """Edits that replace an identifier; ``start``/``end`` of ``occ`` bound its content.

    TypeScript literals are requoted with the quote they had; Python content is
    replaced as it stands.
    """
    ts = F.col("lang") == "ts"
    return swaps(occ).select(
        *FILE,
        F.when(ts, F.col("start") - 1).otherwise(F.col("start")).alias("start"),
        F.when(ts, F.col("end") + 1).otherwise(F.col("end")).alias("end"),
        F.when(ts, requote(F.col("replacement"), F.col("quote"))).otherwise(F.col("replacement")).alias("new_text"),
        F.col("record_ord").alias("ord"),
        F.lit("model_id").alias("kind"),
    )


def param_edits(sites: DataFrame) -> DataFrame:
    """Edits that drop a property or rename its key; the first entry per key wins."""
    first = first_by(
        sites.select(
            *FILE, "key_start", "key_end", "key_quote", "prop_start", "prop_end", "kind", "new_name", "entry_ord"
        ),
        [*FILE, "key_start"],
        ["entry_ord"],
    )
    removal = F.col("kind") == "param_removal"
    quote = F.coalesce(F.col("key_quote"), F.lit(""))
    return first.select(
        *FILE,
        F.when(removal, F.col("prop_start")).otherwise(F.col("key_start")).alias("start"),
        F.when(removal, F.col("prop_end")).otherwise(F.col("key_end")).alias("end"),
        F.when(removal, F.lit("")).otherwise(F.concat(quote, F.col("new_name"), quote)).alias("new_text"),
        F.col("entry_ord").alias("ord"),
        "kind",
    )


def rename_edits(targets: DataFrame) -> DataFrame:
    """Edits for renamed API fields; targets carry the span of the property name."""
    return targets.select(
        *FILE, "start", "end", F.col("to").alias("new_text"), F.lit(0).cast("bigint").alias("ord"), F.lit("rename").alias("kind")
    )


def choose(edits: DataFrame) -> DataFrame:
    """Every edit once, with ``dropped``: null if it is applied, else why it is not.

    In order of start, an edit is applied when it begins at or after the end of
    the last one *applied*; of those with the same start the first by (ord, end)
    counts. ``repeated``: the same change was asked for by an earlier entry;
    ``same_start``: another change at this place goes first; ``overlaps``: it
    begins inside an applied one. Edits are first parted into islands that touch
    no earlier span, all in one shuffle by file, so the fold that remembers the
    last applied end only runs over edits that do overlap.
    """
    rows = edits.select(*FILE, "start", "end", "new_text", "ord", "kind").distinct()
    here = Window.partitionBy(*FILE).orderBy("start", "ord", "end", "new_text", "kind")
    same = Window.partitionBy(*FILE, "start").orderBy("ord", "end", "new_text", "kind")
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.struct("end", "new_text")).over(same.rowsBetween(Window.unboundedPreceding, 0))
    ranked = (
        rows.withColumn("_rank", F.row_number().over(same))
        .withColumn("_first", first)
        # A later edit at a taken start reaches nowhere.
        .withColumn("_end", F.when(F.col("_rank") == 1, F.col("end")))
        .withColumn("_reach", F.max("_end").over(before))
        .withColumn("_new", (F.col("_reach").isNull() | (F.col("start") >= F.col("_reach"))) & (F.col("_rank") == 1))
        .withColumn("_island", F.sum(F.col("_new").cast("bigint")).over(here.rowsBetween(Window.unboundedPreceding, 0)))
    )
    edit = F.struct(
        "start", "end", "ord", "new_text", "kind", "_rank",
        ((F.col("_first.end") == F.col("end")) & F.col("_first.new_text").eqNullSafe(F.col("new_text"))).alias("_again"),
    )
    islands = ranked.groupBy(*FILE, "_island").agg(F.array_sort(F.collect_list(edit)).alias("_e"))
    # The ends in force before each edit; the last one is the end of the island.
    ends = F.aggregate(
        "_e",
        F.array(F.lit(-1).cast("bigint")),
        lambda s, e: F.concat(
            s,
            F.array(
                F.when((e["_rank"] == 1) & (e["start"] >= F.element_at(s, -1)), e["end"].cast("bigint")).otherwise(
                    F.element_at(s, -1)
                )
            ),
        ),
    )
    judged = islands.withColumn("_ends", ends).select(*FILE, F.posexplode(F.arrays_zip("_e", "_ends")).alias("_n", "_z"))
    e = F.col("_z._e")
    dropped = (
        F.when((e["_rank"] > 1) & e["_again"], F.lit("repeated"))
        .when(e["_rank"] > 1, F.lit("same_start"))
        .when(e["start"] < F.col("_z._ends"), F.lit("overlaps"))
    )
    # The zip is one longer than the edits: its last row holds the final end only.
    return judged.where(e.isNotNull()).select(
        *FILE, e["start"].alias("start"), e["end"].alias("end"), e["new_text"].alias("new_text"),
        e["ord"].alias("ord"), e["kind"].alias("kind"), dropped.alias("dropped"),
    )


def non_overlapping(edits: DataFrame) -> DataFrame:
    """The edits that are applied, see ``choose``."""
    return choose(edits).where(F.col("dropped").isNull()).drop("dropped")


def dropped_edits(edits: DataFrame) -> DataFrame:
    """The edits that are not applied, each with its reason, see ``choose``."""
    return choose(edits).where(F.col("dropped").isNotNull())


def edit_order(edits: DataFrame) -> DataFrame:
    """Position of each edit counted from the end of its file."""
    per_file = edits.groupBy(*FILE).agg(
        F.sort_array(F.collect_set(F.struct("start", "end", "new_text")), asc=False).alias("_e")
    )
    return per_file.select(*FILE, F.posexplode("_e").alias("_n", "_s")).select(
        *FILE, (F.col("_n") + 1).alias("edit_no"), "_s.start", "_s.end", "_s.new_text"
    )


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(repo, path, text, new_text, edits) of every file that has edits.

    Only the spans travel: they are grouped by file and meet the texts in one
    lookup. The new text is assembled from the untouched stretches in between,
    in one pass over the file.
    """
    grouped = non_overlapping(edits).groupBy(*FILE).agg(
        F.array_sort(F.collect_list(F.struct("start", "end", F.col("new_text").alias("t")))).alias("_e")
    )
    joined = lookup_join(files.select(*FILE, "text"), grouped, FILE, "inner")
    e, text = F.col("_e"), F.col("text")
    pieces = F.transform(
        e,
        lambda x, i: F.concat(
            F.substring(
                text,
                F.when(i == 0, F.lit(0)).otherwise(F.element_at(e, F.greatest(i, F.lit(1)))["end"]) + 1,
                x["start"] - F.when(i == 0, F.lit(0)).otherwise(F.element_at(e, F.greatest(i, F.lit(1)))["end"]),
            ),
            x["t"],
        ),
    )
    tail = F.substring(text, F.element_at(e, -1)["end"] + 1, F.length(text))
    return joined.select(
        *FILE,
        "text",
        F.concat(F.array_join(pieces, ""), tail).alias("new_text"),
        F.size("_e").alias("edits"),
    )


def changed_lines(patched: DataFrame) -> DataFrame:
    """(repo, path, line, before, after); edits keep the number of lines."""
    pairs = F.arrays_zip(F.split("text", "\n").alias("b"), F.split("new_text", "\n").alias("a"))
    rows = patched.select(*FILE, F.posexplode(pairs).alias("_n", "_p"))
    return rows.where(~F.col("_p.b").eqNullSafe(F.col("_p.a"))).select(
        *FILE, (F.col("_n") + 1).alias("line"), F.col("_p.b").alias("before"), F.col("_p.a").alias("after")
    )


def change_summary(patched: DataFrame) -> DataFrame:
    return patched.where(F.col("text") != F.col("new_text")).groupBy("repo").agg(
        F.count(F.lit(1)).alias("changed_files"), F.sum("edits").alias("sites")
    )


def _without_bom(column: str):
    return F.regexp_replace(F.col(column), "^\ufeff", "")


def write_plan(pending: DataFrame, current: DataFrame) -> DataFrame:
    """Per pending write: its preflight result and the decision for its repo.

    A write is refused when its target is gone, has changed since the scan, or
    is listed twice; one refusal withholds the whole repository.
    """
    # Hashes travel as bytes, half as long as their digits and in the same order.
    digest = F.unhex(F.sha2(_without_bom("text"), 256))
    want = pending.groupBy(*FILE).agg(F.count(F.lit(1)).alias("_listed"), F.min(digest).alias("_scanned"))
    have = current.select(*FILE, digest.alias("_now"))
    checked = want.join(have, FILE, "left")
    preflight = (
        F.when(F.col("_listed") > 1, F.lit("listed_twice"))
        .when(F.col("_now").isNull(), F.lit("missing"))
        .when(F.col("_now") != F.col("_scanned"), F.lit("drifted"))
        .otherwise(F.lit("ok"))
    )
    rows = checked.select(*FILE, preflight.alias("preflight"))
    per_repo = rows.groupBy("repo").agg(F.bool_and(F.col("preflight") == "ok").alias("_go"))
    return rows.join(per_repo, "repo").select(
        *FILE, "preflight", F.when(F.col("_go"), F.lit("written")).otherwise(F.lit("refused")).alias("decision")
    )


def disposition(tier_a: DataFrame, plan: DataFrame, blocked_repos: DataFrame, write: bool) -> DataFrame:
    """Per repo: tier A split into applied, ready, refused and downgraded.

    Computed from the outcome of the write and not from its intent.
    """
    outcome = plan.groupBy("repo").agg(F.bool_and(F.col("decision") == "written").alias("_written"))
    down = blocked_repos.select("repo").distinct().withColumn("_down", F.lit(True))
    per_repo = tier_a.groupBy("repo").agg(F.count(F.lit(1)).alias("tier_a"))
    rows = per_repo.join(outcome, "repo", "left").join(down, "repo", "left")
    label = (
        F.when(F.col("_down"), F.lit("downgraded"))
        .when(F.lit(not write), F.lit("ready"))
        .when(F.coalesce(F.col("_written"), F.lit(False)), F.lit("applied"))
        .otherwise(F.lit("refused"))
    )
    return rows.withColumn("_label", label).select(
        "repo",
        "tier_a",
        *[
            F.when(F.col("_label") == s, F.col("tier_a")).otherwise(F.lit(0)).alias(s)
            for s in ("applied", "ready", "refused", "downgraded")
        ],
    )


def syntax_gate(errors: DataFrame) -> DataFrame:
    """Files whose patched side has more syntax errors than the baseline side."""
    side = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("errors"))), F.lit(0))
    return (
        errors.groupBy(*FILE)
        .agg(side("baseline").alias("baseline_errors"), side("patched").alias("patched_errors"))
        .where("patched_errors > baseline_errors")
    )
