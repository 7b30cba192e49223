"""Roll-ups of tiered occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.ids import replacement_family
from ..functions.lifecycle import swap_label
from ..functions.paths import catalog_like
from .joins import top_per_group
from .occurrences import swaps

KEY = ["repo", "path", "line", "col", "value"]


def rollup(occ: DataFrame) -> DataFrame:
    """Counts per (repo, tier, reason), per (repo, tier), per repo, and in total.

    ``level`` tells the grouping sets apart: 0 finest, 7 the grand total.
    """
    return (
        occ.select("repo", "tier", F.coalesce("reason", F.lit("-")).alias("reason"))
        .rollup("repo", "tier", "reason")
        .agg(F.count(F.lit(1)).alias("occurrences"), F.grouping_id().cast("int").alias("level"))
    )


def tier_gate(occ: DataFrame, tier: str) -> DataFrame:
    """Per repo: does the named tier hold anything."""
    return occ.groupBy("repo").agg((F.count_if(F.col("tier") == tier) > 0).alias("tripped"))


def _tiers_per_key(occ: DataFrame) -> DataFrame:
    """One row per occurrence key with its tier counts; combines before the shuffle."""
    return occ.groupBy(*KEY).agg(
        *[F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in C.TIERS],
        F.min("tier").alias("terminal_tier"),
    )


def unique_occurrences(occ: DataFrame, param_sites: DataFrame | None = None) -> DataFrame:
    """Distinct keys per repo against the sum of the tiers."""
    per_key = _tiers_per_key(occ)
    total = sum((F.col(f"n_{t}") for t in C.TIERS[1:]), F.col("n_A"))
    out = per_key.groupBy("repo").agg(
        F.count(F.lit(1)).alias("model_ids"), F.sum(total).alias("tier_sum")
    )
    if param_sites is None:
        out = out.withColumn("param_sites", F.lit(0).cast("bigint"))
    else:
        sites = param_sites.groupBy("repo").agg(F.count(F.lit(1)).alias("param_sites"))
        out = out.join(sites, "repo", "full").fillna(0)
    # Parameter sites are a separate addend on both sides of the comparison.
    return out.withColumn("total", F.col("model_ids") + F.col("param_sites")).withColumn(
        "reconciles", F.col("model_ids") == F.col("tier_sum")
    )


def collisions(occ: DataFrame, strict: bool = False) -> DataFrame:
    """Keys that landed in more than one tier; ``strict`` fails on the first."""
    held = [F.when(F.col(f"n_{t}") > 0, F.lit(t)) for t in C.TIERS]
    tiers = F.array_compact(F.array(*held))
    out = _tiers_per_key(occ).withColumn("tiers", F.array_join(tiers, "+")).where(F.size(tiers) > 1)
    if strict:
        out = out.withColumn(
            "tiers",
            F.raise_error(F.concat(F.lit("in several tiers: "), F.concat_ws(":", *KEY), F.lit(" "), "tiers")),
        )
    return out.select(*KEY, "tiers")


def terminal_tier(occ: DataFrame) -> DataFrame:
    """The tier that counts per key: A before B before C."""
    return _tiers_per_key(occ).select(*KEY, "terminal_tier")


def multi_tier_notes(occ: DataFrame, shown: int = 4) -> DataFrame:
    """Ids that appear in several tiers: first positions per tier and how many more.

    Positions are deduplicated and ranked with a per-task limit, so an id with
    much of the table never gathers its positions in one place.
    """
    sites = occ.select("repo", "value", "tier", "path", "line").distinct()
    per_tier = sites.groupBy("repo", "value", "tier").agg(
        F.count(F.lit(1)).alias("positions"),
        F.min("path").alias("_lo"),
        F.max("path").alias("_hi"),
    )
    per_id = (
        per_tier.groupBy("repo", "value")
        .agg(
            F.count(F.lit(1)).alias("_tiers"),
            (F.min("_lo") == F.max("_hi")).alias("one_file"),
        )
        .where("_tiers > 1")
        .drop("_tiers")
    )
    first = top_per_group(
        sites.join(per_id, ["repo", "value"]),
        ["repo", "value", "tier"],
        [F.col("path"), F.col("line")],
        shown,
    )
    label = F.when(F.col("one_file"), F.concat(F.lit("L"), F.col("line"))).otherwise(
        F.concat_ws(":", "path", "line")
    )
    heads = first.groupBy("repo", "value", "tier", "one_file").agg(
        F.array_sort(F.collect_list(F.struct("rank", label.alias("label")))).alias("_p")
    )
    counts = per_tier.select("repo", "value", "tier", "positions")
    out = heads.join(counts, ["repo", "value", "tier"])
    return out.select(
        "repo",
        "value",
        "tier",
        "one_file",
        F.array_join(F.transform("_p", lambda p: p["label"]), ", ").alias("shown"),
        F.greatest(F.col("positions") - shown, F.lit(0)).alias("more"),
    )


def reason_rank(reason: Column) -> Column:
    position = F.array_position(F.array(*[F.lit(r) for r in C.REVIEW_REASONS]), reason)
    return F.when(position == 0, F.lit(len(C.REVIEW_REASONS) + 1)).otherwise(position)


def review_order(occ: DataFrame) -> list[Column]:
    return [reason_rank(F.col("reason")), F.col("path"), F.col("line"), F.col("col"), F.col("value")]


def review_findings(occ: DataFrame) -> DataFrame:
    """All review findings in total order (paths compare bytewise)."""
    return occ.where(F.col("tier") == "B").orderBy("repo", *review_order(occ))


def review_top(occ: DataFrame, k: int = 12) -> DataFrame:
    """The first ``k`` distinct review findings per repo and how many follow."""
    found = occ.where(F.col("tier") == "B").select(
        "repo", "reason", "path", "line", "col", "value", "verdict"
    ).distinct()
    totals = found.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"))
    top = top_per_group(found, ["repo"], review_order(found), k)
    return (
        top.join(totals, "repo")
        .withColumn("more", F.greatest(F.col("_n") - k, F.lit(0)))
        .drop("_n")
    )


def file_rollup(occ: DataFrame) -> DataFrame:
    """Per file of informational findings: hits, ids, comparisons, catalog flag."""
    data = occ.where(F.col("tier") == "C").select("repo", "path", "value", "purpose")
    # Dealt by file: the counts per id and those per file need no other shuffle.
    per_id = data.repartition("repo", "path").groupBy("repo", "path", "value").agg(
        F.count(F.lit(1)).alias("_hits"),
        F.count_if(F.col("purpose") == "comparison").alias("_comparisons"),
    )
    out = per_id.groupBy("repo", "path").agg(
        F.sum("_hits").alias("hits"),
        F.count(F.lit(1)).alias("ids"),
        F.sum("_comparisons").alias("comparisons"),
    )
    return out.withColumn("catalog_like", catalog_like(F.col("path"), F.col("ids")))


def file_id_lines(occ: DataFrame, shown: int = 4) -> DataFrame:
    """Per file and id: hits, first distinct lines, how many more lines.

    A group is an id in one file. Everything is one shuffle by the group: lines are
    counted, ranked and totalled where they lie.
    """
    keys = ["repo", "path", "value"]
    data = occ.where(F.col("tier") == "C").select(*keys, "line").repartition(*keys)
    counts = data.groupBy(*keys, "line").agg(F.count(F.lit(1)).alias("_n"))
    ordered = Window.partitionBy(*keys).orderBy("line")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = counts.select(
        *keys,
        "line",
        F.row_number().over(ordered).alias("_rank"),
        F.sum("_n").over(whole).alias("hits"),
        F.count(F.lit(1)).over(whole).alias("lines"),
    )
    first = ranked.where(F.col("_rank") <= shown)
    heads = first.groupBy(*keys, "hits", "lines").agg(F.array_sort(F.collect_list("line")).alias("_l"))
    return heads.select(
        *keys,
        "hits",
        F.array_join(F.transform("_l", lambda n: F.concat(F.lit("L"), n)), ", ").alias("shown"),
        F.greatest(F.col("lines") - shown, F.lit(0)).alias("more"),
    )


def swap_labels(occ: DataFrame) -> DataFrame:
    """Distinct labels of the swaps per repo, with their sites."""
    label = swap_label(
        F.col("value"), F.col("replacement"), F.col("lifecycle"), F.col("shutdown_date")
    )
    return (
        swaps(occ)
        .groupBy("repo", label.alias("label"))
        .agg(F.count(F.lit(1)).alias("sites"))
    )


def mixed_families(occ: DataFrame) -> DataFrame:
    """Repos whose swaps lead to more than one replacement family, one row per target."""
    targets = (
        swaps(occ)
        .groupBy("repo", "replacement")
        .agg(F.count(F.lit(1)).alias("sites"))
        .withColumn("family", replacement_family(F.col("replacement")))
    )
    mixed = (
        targets.groupBy("repo")
        .agg(F.countDistinct("family").alias("families"))
        .where("families > 1")
    )
    return targets.join(mixed, "repo")


def patch_evidence(occ: DataFrame) -> DataFrame:
    """Per repo: are all records behind the swaps verified and official; stamps.

    A repo without swaps answers ``n/a`` and not ``verified``.
    """
    records = swaps(occ).select(
        "repo", "value", "v_status", "v_official", "v_replacement", "checked_at"
    ).distinct()
    ok = F.coalesce((F.col("v_status") == "verified") & F.col("v_replacement"), F.lit(False))
    official = F.coalesce(F.col("v_official"), F.lit(False))
    stamp = F.nullif(F.col("checked_at"), F.lit(""))
    rolled = records.groupBy("repo").agg(
        F.count(F.lit(1)).alias("records"),
        F.bool_and(ok).alias("_ok"),
        F.bool_and(official).alias("_official"),
        F.min(stamp).alias("oldest"),
        F.count_if(stamp.isNull()).alias("undated"),
    )
    repos = occ.select("repo").distinct()
    out = repos.join(rolled, "repo", "left").fillna(0, ["records", "undated"])
    state = lambda flag, yes, no: F.when(F.col("records") == 0, F.lit("n/a")).otherwise(
        F.when(F.col(flag), F.lit(yes)).otherwise(F.lit(no))
    )
    return out.select(
        "repo",
        "records",
        state("_ok", "verified", "not verified").alias("replacement_verdict"),
        state("_official", "confirmed", "not confirmed").alias("official_source"),
        "oldest",
        "undated",
    )


def capped(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """First ``k`` rows per group with ``more``: the number of rows beyond them."""
    totals = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    top = top_per_group(df, keys, order, k)
    return (
        top.join(totals, keys)
        .withColumn("more", F.greatest(F.col("_n") - k, F.lit(0)))
        .drop("_n")
    )
