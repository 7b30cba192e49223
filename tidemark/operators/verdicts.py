"""Replacement verdicts, chained deprecations, re-stamping and its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, lifecycle
from ..functions.text import trim_ws
from ..session import shared_path
from .joins import lookup_join
from .registry import model_entries

# Reasons written by this engine start with one of these; everything else in a
# record's reasons was written by a person and survives a re-stamp.
MACHINE_REASON = (
    r"^(out of class: |chained: |not live: |live: |official is |official agrees: )"
)


def is_live(df: DataFrame, live: DataFrame, id_col: str, out: str) -> DataFrame:
    """Flag rows whose id is live in canonical or in family form.

    Two equality lookups; an OR of both forms in one join would be a nested loop.
    """
    forms = live.select(F.col("form").alias("_form")).distinct().withColumn("_hit", F.lit(True))
    for n, form in enumerate((ids.canonical_id, ids.family_id)):
        probe = df.withColumn("_form", form(F.col(id_col)))
        df = lookup_join(probe, forms, ["_form"], "left").withColumnRenamed("_hit", f"_hit{n}").drop("_form")
    return df.withColumn(
        out, F.coalesce(F.col("_hit0"), F.col("_hit1"), F.lit(False))
    ).drop("_hit0", "_hit1")


def _official_for(df: DataFrame, official: DataFrame, key: Column, out: str) -> DataFrame:
    table = official.groupBy(F.col("dep_canon").alias("_key")).agg(
        F.max("recommended").alias(out)
    )
    return lookup_join(df.withColumn("_key", key), table, ["_key"], "left").drop("_key")


def classify(records: DataFrame, live: DataFrame, official: DataFrame) -> DataFrame:
    """Adds ``verdict`` and ``verdict_reasons`` to rows with deprecated / replacement.

    Order of the tests: out of class, chained, not live, behind the official
    recommendation, verified. Quarantine is a human decision and never results.
    """
    dep, rep = F.col("deprecated"), F.col("replacement")
    df = records.withColumn("_rep", ids.canonical_id(rep)).withColumn("_dep", ids.canonical_id(dep))
    df = _official_for(df, official, F.col("_rep"), "_onward")
    df = _official_for(df, official, F.col("_dep"), "_official")
    df = is_live(df, live, "replacement", "_live")

    dep_class = ids.class_of_canonical(F.col("_dep"))
    rep_class = ids.class_of_canonical(F.col("_rep"))
    out_class = F.when(~ids.catalog_verifiable(dep_class), dep_class).when(
        ~ids.catalog_verifiable(rep_class), rep_class
    )
    chained = F.col("_onward").isNotNull()
    stale = F.col("_official").isNotNull() & (
        ids.canonical_id(F.col("_official")) != F.col("_rep")
    )
    verdict = (
        F.when(out_class.isNotNull(), F.lit("unverifiable"))
        .when(chained | ~F.col("_live") | stale, F.lit("unverified"))
        .otherwise(F.lit("verified"))
    )
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    behind = say("official is ", F.col("_official"))
    reasons = (
        F.when(out_class.isNotNull(), F.array(say("out of class: ", out_class)))
        .when(chained, F.array(say("chained: ", rep, " -> ", F.col("_onward"))))
        .when(
            ~F.col("_live"),
            F.array_compact(F.array(say("not live: ", rep), F.when(stale, behind))),
        )
        .otherwise(
            F.array_compact(
                F.array(
                    say("live: ", rep),
                    F.when(stale, behind).when(
                        F.col("_official").isNotNull(),
                        say("official agrees: ", F.col("_official")),
                    ),
                )
            )
        )
    )
    return (
        df.withColumn("verdict", verdict)
        .withColumn("verdict_reasons", reasons)
        .drop("_onward", "_official", "_live", "_rep", "_dep")
    )


def merge_reasons(fresh: Column, prior: Column) -> Column:
    """Fresh machine reasons, then earlier human reasons in their order."""
    kept = F.filter(
        F.coalesce(prior, F.array().cast("array<string>")),
        lambda r: ~trim_ws(r).rlike(MACHINE_REASON) & ~F.array_contains(fresh, r),
    )
    return F.concat(fresh, kept)


def _switches(df: DataFrame, withhold: Column) -> DataFrame:
    official = lifecycle.official_source_confirmed()
    replacement = F.col("verdict") == "verified"
    return (
        df.withColumn("new_official", official)
        .withColumn("new_replacement", replacement)
        .withColumn("new_auto", ~withhold & official & replacement)
    )


def restamp(
    registry: DataFrame, live: DataFrame, official: DataFrame, checked_at: str, sources: list[str]
) -> DataFrame:
    """Registry with fresh stamps; a quarantine stays until a person clears it."""
    df = classify(model_entries(registry), live, official)
    held = F.coalesce(F.col("v_status") == "quarantined", F.lit(False))
    df = _switches(df, held)
    stamped = (
        df.withColumn("entry_id", ids.entry_id(F.col("provider"), F.col("deprecated"), F.col("shutdown_date")))
        .withColumn("old_status", F.coalesce(F.col("v_status"), F.lit("unstamped")))
        .withColumn("v_status", F.when(held, F.lit("quarantined")).otherwise(F.col("verdict")))
        .withColumn("v_official", F.col("new_official"))
        .withColumn("v_replacement", F.col("new_replacement"))
        .withColumn("v_auto", F.col("new_auto"))
        .withColumn("quarantine_reason", F.when(held, F.col("quarantine_reason")))
        .withColumn("checked_at", F.lit(checked_at))
        .withColumn("sources", F.array(*[F.lit(s) for s in sources]).cast("array<string>"))
        .withColumn("reasons", merge_reasons(F.col("verdict_reasons"), F.col("reasons")))
    )
    return stamped.drop("new_official", "new_replacement", "new_auto")


def stamp_candidates(candidates: DataFrame, live: DataFrame, official: DataFrame, checked_at: str) -> DataFrame:
    """Classification only: candidates get a verdict and switches, nothing moves."""
    df = _switches(classify(candidates, live, official), F.lit(False))
    return (
        df.withColumn("v_status", F.col("verdict"))
        .withColumn("v_official", F.col("new_official"))
        .withColumn("v_replacement", F.col("new_replacement"))
        .withColumn("v_auto", F.col("new_auto"))
        .withColumn("checked_at", F.lit(checked_at))
        .drop("new_official", "new_replacement", "new_auto")
    )


def audit(restamped: DataFrame) -> DataFrame:
    """Per (was, now): records, flips, and flips away from a verified stamp."""
    flip = F.col("old_status") != F.col("v_status")
    return restamped.groupBy(
        F.col("old_status").alias("was"), F.col("v_status").alias("now")
    ).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(flip).alias("flips"),
        F.count_if(flip & (F.col("old_status") == "verified")).alias("unsafe_flips"),
    )


def chain_ends(official: DataFrame) -> DataFrame:
    """(dep_canon, hops, final, cyclic): where a chain of recommendations ends.

    Pointer doubling: each round squares the distance covered, so a chain of n
    records takes log2(n) joins. Only chains that are still open are joined, so
    an end that many chains share is no hot key. Every round is written to the
    shared folder, which cuts the lineage and survives the loss of executors.
    """
    spark = official.sparkSession
    edges = official.groupBy("dep_canon").agg(
        F.max("recommended").alias("recommended")
    ).select("dep_canon", ids.canonical_id(F.col("recommended")).alias("next"))
    nodes = edges.select("dep_canon")
    # A target that is no key itself is the end of its chain.
    keys = nodes.select(F.col("dep_canon").alias("next")).withColumn("_more", F.lit(True))
    step = edges.join(keys, "next", "left").select(
        "dep_canon", "next", F.lit(1).cast("bigint").alias("hops"), F.coalesce("_more", F.lit(False)).alias("open")
    )
    open_before = -1
    while True:
        path = shared_path(spark, "chains")
        step.write.parquet(path)
        step = spark.read.parquet(path)
        still_open = step.agg(F.count_if("open")).first()[0]
        # A chain of more than 2^k steps passes a node that is exactly 2^k from the
        # end and closes in round k. If no walk closed, the open ones are cycles.
        if still_open in (0, open_before):
            break
        open_before = still_open
        ahead = step.select(
            F.col("dep_canon").alias("next"),
            F.col("next").alias("_next"),
            F.col("hops").alias("_hops"),
            F.col("open").alias("_open"),
        )
        # An open chain stands at a key, so it always finds the next stretch.
        longer = step.where("open").join(ahead, "next").select(
            "dep_canon",
            F.col("_next").alias("next"),
            (F.col("hops") + F.col("_hops")).alias("hops"),
            F.col("_open").alias("open"),
        )
        step = step.where("not open").select("dep_canon", "next", "hops", "open").union(longer)
    return step.select(
        "dep_canon",
        F.when(~F.col("open"), F.col("hops")).alias("hops"),
        F.when(~F.col("open"), F.col("next")).alias("final"),
        F.col("open").alias("cyclic"),
    )

