"""Deprecation-claim checks and promotion of queued candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids, lifecycle
from ..functions.text import snapshot_key
from .joins import first_by, lookup_join
from .verdicts import classify, merge_reasons


def unbacked_refs(refs: DataFrame, stored: DataFrame) -> DataFrame:
    """Evidence references with no stored document; ``stored`` has ``doc_key``."""
    keyed = refs.withColumn("doc_key", snapshot_key(F.col("content_hash")))
    return lookup_join(keyed, stored.select("doc_key").distinct(), ["doc_key"], "left_anti")


def evidence_summary(refs: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Per record: number of refs, refs without a stored document, refs quoting the id."""
    keyed = refs.withColumn("doc_key", snapshot_key(F.col("content_hash")))
    known = stored.select("doc_key").distinct().withColumn("_stored", F.lit(True))
    marked = lookup_join(keyed, known, ["doc_key"], "left")
    quotes = lifecycle.non_empty(F.col("excerpt")) & ids.excerpt_names(
        F.col("excerpt"), F.col("deprecated")
    )
    return marked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("refs"),
        F.count_if(F.col("_stored").isNull()).alias("unbacked"),
        F.count_if(F.coalesce(quotes, F.lit(False))).alias("quoting"),
    )


def claim_reasons(
    candidates: DataFrame, refs: DataFrame, stored: DataFrame, live: DataFrame
) -> DataFrame:
    """Adds ``claim_reasons`` (every rule the claim fails) and ``unbacked`` (a count).

    "Live" here means the canonical form exactly; the family form would make a
    retired dated release look alive because of its successor.
    """
    summary = evidence_summary(refs, stored, ["candidate_id"])
    df = candidates.join(summary, "candidate_id", "left")
    forms = live.select(F.col("form").alias("_canon")).distinct().withColumn("_live", F.lit(True))
    df = lookup_join(
        df.withColumn("_canon", ids.canonical_id(F.col("deprecated"))), forms, ["_canon"], "left"
    )
    unbacked = F.coalesce(F.col("unbacked"), F.lit(0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("status").isNull(), F.lit("no_status")),
            F.when((F.col("status") == "retired") & F.col("_live"), F.lit("retired_but_live")),
            F.when(
                (F.col("status") == "deprecated") & ~lifecycle.non_empty(F.col("shutdown_date")),
                F.lit("deprecated_without_date"),
            ),
            F.when(F.coalesce(F.col("quoting"), F.lit(0)) == 0, F.lit("no_quoting_excerpt")),
            F.when(unbacked > 0, F.lit("unbacked_ref")),
        )
    )
    return (
        df.withColumn("claim_reasons", reasons)
        .withColumn("unbacked", unbacked)
        .drop("_canon", "_live", "quoting")
    )


def decide(
    requests: DataFrame,
    candidates: DataFrame,
    registry: DataFrame,
    refs: DataFrame,
    stored: DataFrame,
    live: DataFrame,
    official: DataFrame,
) -> DataFrame:
    """(pos, candidate_id, decision, ...) for every promotion request.

    Requests are served in ``pos`` order. decision is ``promoted``, ``repeated``
    (same id after its promotion), or the first failing rule: ``unknown``,
    ``no_evidence``, ``already_active``, ``not_verified``, ``claim_fails``.
    The order dependence reduces to the first passing request per identifier,
    an aggregate that combines before the shuffle.
    """
    judged = claim_reasons(classify(candidates, live, official), refs, stored, live)
    judged = judged.withColumn("canon", ids.canonical_id(F.col("deprecated")))
    active = (
        registry.where(F.col("kind") == "model_id")
        .select(ids.canonical_id(F.col("deprecated")).alias("canon"))
        .distinct()
        .withColumn("_active", F.lit(True))
    )
    judged = lookup_join(judged, active, ["canon"], "left")
    facts = judged.select(
        "candidate_id",
        "canon",
        "provider",
        "deprecated",
        "replacement",
        "verdict",
        F.coalesce(F.col("refs"), F.lit(0)).alias("refs"),
        F.coalesce(F.col("_active"), F.lit(False)).alias("active"),
        (F.size("claim_reasons") == 0).alias("claim_ok"),
    )
    asked = requests.select("pos", "candidate_id").join(facts, "candidate_id", "left")
    passes = (
        (F.col("refs") > 0)
        & ~F.col("active")
        & (F.col("verdict") == "verified")
        & F.col("claim_ok")
    )
    asked = asked.withColumn("_passes", F.coalesce(passes, F.lit(False)))
    winners = first_by(
        asked.where("_passes").select(
            "canon", F.col("pos").alias("_win_pos"), F.col("candidate_id").alias("_win_id")
        ),
        ["canon"],
        ["_win_pos"],
    )
    asked = asked.join(winners, "canon", "left")
    decision = (
        F.when(F.col("canon").isNull(), F.lit("unknown"))
        .when(F.col("_passes") & (F.col("pos") == F.col("_win_pos")), F.lit("promoted"))
        .when(
            (F.col("candidate_id") == F.col("_win_id")) & (F.col("pos") > F.col("_win_pos")),
            F.lit("repeated"),
        )
        .when(F.col("refs") == 0, F.lit("no_evidence"))
        .when(F.col("active") | (F.col("_win_pos") < F.col("pos")), F.lit("already_active"))
        .when(F.col("verdict") != "verified", F.lit("not_verified"))
        .otherwise(F.lit("claim_fails"))
    )
    return asked.select("pos", "candidate_id", "deprecated", "replacement", decision.alias("decision"))


def transition(
    decisions: DataFrame,
    candidates: DataFrame,
    registry: DataFrame,
    live: DataFrame,
    official: DataFrame,
    checked_at: str,
    sources: list[str],
) -> tuple[DataFrame, DataFrame]:
    """(next registry, next queue) once the promoted candidates have moved."""
    moved = decisions.where(F.col("decision") == "promoted").select("candidate_id", F.col("pos").alias("_pos"))
    rows = classify(candidates.join(moved, "candidate_id"), live, official)
    base = registry.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    official_ok = lifecycle.official_source_confirmed()
    promoted = (
        rows.withColumn("kind", F.lit("model_id"))
        .withColumn("ord", F.lit(base) + 1 + F.col("_pos"))
        .withColumn("entry_id", ids.entry_id(F.col("provider"), F.col("deprecated"), F.col("shutdown_date")))
        .withColumn("v_status", F.col("verdict"))
        .withColumn("v_official", official_ok)
        .withColumn("v_replacement", F.lit(True))
        .withColumn("v_auto", official_ok)
        .withColumn("quarantine_reason", F.lit(None).cast("string"))
        .withColumn("checked_at", F.lit(checked_at))
        .withColumn("sources", F.array(*[F.lit(s) for s in sources]).cast("array<string>"))
        .withColumn(
            "reasons",
            merge_reasons(
                F.col("verdict_reasons"),
                F.array(F.concat(F.lit("claim_only:"), F.col("deprecated"))),
            ),
        )
    )
    columns = [c for c in registry.columns if c in promoted.columns]
    next_registry = registry.unionByName(promoted.select(*columns), allowMissingColumns=True)
    next_queue = candidates.join(moved, "candidate_id", "left_anti")
    return next_registry, next_queue
