"""Registry records: shape rules, consistency rules, state, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import ids, lifecycle
from ..session import spread
from .joins import first_by, lookup_join


def model_entries(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("kind") == "model_id")


def param_entries(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("kind").isin("param_rename", "param_removal"))


def first_declared(registry: DataFrame) -> DataFrame:
    """One record per identifier: the earliest in source order."""
    return first_by(model_entries(registry), ["deprecated"], ["ord"])


# --- shape rules -------------------------------------------------------------


def _type(variant: Column, path: str) -> Column:
    """JSON type name at a path; SQL null when the path is absent."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def _text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")


def _bad_string(variant: Column, path: str) -> Column:
    """Not a non-empty string."""
    kind = F.coalesce(_type(variant, path), F.lit("VOID"))
    return (kind != "STRING") | (_text(variant, path) == "")


def _present(variant: Column, path: str) -> Column:
    return _type(variant, path).isNotNull()


def _given(variant: Column, path: str) -> Column:
    """Present and not JSON null."""
    return F.coalesce(_type(variant, path) != "VOID", F.lit(False))


def _not_in(variant: Column, path: str, allowed: tuple[str, ...]) -> Column:
    kind = F.coalesce(_type(variant, path), F.lit("VOID"))
    return (kind != "STRING") | ~F.coalesce(_text(variant, path).isin(*allowed), F.lit(False))


def _bad_string_array(variant: Column, path: str) -> Column:
    """Present but not an array of strings."""
    kind = _type(variant, path)
    items = F.try_variant_get(variant, path, "array<variant>")
    wrong = F.exists(items, lambda v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")) != "STRING")
    return _present(variant, path) & (~kind.startswith("ARRAY") | F.coalesce(wrong, F.lit(False)))


def _record_rules(v: Column) -> list[tuple[str, Column]]:
    kind = _text(v, "$.kind")
    is_model = F.coalesce(kind == "model_id", F.lit(False))
    is_param = F.coalesce(kind.isin("param_rename", "param_removal"), F.lit(False))
    block = F.coalesce(_type(v, "$.verification").startswith("OBJECT"), F.lit(False))
    status = _text(v, "$.verification.status")
    quarantine = _text(v, "$.verification.quarantineReason")
    evidence_kind = F.coalesce(_type(v, "$.evidence"), F.lit(""))
    evidence = F.try_variant_get(v, "$.evidence", "array<variant>")
    has_evidence = evidence_kind.startswith("ARRAY")

    def any_ref(test) -> Column:
        return is_model & has_evidence & F.coalesce(F.exists(evidence, test), F.lit(False))

    def optional_text(path: str) -> Column:
        return _given(v, path) & (_type(v, path) != "STRING")

    rules = [
        ("invalid_provider", _bad_string(v, "$.provider")),
        ("invalid_kind", _not_in(v, "$.kind", C.RECORD_KINDS)),
        ("invalid_note", _present(v, "$.note") & (_type(v, "$.note") != "STRING")),
        ("invalid_status", is_model & _present(v, "$.status") & _not_in(v, "$.status", C.LIFECYCLES)),
        ("invalid_shutdown_date", is_model & optional_text("$.shutdownDate")),
        ("invalid_source_url", is_model & optional_text("$.sourceUrl")),
        ("invalid_entry_id", is_model & _given(v, "$.entryId") & _bad_string(v, "$.entryId")),
        ("invalid_deprecated", is_model & _bad_string(v, "$.deprecated")),
        ("invalid_replacement", is_model & _bad_string(v, "$.replacement")),
        ("invalid_verification", is_model & _present(v, "$.verification") & ~block),
        (
            "invalid_verification_status",
            is_model & block & _not_in(v, "$.verification.status", C.VERIFICATION_STATUSES),
        ),
        ("invalid_quarantine_reason", is_model & block & optional_text("$.verification.quarantineReason")),
        (
            "quarantine_without_reason",
            is_model & block & (status == "quarantined") & ~lifecycle.has_text(quarantine),
        ),
    ]
    for name in C.SWITCHES:
        path = f"$.verification.{name}"
        rules.append(
            (f"invalid_switch_{name}", is_model & block & _present(v, path) & (_type(v, path) != "BOOLEAN"))
        )
    rules += [
        (
            "invalid_checked_at",
            is_model
            & block
            & _present(v, "$.verification.checkedAt")
            & (_type(v, "$.verification.checkedAt") != "STRING"),
        ),
        ("invalid_sources", is_model & block & _bad_string_array(v, "$.verification.sources")),
        ("invalid_reasons", is_model & block & _bad_string_array(v, "$.verification.reasons")),
        ("invalid_evidence", is_model & _present(v, "$.evidence") & ~has_evidence),
        ("empty_evidence", is_model & has_evidence & (F.size(evidence) == 0)),
        (
            "invalid_evidence_field",
            any_ref(
                lambda r: _bad_string(r, "$.sourceUrl")
                | _bad_string(r, "$.contentHash")
                | _bad_string(r, "$.retrievedAt")
            ),
        ),
        (
            "malformed_content_hash",
            any_ref(
                lambda r: ~_bad_string(r, "$.contentHash")
                & ~_text(r, "$.contentHash").rlike(C.CONTENT_HASH_PATTERN)
            ),
        ),
        (
            "invalid_excerpt",
            any_ref(lambda r: _present(r, "$.excerpt") & (_type(r, "$.excerpt") != "STRING")),
        ),
        (
            "excerpt_too_long",
            any_ref(lambda r: F.coalesce(F.length(_text(r, "$.excerpt")) > C.EXCERPT_MAX_CHARS, F.lit(False))),
        ),
        ("invalid_param", is_param & _bad_string(v, "$.param")),
        (
            "invalid_on_models",
            is_param
            & (
                ~F.coalesce(_type(v, "$.on_models").startswith("ARRAY"), F.lit(False))
                | F.coalesce(F.size(F.try_variant_get(v, "$.on_models", "array<variant>")) == 0, F.lit(False))
                | _bad_string_array(v, "$.on_models")
                | F.coalesce(
                    F.exists(F.try_variant_get(v, "$.on_models", "array<string>"), lambda s: s == ""),
                    F.lit(False),
                )
            ),
        ),
        ("invalid_param_replacement", F.coalesce(kind == "param_rename", F.lit(False)) & _bad_string(v, "$.replacement")),
    ]
    return rules


def _candidate_rules(v: Column) -> list[tuple[str, Column]]:
    return [
        ("candidate_not_model_id", F.coalesce(_text(v, "$.kind") != "model_id", F.lit(True))),
        ("invalid_candidate_id", _bad_string(v, "$.candidateId")),
        ("invalid_proposer", _not_in(v, "$.proposedBy", C.PROPOSERS)),
        ("invalid_proposed_at", _bad_string(v, "$.proposedAt")),
    ]


def _broken(variant: Column, rules: list[tuple[str, Column]]) -> Column:
    is_object = F.coalesce(F.schema_of_variant(variant).startswith("OBJECT"), F.lit(False))
    broken = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    return F.when(is_object, broken).otherwise(F.array(F.lit("not_an_object")))


def check_records(raw: DataFrame, json: str = "record") -> DataFrame:
    """Adds ``problems``: every broken shape rule, in rule order."""
    parsed = spread(raw).withColumn("_v", F.try_parse_json(F.col(json)))
    judged = F.struct(_broken(F.col("_v"), _record_rules(F.col("_v"))).alias("problems"))
    # As the output of a generator: a filter on it stays above, and the rules run once and after the spread.
    return parsed.select(*[F.col(f"`{c}`") for c in raw.columns if c != "problems"], F.inline(F.array(judged)))


def check_candidates(raw: DataFrame, json: str = "record") -> DataFrame:
    """Record rules, candidate rules, and unique candidate ids."""
    parsed = spread(raw).withColumn("_v", F.try_parse_json(F.col(json)))
    rules = _record_rules(F.col("_v")) + _candidate_rules(F.col("_v"))
    parsed = parsed.withColumn("problems", _broken(F.col("_v"), rules)).withColumn(
        "candidate_id", _text(F.col("_v"), "$.candidateId")
    )
    repeated = (
        parsed.where(F.col("candidate_id").isNotNull())
        .groupBy("candidate_id")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    joined = lookup_join(parsed, repeated, ["candidate_id"], "left")
    return joined.withColumn(
        "problems",
        F.when(
            F.col("_n") > 1, F.array_append(F.col("problems"), F.lit("duplicate_candidate_id"))
        ).otherwise(F.col("problems")),
    ).drop("_v", "_n")


def split_valid(checked: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid, rejects); ``strict`` fails the job on the first reject."""
    bad = F.size("problems") > 0
    if strict:
        checked = checked.withColumn(
            "problems",
            F.when(
                bad, F.raise_error(F.concat(F.lit("bad record: "), F.array_join("problems", ",")))
            ).otherwise(F.col("problems")),
        )
    return checked.where(~bad).drop("problems"), checked.where(bad)


# --- consistency rules -------------------------------------------------------


def with_ids(registry: DataFrame) -> DataFrame:
    derived = ids.entry_id(F.col("provider"), F.col("deprecated"), F.col("shutdown_date"))
    return registry.withColumn("derived_id", derived).withColumn(
        "display_id", ids.display_id(F.col("entry_id"), F.col("derived_id"))
    )


def violations(registry: DataFrame) -> DataFrame:
    """Every broken consistency rule: (ord, display_id, code)."""
    records = with_ids(model_entries(registry))
    off = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    status = F.coalesce(F.col("v_status"), F.lit(""))
    auto = F.coalesce(F.col("v_auto"), F.lit(False))
    rules = [
        ("verified_without_official_source", (status == "verified") & off("v_official")),
        ("verified_without_replacement_confirmation", (status == "verified") & off("v_replacement")),
        ("verified_without_auto_apply", (status == "verified") & ~auto),
        ("auto_apply_without_verified_status", (status != "verified") & auto),
        (
            "quarantined_without_reason",
            (status == "quarantined") & ~lifecycle.has_text(F.col("quarantine_reason")),
        ),
        ("missing_replacement", ~lifecycle.has_text(F.col("replacement"))),
        (
            "missing_lifecycle",
            ~lifecycle.non_empty(F.col("status")) & ~lifecycle.non_empty(F.col("shutdown_date")),
        ),
        ("caveat_over_auto_apply", auto & (F.size(lifecycle.caveat_markers(F.col("reasons"))) > 0)),
        ("missing_entry_id", ~lifecycle.non_empty(F.col("entry_id"))),
        (
            "entry_id_mismatch",
            lifecycle.non_empty(F.col("entry_id")) & (F.col("entry_id") != F.col("derived_id")),
        ),
    ]
    codes = F.array_compact(F.array(*[F.when(test, F.lit(code)) for code, test in rules]))
    per_row = records.select("ord", "display_id", F.explode(codes).alias("code"))
    shared = (
        records.groupBy("display_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    )
    claimed_twice = lookup_join(
        records.select("ord", "display_id"), shared, ["display_id"], "left_semi"
    ).withColumn("code", F.lit("duplicate_entry_id"))
    return per_row.unionByName(claimed_twice)


def violation_tally(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("violations"))


# --- state and provenance ----------------------------------------------------


def state(registry: DataFrame) -> DataFrame:
    """Gate, effective state and switched-off names per record."""
    return model_entries(registry).select(
        "ord",
        "deprecated",
        lifecycle.auto_apply_ok().alias("auto_apply"),
        lifecycle.effective_state().alias("state"),
        lifecycle.withheld_switches().alias("withheld"),
    )


def provenance(registry: DataFrame, as_of: str) -> DataFrame:
    """One row: totals, review-only counts per state, stamp range, staleness."""
    eligible = lifecycle.auto_apply_ok()
    st = lifecycle.effective_state()
    stamp = F.nullif(F.col("checked_at"), F.lit(""))
    out = model_entries(registry).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(eligible).alias("eligible"),
        *[F.count_if(~eligible & (st == s)).alias(s) for s in C.REVIEW_STATES],
        F.min(stamp).alias("oldest"),
        F.max(stamp).alias("newest"),
        F.count_if(stamp.isNull()).alias("undated"),
    )
    newest = F.try_to_timestamp(F.col("newest"))
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(C.REGISTRY_STALE_DAYS))
    return out.withColumn("stale", F.coalesce(newest < limit, F.lit(False)))


def find_records(registry: DataFrame, terms: DataFrame) -> DataFrame:
    """Best record per ``term``: stamped id, derived id, exact id, canonical id."""
    records = with_ids(model_entries(registry)).select(
        "ord",
        "deprecated",
        "display_id",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("form"), F.col("entry_id").alias("key")),
                F.struct(F.lit(2).alias("form"), F.col("derived_id").alias("key")),
                F.struct(F.lit(3).alias("form"), F.col("deprecated").alias("key")),
                F.struct(F.lit(4).alias("form"), ids.canonical_id(F.col("deprecated")).alias("key")),
            )
        ).alias("f"),
    )
    # One record per (form, key): the first in source order answers.
    index = first_by(
        records.select("f.form", "f.key", "ord", "deprecated", "display_id").where("key is not null"),
        ["form", "key"],
        ["ord"],
    )
    probes = terms.select(
        "term",
        F.explode(
            F.array(
                *[F.struct(F.lit(n).alias("form"), F.col("term").alias("key")) for n in (1, 2, 3)],
                F.struct(F.lit(4).alias("form"), ids.canonical_id(F.col("term")).alias("key")),
            )
        ).alias("f"),
    ).select("term", "f.form", "f.key")
    # The index grows with the registry, by four rows a record that no estimate of a file's size knows of:
    # it is never collected for a broadcast.
    hits = lookup_join(probes, index.hint("merge"), ["form", "key"], "inner")
    return first_by(hits, ["term"], ["form", "ord"]).select(
        "term", F.col("form").alias("matched_form"), "ord", "deprecated", "display_id"
    )
