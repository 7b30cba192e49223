"""Gate policy per repository, blocking outcomes, and what they downgrade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import trim_ws
from .joins import lookup_join


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(_type(v, path).startswith(kind), F.lit(False))


def _config_problem(v: Column, raw: Column) -> Column:
    """First broken rule of a repository's config; null when it is sound."""
    text = lambda p: trim_ws(F.try_variant_get(v, p, "string"))
    given = lambda p: _type(v, p).isNotNull()
    blank = lambda p: ~_is(v, p, "STRING") | (text(p) == "")
    timeout = F.try_variant_get(v, "$.evalTimeoutMs", "double")
    number = F.coalesce(
        _type(v, "$.evalTimeoutMs").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"), F.lit(False)
    )
    gates = F.try_variant_get(v, "$.gates", "map<string,variant>")
    case = (
        F.when(v.isNull(), F.lit("unparsable"))
        .when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), F.lit("not_an_object"))
        .when(given("$.evalCommand") & blank("$.evalCommand"), F.lit("bad_eval_command"))
        .when(given("$.evalTimeoutMs") & (~number | ~(timeout > 0)), F.lit("bad_eval_timeout"))
        .when(given("$.gates") & ~_is(v, "$.gates", "OBJECT"), F.lit("bad_gates"))
        .when(F.exists(F.map_keys(gates), lambda k: ~k.isin(*C.GATES)), F.lit("unknown_gate"))
    )
    for gate in C.GATES:
        base = f"$.gates.{gate}"
        fields = F.map_keys(F.try_variant_get(v, base, "map<string,variant>"))
        case = case.when(given(base) & ~_is(v, base, "OBJECT"), F.lit("bad_gate"))
        case = case.when(
            given(f"{base}.required") & ~_is(v, f"{base}.required", "BOOLEAN"), F.lit("bad_required")
        )
        if gate == "eval":
            case = case.when(given(f"{base}.command") & blank(f"{base}.command"), F.lit("bad_command"))
        else:
            case = case.when(given(f"{base}.command"), F.lit("command_not_supported"))
        case = case.when(
            F.exists(fields, lambda k: ~k.isin("required", "command")), F.lit("unknown_field")
        )
    return case.when(
        given("$.evalCommand")
        & given("$.gates.eval.command")
        & (text("$.evalCommand") != text("$.gates.eval.command")),
        F.lit("commands_disagree"),
    )


def policies(configs: DataFrame, override_command: str | None = None) -> DataFrame:
    """(repo, problem, eval_command, req_typecheck, req_tests, req_eval).

    A repository without a config has the defaults. The command comes from the
    caller, else the gate's own setting, else the older top-level setting; the
    eval gate is required only when there is a command.
    """
    v = F.col("_v")
    df = configs.withColumn("_v", F.try_parse_json(F.coalesce(F.col("config"), F.lit("{}"))))
    blank_to_null = lambda c: F.nullif(trim_ws(c), F.lit(""))
    command = F.coalesce(
        blank_to_null(F.lit(override_command).cast("string")),
        blank_to_null(F.try_variant_get(v, "$.gates.eval.command", "string")),
        blank_to_null(F.try_variant_get(v, "$.evalCommand", "string")),
    )
    # Only a JSON boolean is a setting; "no" would otherwise cast to false.
    required = lambda g: F.when(
        _is(v, f"$.gates.{g}.required", "BOOLEAN"),
        F.try_variant_get(v, f"$.gates.{g}.required", "boolean"),
    )
    return df.select(
        "repo",
        _config_problem(v, F.col("config")).alias("problem"),
        command.alias("eval_command"),
        F.coalesce(required("typecheck"), F.lit(C.GATE_REQUIRED["typecheck"])).alias("req_typecheck"),
        F.coalesce(required("tests"), F.lit(C.GATE_REQUIRED["tests"])).alias("req_tests"),
        F.coalesce(
            required("eval"),
            F.when(command.isNotNull(), F.lit(C.GATE_REQUIRED["eval"])).otherwise(F.lit(False)),
        ).alias("req_eval"),
    )


def with_required(outcomes: DataFrame, policy: DataFrame) -> DataFrame:
    """Adds ``required`` per outcome; repos without a policy get the defaults."""
    flags = policy.select("repo", "req_typecheck", "req_tests", "req_eval")
    joined = lookup_join(outcomes, flags, ["repo"], "left")
    gate = F.col("gate")
    return joined.withColumn(
        "required",
        F.when(gate == "typecheck", F.coalesce("req_typecheck", F.lit(C.GATE_REQUIRED["typecheck"])))
        .when(gate == "tests", F.coalesce("req_tests", F.lit(C.GATE_REQUIRED["tests"])))
        .otherwise(F.coalesce("req_eval", F.lit(False))),
    ).drop("req_typecheck", "req_tests", "req_eval")


def is_block() -> Column:
    """A failure always blocks; a gate that gave no answer only when required."""
    outcome = F.col("outcome")
    return (outcome == "fail") | (outcome.isin("inconclusive", "not-configured") & F.col("required"))


def blocks(outcomes: DataFrame, policy: DataFrame) -> DataFrame:
    return with_required(outcomes, policy).where(is_block())


def first_block(outcomes: DataFrame, policy: DataFrame) -> DataFrame:
    """Per repo and language: number of blocks and the first of them."""
    found = blocks(outcomes, policy)
    return found.groupBy("repo", "lang").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.min_by(F.struct("gate", "outcome"), F.col("seq")).alias("_f"),
    ).select("repo", "lang", "blocks", F.col("_f.gate").alias("gate"), F.col("_f.outcome").alias("outcome"))


def gate_tiers(outcomes: DataFrame, policy: DataFrame) -> DataFrame:
    """Per repo and language: do the gates let tier A stand.

    Code gates count per language. The eval gate covers the repository: without
    a command it is not configured, and when any code gate blocked it was never
    started; both hold the repository back only where eval is required.
    """
    flagged = with_required(outcomes, policy).withColumn("_block", is_block())
    eval_ = F.col("gate") == "eval"
    per_lang = flagged.groupBy("repo", "lang").agg(
        F.coalesce(F.bool_or(F.col("_block") & ~eval_), F.lit(False)).alias("code_blocked"),
        F.coalesce(F.bool_or(F.col("_block") & eval_), F.lit(False)).alias("_recorded"),
    )
    per_repo = per_lang.groupBy("repo").agg(
        F.bool_or("_recorded").alias("_recorded"), F.bool_or("code_blocked").alias("_any_code")
    )
    per_repo = lookup_join(per_repo, policy.select("repo", "eval_command", "req_eval"), ["repo"], "left")
    per_repo = per_repo.select(
        "repo",
        F.when(
            F.col("eval_command").isNull() | F.col("_any_code"), F.coalesce("req_eval", F.lit(False))
        )
        .otherwise(F.col("_recorded"))
        .alias("eval_blocked"),
    )
    out = per_lang.drop("_recorded").join(per_repo, "repo")
    return out.select(
        "repo",
        "lang",
        "code_blocked",
        "eval_blocked",
        (F.col("code_blocked") | F.col("eval_blocked")).alias("downgraded"),
    )


def downgrade(occ: DataFrame, tiers: DataFrame) -> DataFrame:
    """Adds ``applied_tier``: tier A findings of a downgraded language are held."""
    held = tiers.where("downgraded").select("repo", "lang").distinct().withColumn("_held", F.lit(True))
    return lookup_join(occ, held, ["repo", "lang"], "left").withColumn(
        "applied_tier",
        F.when((F.col("tier") == "A") & F.col("_held"), F.lit("A-held")).otherwise(F.col("tier")),
    ).drop("_held")


def new_diagnostics(diagnostics: DataFrame) -> DataFrame:
    """Diagnostics the patch adds: a multiset difference with multiplicities.

    Signed counts combine before the shuffle, so a message that fills a third
    of the table is one row per task by the time it moves.
    """
    signed = F.sum(F.when(F.col("side") == "patched", 1).otherwise(-1)).alias("added")
    return diagnostics.groupBy("repo", "path", "code", "message").agg(signed).where("added > 0")


def diagnostics_verdict(diagnostics: DataFrame) -> DataFrame:
    """Per repo: passed, number of new diagnostics, size of the baseline."""
    per_key = diagnostics.groupBy("repo", "path", "code", "message").agg(
        F.count_if(F.col("side") == "patched").alias("_p"),
        F.count_if(F.col("side") == "baseline").alias("_b"),
    )
    return per_key.groupBy("repo").agg(
        F.sum(F.greatest(F.col("_p") - F.col("_b"), F.lit(0))).alias("new_diagnostics"),
        F.sum("_b").alias("baseline"),
    ).withColumn("passed", F.col("new_diagnostics") == 0)
