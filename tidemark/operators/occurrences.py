"""Literal occurrences: position, registry match, tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import ids, lifecycle
from ..functions.paths import in_fact_scope
from .joins import lookup_join
from .registry import first_declared


def is_model_like(name: Column) -> Column:
    return F.coalesce(name.rlike(C.MODEL_NAME_PATTERN), F.lit(False))


def is_deployment(name: Column) -> Column:
    return F.coalesce(name.isin(*C.DEPLOYMENT_NAMES), F.lit(False))


def _data(purpose: str) -> Column:
    return F.struct(F.lit("data").alias("position"), F.lit(purpose).alias("purpose"))


def _at(position: str) -> Column:
    return F.struct(F.lit(position).alias("position"), F.lit(None).cast("string").alias("purpose"))


def _ts_rules() -> tuple[Column, Column, Column]:
    """What differs by language: names bound to a value, factories, names that must reach a sink."""
    bound = F.col("enclosure").isin("variable", "class_property")
    return bound, F.coalesce(F.col("callee").isin(*C.TS_FACTORIES), F.lit(False)), F.lit(False)


def _py_rules(sunk: Column) -> tuple[Column, Column, Column]:
    where = F.col("enclosure")
    bound = where.isin("kwarg", "variable", "param_default")
    factory = F.coalesce(F.col("callee").isin(*C.PY_FACTORIES), F.lit(False))
    return bound, factory, where.isin("variable", "param_default") & ~sunk


def _place() -> Column:
    """Position and purpose from the flags of ``_with_place``; the branches of different enclosures exclude each other."""
    where = F.col("enclosure")
    return (
        F.when(where == "property_key", _data("lookup_key"))
        .when((F.col("_bound") | (where == "property_value")) & F.col("_deployment"), _at("azure_deployment"))
        .when((where == "property_value") & F.col("_model") & F.col("_call"), _at("model_arg"))
        .when(where == "property_value", _data("catalog_entry"))
        .when(F.col("_bound") & F.col("_model") & F.col("_untraced"), _at("usage_unverified"))
        .when(F.col("_bound") & F.col("_model"), _at("model_arg"))
        .when((where == "call_arg") & F.col("_factory"), _at("model_arg"))
        .when(where == "array_element", _data("list_entry"))
        .when(where == "comparison", _data("comparison"))
        .otherwise(_data("generic"))
    )


def _with_place(facts: DataFrame, rules: tuple[Column, Column, Column], masking: Column) -> DataFrame:
    """Adds cast_masked, position, purpose; ``masking`` tells whether a cast would hide a model argument.

    The flags are columns of their own, so each is worked out once and the code
    that Spark generates for the rules stays small enough to be compiled.
    """
    name = F.col("encl_name")
    bound, factory, untraced = rules
    flagged = facts.withColumns(
        {
            "_bound": bound,
            "_factory": factory,
            "_untraced": untraced,
            "_deployment": is_deployment(name),
            "_model": is_model_like(name),
            "_call": F.coalesce(F.col("in_call"), F.lit(False)),
        }
    )
    masked = (F.col("_p.position") == "model_arg") & masking
    return (
        flagged.withColumn("_p", _place())
        .withColumn("cast_masked", masked)
        .withColumn("position", F.when(F.col("cast_masked"), F.lit("data")).otherwise(F.col("_p.position")))
        .withColumn("purpose", F.when(F.col("cast_masked"), F.lit("generic")).otherwise(F.col("_p.purpose")))
        .select(*facts.columns, "cast_masked", "position", "purpose")
    )


def _named_cast() -> Column:
    return F.coalesce((F.col("cast_type") != "") & ~F.col("cast_type").isin(*C.TRANSPARENT_CASTS), F.lit(False))


def place_ts(facts: DataFrame) -> DataFrame:
    """Adds position, purpose, cast_masked to TypeScript literals.

    A cast to a named type hides the repository's own list of ids, so a model
    argument behind one is demoted to data.
    """
    return _with_place(facts, _ts_rules(), _named_cast())


def _with_sinks(facts: DataFrame, sinks: DataFrame, concerned: Column) -> DataFrame:
    """Adds ``_sunk``: the name of an assignment or default reaches a sink in its file."""
    traced = F.coalesce(
        concerned & F.col("enclosure").isin("variable", "param_default") & is_model_like(F.col("encl_name")),
        F.lit(False),
    )
    names = sinks.select("repo", "path", F.col("name").alias("encl_name")).distinct().withColumn(
        "_sunk", F.lit(True)
    )
    # Only rows the rule concerns are shuffled for it.
    asked = facts.where(traced).join(names, ["repo", "path", "encl_name"], "left")
    return asked.unionByName(facts.where(~traced), allowMissingColumns=True).withColumn(
        "_sunk", F.coalesce(F.col("_sunk"), F.lit(False))
    )


def place_py(facts: DataFrame, sinks: DataFrame) -> DataFrame:
    """Adds position, purpose, cast_masked to Python literals.

    A model-like assignment or default is live only when its name reaches a
    sink in the same file; scope and order are deliberately not looked at.
    """
    joined = _with_sinks(facts, sinks, F.lit(True))
    placed = _with_place(joined, _py_rules(F.col("_sunk")), F.lit(False))
    return placed.select(*facts.columns, "cast_masked", "position", "purpose")


def place(facts: DataFrame, sinks: DataFrame) -> DataFrame:
    """``place_ts`` and ``place_py`` of the literals of both languages, in one projection."""
    ts = F.col("lang") == "ts"
    joined = _with_sinks(facts.where(F.col("lang").isin("ts", "py")), sinks, ~ts)
    rules = [F.when(ts, a).otherwise(b) for a, b in zip(_ts_rules(), _py_rules(F.col("_sunk")), strict=True)]
    placed = _with_place(joined, tuple(rules), ts & _named_cast())
    return placed.select(*facts.columns, "cast_masked", "position", "purpose")


def match_registry(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """Literals whose whole value is a registry id, with the record's columns.

    The first record of an id answers; a value is never matched in part.
    """
    records = first_declared(registry).select(
        F.col("deprecated").alias("value"),
        F.col("ord").alias("record_ord"),
        "provider",
        "replacement",
        F.col("status").alias("lifecycle"),
        "shutdown_date",
        ids.display_id(
            F.col("entry_id"),
            ids.entry_id(F.col("provider"), F.col("deprecated"), F.col("shutdown_date")),
        ).alias("entry_id"),
        lifecycle.auto_apply_ok().alias("auto_apply"),
        lifecycle.effective_state().alias("state"),
        "v_status",
        "v_official",
        "v_replacement",
        "checked_at",
    )
    return lookup_join(facts, records, ["value"], "inner")


def with_tier(placed: DataFrame) -> DataFrame:
    """Adds tier and reason to placed, registry-matched occurrences."""
    position = F.col("position")
    reason = (
        F.when((position == "model_arg") & ~F.col("auto_apply"), F.lit("replacement_unverified"))
        .when(position == "azure_deployment", F.lit("platform_blocked"))
        .when(position == "usage_unverified", F.lit("usage_unverified"))
        .when((position == "data") & F.col("cast_masked"), F.lit("type_cast_masked"))
    )
    tier = (
        F.when((position == "model_arg") & F.col("auto_apply"), F.lit("A"))
        .when(reason.isNotNull(), F.lit("B"))
        .otherwise(F.lit("C"))
    )
    # A finding held back for its replacement never shows a verified verdict.
    verdict = F.when(
        (reason == "replacement_unverified") & (F.col("state") == "verified"), F.lit("unverified")
    ).otherwise(F.col("state"))
    return placed.withColumn("tier", tier).withColumn("reason", reason).withColumn("verdict", verdict)


def occurrences(facts: DataFrame, sinks: DataFrame, registry: DataFrame) -> DataFrame:
    """Tiered occurrences of both languages: one lookup of all facts.

    Positions are settled below the lookup, so that the filters on tiers above it
    compare columns and don't work the rules out again, and only the outcome is
    shuffled. Few literals are registry ids, so the path rules are tested on what
    the lookup leaves. They name a column of the record for that reason: the
    optimizer would otherwise move them below the join.
    """
    matched = match_registry(place(facts, sinks), registry)
    in_scope = in_fact_scope(F.col("path"), F.col("lang"))
    return with_tier(matched.where(F.when(F.col("record_ord").isNotNull(), in_scope)))


def view(occ: DataFrame) -> DataFrame:
    """Adds ``view``: the one report section an occurrence belongs to."""
    position = F.col("position")
    return occ.withColumn(
        "view",
        F.when((position == "model_arg") & F.col("auto_apply"), F.lit("swap"))
        .when(position == "model_arg", F.lit("blocked"))
        .when(position == "azure_deployment", F.lit("alias"))
        .when(position == "usage_unverified", F.lit("usage_unverified"))
        .otherwise(F.lit("data")),
    )


def swaps(occ: DataFrame) -> DataFrame:
    """Occurrences an automatic edit may touch."""
    return occ.where(
        (F.col("position") == "model_arg") & F.col("auto_apply") & (F.col("value") != F.col("replacement"))
    )
