"""Request parameters that are wrong on certain models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import dash_prefixes
from .joins import first_by, lookup_join
from .registry import param_entries

OBJECT = ["repo", "path", "obj_id"]
_FIELDS = [
    "key_kind", "value_literal", "value_ident", "value_start",
    "line", "col", "key_start", "key_end", "key_quote", "prop_start", "prop_end",
]


def family_match(models: DataFrame, families: DataFrame, model: str, family: str, how: str = "inner") -> DataFrame:
    """Rows whose ``model`` equals ``family`` or continues it after a dash.

    Written as an equality: a model is looked up by each of its dash prefixes,
    so ``m-1`` covers ``m-1-mini`` and never ``m-10``. One row per matching
    family row; a left-hand row appears once for each.
    """
    probe = models.withColumn("_prefix", F.explode(dash_prefixes(F.col(model))))
    keyed = families.withColumnRenamed(family, "_prefix")
    return lookup_join(probe, keyed, ["_prefix"], how).withColumnRenamed("_prefix", family)


def object_options(objects: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per options object: its model property and its listed parameters.

    The first property of a name counts. An object keeps at most one row per
    parameter name of the registry, so the group is small however often a
    source repeats a key.
    """
    names = entries.select(F.col("param").alias("key")).distinct()
    model = objects.where(F.col("key") == "model")
    listed = lookup_join(objects.where(F.col("key") != "model"), names, ["key"], "left_semi")
    keys = first_by(
        model.select(*OBJECT, "key", *_FIELDS).unionByName(listed.select(*OBJECT, "key", *_FIELDS)),
        [*OBJECT, "key"],
        ["key_start"],
    )
    fields = F.struct("key", *_FIELDS)
    return keys.groupBy(*OBJECT).agg(
        F.max(F.when(F.col("key") == "model", fields)).alias("model_prop"),
        F.collect_list(
            F.when((F.col("key") != "model") & (F.col("key_kind") == "property"), fields)
        ).alias("params"),
    )


def resolve_models(options: DataFrame, constants: DataFrame) -> DataFrame:
    """Adds ``model`` and ``model_start``: an inline literal, else a constant of the file.

    Objects whose model cannot be read are dropped; it is never guessed.
    """
    usable = options.where(
        F.col("model_prop").isNotNull()
        & F.col("model_prop.key_kind").isin("property", "shorthand")
        & (F.size("params") > 0)
    )
    bound = first_by(
        constants.select("repo", "path", "ident", "literal", F.col("literal_start").alias("_const_start")),
        ["repo", "path", "ident"],
        ["_const_start"],
    )
    name = F.when(F.col("model_prop.key_kind") == "shorthand", F.lit("model")).otherwise(
        F.col("model_prop.value_ident")
    )
    inline = F.col("model_prop.value_literal")
    probe = usable.withColumn("ident", F.when(inline.isNull(), name))
    named = probe.where(F.col("ident").isNotNull()).join(bound, ["repo", "path", "ident"], "left")
    # Objects with an inline model have nothing to look up and are not shuffled for it.
    joined = named.unionByName(probe.where(F.col("ident").isNull()), allowMissingColumns=True)
    return (
        joined.withColumn("model", F.coalesce(inline, F.col("literal")))
        .withColumn(
            "model_start",
            F.when(inline.isNotNull(), F.col("model_prop.value_start")).otherwise(F.col("_const_start")),
        )
        .where(F.col("model").isNotNull())
        .drop("ident", "literal", "_const_start")
    )


def param_sites(
    objects: DataFrame,
    constants: DataFrame,
    registry: DataFrame,
    swapped: DataFrame | None = None,
    first_only: bool = False,
) -> DataFrame:
    """Every (object, registry entry) where the parameter is wrong on the model.

    ``swapped`` holds the (repo, path, start, replacement) of identifier edits
    of the same run: the coupling is then judged on the model after the edit.
    ``first_only`` keeps the first entry in source order per object and parameter,
    which is the one an edit follows. Later entries on the same parameter and
    family are then left out before they meet the objects, so a site is not
    multiplied by the entries of a registry that names a family often.
    """
    entries = param_entries(registry).select(
        F.col("ord").alias("entry_ord"), "kind", "param", F.col("replacement").alias("new_name"), "on_models"
    )
    resolved = resolve_models(object_options(objects, entries), constants)
    if swapped is not None:
        edits = swapped.select(
            "repo", "path", F.col("start").alias("model_start"), F.col("replacement").alias("_new")
        ).distinct()
        resolved = (
            resolved.join(edits, ["repo", "path", "model_start"], "left")
            .withColumn("model", F.coalesce(F.col("_new"), F.col("model")))
            .drop("_new")
        )
    sites = resolved.select(*OBJECT, "model", F.explode("params").alias("_p")).select(
        *OBJECT,
        "model",
        F.col("_p.key").alias("param"),
        *[F.col(f"_p.{c}").alias(c) for c in ("line", "col", "key_start", "key_end", "key_quote", "prop_start", "prop_end")],
    )
    families = entries.select(
        "entry_ord", "kind", "param", "new_name", F.explode("on_models").alias("_prefix")
    ).distinct()
    order = ["entry_ord", "kind", "new_name"]
    if first_only:
        families = first_by(families, ["param", "_prefix"], order)
    probe = sites.withColumn("_prefix", F.explode(dash_prefixes(F.col("model"))))
    hits = lookup_join(probe, families, ["param", "_prefix"], "inner").drop("_prefix")
    if first_only:
        # A model has several families; the first entry of any of them counts.
        return first_by(hits, [*OBJECT, "param"], order)
    # Two families of one entry may both cover a model.
    return hits.dropDuplicates([*OBJECT, "param", "entry_ord"])
