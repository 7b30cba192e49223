"""Live-model catalogs and the official recommendation table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..functions import ids


def aggregator_ids(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """Ids of an aggregator payload: an array of ``{id}``, or that array under ``data``."""
    schema = "array<struct<id:string>>"
    body = F.get_json_object(json, "$.data")
    models = F.coalesce(F.from_json(body, schema), F.from_json(F.col(json), schema))
    return payloads.select(F.explode(models).alias("m")).select(F.col("m.id").alias("id"))


def first_party(catalog: DataFrame, providers: tuple[str, ...] = C.FIRST_PARTY) -> DataFrame:
    """Rows whose namespace is a known provider, with the namespace removed.

    The namespace is the text before the first slash, compared as written.
    """
    bare = F.substring_index(F.regexp_replace(F.col("id"), "^~", ""), ":", 1)
    slash = F.instr(bare, "/")
    return (
        catalog.where(slash > 0)
        .where(F.substring_index(bare, "/", 1).isin(*providers))
        .select(F.substring(bare, slash + 1, F.length(bare)).alias("id"))
    )


def provider_map_ids(
    payloads: DataFrame, json: str = "payload", providers: tuple[str, ...] = C.FIRST_PARTY
) -> DataFrame:
    """Ids of a per-provider payload: ``{provider: {models: {id: ...}}}``."""
    schema = "map<string,struct<models:map<string,string>>>"
    return (
        payloads.select(F.explode(F.from_json(json, schema)).alias("provider", "entry"))
        .where(F.col("provider").isin(*providers))
        .select(F.explode(F.map_keys("entry.models")).alias("id"))
    )


def _forms(id_: Column) -> Column:
    return F.array_distinct(F.array(ids.canonical_id(id_), ids.family_id(id_)))


def live_forms(catalog: DataFrame) -> DataFrame:
    """Distinct canonical and family forms of every live id."""
    return (
        catalog.where(ids.canonical_id(F.col("id")) != "")
        .select(F.explode(_forms(F.col("id"))).alias("form"))
        .distinct()
    )


def official_table(mapping: DataFrame) -> DataFrame:
    """(deprecated, recommended) keyed by canonical id."""
    return mapping.select(
        ids.canonical_id(F.col("deprecated")).alias("dep_canon"), "recommended"
    )


def official_recommendations(spark: SparkSession) -> DataFrame:
    """The curated table shipped with the package."""
    rows = [
        (old, new) for table in C.OFFICIAL_RECOMMENDATIONS.values() for old, new in table.items()
    ]
    return official_table(spark.createDataFrame(rows, "deprecated string, recommended string"))
