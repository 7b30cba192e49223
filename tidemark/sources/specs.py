"""API specification documents and their flat property table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread

_MAP = "map<string,string>"
_NODE = "struct<type:string,enum:string,properties:string>"
_FOUND = (
    "struct<parent:string,path:string,name:string,depth:int,ord:bigint,"
    "node:struct<type:string,enum:string,properties:string>>"
)
_STRING = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"'


def read_specs(spark: SparkSession, path: str, api: str, version: str) -> DataFrame:
    """(api, version, doc) from specification files, one document per file."""
    return spark.read.text(path, wholetext=True).select(
        F.lit(api).alias("api"), F.lit(version).alias("version"), F.col("value").alias("doc")
    )


def read_node(json: Column) -> Column:
    """Type, enum and properties of a node, each as text; null for what is no object."""
    return F.from_json(json, _NODE)


def read_properties(node: Column) -> Column:
    """Name to JSON text of a node's properties; empty when it has none."""
    return F.coalesce(F.from_json(node["properties"], _MAP), F.create_map().cast(_MAP))


def normalized_type(node: Column) -> Column:
    """One name, a sorted ``a|b`` union, ``object`` for bare properties, or ``''``."""
    raw = node["type"]
    union = F.from_json(raw, "array<string>")
    return (
        F.when(raw.startswith("["), F.array_join(F.array_sort(union), "|"))
        .when(raw.isNotNull(), raw)
        .when(has_properties(node), F.lit("object"))
        .otherwise(F.lit(""))
    )


def enum_values(node: Column) -> Column:
    """Enum members as strings in source order; null when there is no enum array."""
    return F.when(node["enum"].startswith("["), F.from_json(node["enum"], "array<string>"))


def has_properties(node: Column) -> Column:
    return node["properties"].isNotNull()


def levels_below(json: Column) -> Column:
    """How many levels of properties a JSON text can have: half the depth of its braces.

    Braces inside strings don't count. One pass with two numbers as its state.
    """
    braces = F.split(F.regexp_replace(F.regexp_replace(json, _STRING, ""), "[^{}]+", ""), "")
    deepest = F.aggregate(
        braces,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")),
        lambda s, c: F.transform(
            F.array(s["at"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)),
            lambda at: F.struct(at.alias("at"), F.greatest(s["most"], at).alias("most")),
        )[0],
        lambda s: s["most"],
    )
    return F.coalesce((deepest / 2).cast("int"), F.lit(0))


def descend(start: Column, children, levels: Column, element: str) -> Column:
    """``start`` and everything below it: ``children`` of the last level, ``levels`` times.

    The levels are an array of arrays in the state of one fold, so a nested
    document stays one row however deep it is.
    """
    kind = f"array<array<{element}>>"
    return F.flatten(
        F.aggregate(
            F.array_repeat(F.lit(0), levels),
            F.array(start).cast(kind),
            lambda s, _: F.concat(s, F.array(F.flatten(F.transform(F.element_at(s, -1), children))).cast(kind)),
        )
    )


def bounded(levels: Column, max_depth: int | None) -> Column:
    return levels if max_depth is None else F.least(levels, F.lit(max(max_depth, 0)))


def _properties_of(found: Column) -> Column:
    return F.transform(
        F.map_entries(read_properties(found["node"])),
        lambda e, i: F.struct(
            found["path"].alias("parent"),
            F.concat_ws(".", found["path"], e["key"]).alias("path"),
            e["key"].alias("name"),
            (found["depth"] + 1).alias("depth"),
            i.cast("bigint").alias("ord"),
            read_node(e["value"]).alias("node"),
        ),
    )


def flatten_specs(specs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(api, version, parent, name, depth, ord, type, enum, is_object).

    ``parent`` is the dotted path of the enclosing object; schemas themselves
    are rows of depth -1 with an empty parent. Properties are followed as deep
    as they go, or ``max_depth`` levels.
    """
    schemas = F.from_json(F.get_json_object("doc", "$.components.schemas"), _MAP)
    rows = spread(specs).select("api", "version", F.posexplode(schemas).alias("ord", "name", "json"))
    start = F.array(
        F.struct(
            F.lit("").alias("parent"),
            F.col("name").alias("path"),
            "name",
            F.lit(-1).alias("depth"),
            F.col("ord").cast("bigint").alias("ord"),
            read_node(F.col("json")).alias("node"),
        )
    )
    every = descend(start, _properties_of, bounded(levels_below(F.col("json")), max_depth), _FOUND)
    out = rows.select("api", "version", F.explode(every).alias("_f")).select("api", "version", "_f.*")
    node = F.col("node")
    return out.select(
        "api",
        "version",
        "parent",
        "name",
        "depth",
        "ord",
        normalized_type(node).alias("type"),
        enum_values(node).alias("enum"),
        F.coalesce(has_properties(node), F.lit(False)).alias("is_object"),
    )
