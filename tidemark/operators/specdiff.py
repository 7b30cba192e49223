"""Breaking changes between two versions of an API specification.

The two versions of a schema meet in one shuffle. Everything below the schema
is then a matter of one row: the objects present on both sides are listed, and
each is compared by array and map functions, so renames need no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..sources.specs import (
    bounded,
    descend,
    enum_values,
    levels_below,
    normalized_type,
    read_node,
    read_properties,
)

_MAP = "map<string,string>"
_NODE = "struct<type:string,enum:string,properties:string>"
_PAIR = f"struct<path:string,a:{_NODE},b:{_NODE}>"


def enum_label(values: Column) -> Column:
    return F.concat(
        F.lit("["), F.array_join(F.coalesce(values, F.array().cast("array<string>")), ", "), F.lit("]")
    )


def enums_differ(a: Column, b: Column) -> Column:
    """Order does not count; an enum on one side only is a difference."""
    return ~F.array_sort(a).eqNullSafe(F.array_sort(b))


def paired_schemas(specs: DataFrame, old: str, new: str) -> DataFrame:
    """(api, path, a, b): schemas present in both versions, as JSON."""
    schemas = specs.where(F.col("version").isin(old, new)).select(
        "api",
        "version",
        F.explode(F.from_json(F.get_json_object("doc", "$.components.schemas"), _MAP)).alias("path", "node"),
    )
    side = lambda v: F.max(F.when(F.col("version") == v, F.col("node")))
    # A small text is long work below, so the partitions are stated: adaptive
    # execution would merge them by their bytes. The grouping reuses them.
    tasks = int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        schemas.repartition(tasks, "api", "path")
        .groupBy("api", "path")
        .agg(side(old).alias("a"), side(new).alias("b"))
        # Also drops schemas missing on one side. Equal JSON cannot differ.
        .where(F.col("a") != F.col("b"))
    )


def _children(pair: Column) -> Column:
    """Properties that are objects with properties on both sides, and not the same ones."""

    def kids(parsed: Column) -> Column:
        pa, pb = parsed["pa"], parsed["pb"]
        # Equal JSON cannot differ; most properties end here, unread.
        suspects = F.filter(
            F.array_intersect(F.map_keys(pa), F.map_keys(pb)),
            lambda k: F.element_at(pa, k) != F.element_at(pb, k),
        )
        return F.transform(
            suspects,
            lambda k: F.struct(
                F.concat(pair["path"], F.lit("."), k).alias("path"),
                read_node(F.element_at(pa, k)).alias("a"),
                read_node(F.element_at(pb, k)).alias("b"),
            ),
        )

    # The one-element array binds the parsed maps, so each JSON is read once.
    once = F.array(F.struct(read_properties(pair["a"]).alias("pa"), read_properties(pair["b"]).alias("pb")))
    return F.filter(
        F.flatten(F.transform(once, kids)), lambda n: n["a"]["properties"] != n["b"]["properties"]
    )


def compared_objects(schemas: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(api, path, a, b): every object to compare, schemas and all objects inside them.

    ``a`` and ``b`` are the nodes of the two versions. Objects are followed as
    deep as both versions have them, or ``max_depth`` levels, schemas included.
    """
    start = F.array(F.struct("path", read_node(F.col("a")).alias("a"), read_node(F.col("b")).alias("b")))
    levels = bounded(
        F.least(levels_below(F.col("a")), levels_below(F.col("b"))), None if max_depth is None else max_depth - 1
    )
    every = descend(start, _children, levels, _PAIR)
    return schemas.select("api", F.explode(every).alias("_o")).select("api", "_o.path", "_o.a", "_o.b")


def spec_diff(specs: DataFrame, old: str = "A", new: str = "B") -> DataFrame:
    """(api, kind, path, from, to): renames, removals, type and enum changes.

    A rename is inferred only when an object lost exactly one property and
    gained exactly one of equal type; otherwise each lost one is a removal.
    """
    objects = compared_objects(paired_schemas(specs, old, new))
    objects = objects.select(
        "api", "path", read_properties(F.col("a")).alias("pa"), read_properties(F.col("b")).alias("pb")
    )
    pa, pb = F.col("pa"), F.col("pb")
    objects = (
        objects.withColumn("lost", F.array_except(F.map_keys(pa), F.map_keys(pb)))
        .withColumn("gained", F.array_except(F.map_keys(pb), F.map_keys(pa)))
        .withColumn("both", F.array_intersect(F.map_keys(pa), F.map_keys(pb)))
    )
    lost, gained = F.col("lost"), F.col("gained")
    one = (F.size(lost) == 1) & (F.size(gained) == 1)
    same_type = normalized_type(read_node(F.element_at(pa, F.try_element_at(lost, F.lit(1))))) == normalized_type(
        read_node(F.element_at(pb, F.try_element_at(gained, F.lit(1))))
    )
    renamed = F.coalesce(one & same_type, F.lit(False))

    def change(kind: Column, name: Column, f: Column, t: Column) -> Column:
        return F.struct(
            kind.alias("kind"), name.alias("name"), f.cast("string").alias("from"), t.cast("string").alias("to")
        )

    nothing = F.lit(None).cast("string")
    gone = F.transform(
        lost,
        lambda k: F.when(
            renamed, change(F.lit("field_rename"), k, k, F.try_element_at(gained, F.lit(1)))
        ).otherwise(change(F.lit("field_removed"), k, nothing, nothing)),
    )

    def kept(k: Column) -> Column:
        read = F.struct(read_node(F.element_at(pa, k)).alias("a"), read_node(F.element_at(pb, k)).alias("b"))
        typed = lambda n: F.struct(
            normalized_type(n["a"]).alias("ta"),
            normalized_type(n["b"]).alias("tb"),
            enum_values(n["a"]).alias("ea"),
            enum_values(n["b"]).alias("eb"),
        )

        def differences(t: Column) -> Column:
            return F.array_compact(
                F.array(
                    F.when(
                        (t["ta"] != "") & (t["tb"] != "") & (t["ta"] != t["tb"]),
                        change(F.lit("type_change"), k, t["ta"], t["tb"]),
                    ),
                    F.when(
                        enums_differ(t["ea"], t["eb"]),
                        change(F.lit("enum_value_change"), k, enum_label(t["ea"]), enum_label(t["eb"])),
                    ),
                )
            )

        # One-element arrays again: read once, judged once.
        return F.flatten(F.transform(F.transform(F.array(read), typed), differences))

    # Equal JSON on both sides cannot differ; most properties end here.
    suspects = F.filter("both", lambda k: F.element_at(pa, k) != F.element_at(pb, k))
    found = F.concat(gone, F.flatten(F.transform(suspects, kept)))
    return objects.select("api", "path", F.explode(found).alias("_c")).select(
        "api",
        "_c.kind",
        F.concat("path", F.lit("."), "_c.name").alias("path"),
        "_c.from",
        "_c.to",
    )


def ordered(changes: DataFrame) -> DataFrame:
    """Report order: kind, then api, path."""
    rank = F.array_position(F.array(*[F.lit(k) for k in C.CHANGE_KINDS]), F.col("kind"))
    return changes.withColumn("kind_rank", rank).orderBy("kind_rank", "api", "path")


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("api", "kind").agg(F.count(F.lit(1)).alias("changes"))
