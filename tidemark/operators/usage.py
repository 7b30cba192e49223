"""Which parts of an API a repository touches, and which changes hit it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import access_prefixes, strip_root
from .joins import first_by, lookup_join


def accesses(chains: DataFrame) -> DataFrame:
    """One usage row per level of every access chain (``T.a``, ``T.a.b``, ...)."""
    rest = [c for c in chains.columns if c != "chain"]
    return chains.select(F.explode(access_prefixes(F.col("chain"))).alias("path_key"), *rest)


def locations(usage: DataFrame, root: str) -> DataFrame:
    """Distinct (repo, api, path, file, line, col) with the root prefix removed.

    Hardly a site is listed twice, so rows are dealt out before they are made distinct:
    a task would otherwise hold the sites of its whole input split. The partitions are
    stated, as adaptive execution would merge the short rows by their bytes.
    """
    keys = ["repo", "api", "path", "file", "line", "col"]
    sites = usage.select("repo", "api", strip_root(F.col("path_key"), root).alias("path"), "file", "line", "col")
    return sites.repartition(int(usage.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys).distinct()


def summary(usage: DataFrame) -> DataFrame:
    """Per repo: distinct paths and distinct sites (paths as written)."""
    sites = usage.select("repo", "path_key", "file", "line", "col").distinct()
    per_path = sites.groupBy("repo", "path_key").agg(F.count(F.lit(1)).alias("sites"))
    return per_path.groupBy("repo").agg(
        F.count(F.lit(1)).alias("paths"), F.sum("sites").alias("sites")
    )


def affected_sites(changes: DataFrame, usage: DataFrame, root: str) -> DataFrame:
    """Every distinct site of every change a repository uses; a path belongs to its API."""
    target = changes.select(
        strip_root(F.col("path"), root).alias("path"), "api", "kind", "from", "to"
    )
    return lookup_join(locations(usage, root), target, ["api", "path"], "inner")


def unused_changes(changes: DataFrame, usage: DataFrame, root: str) -> DataFrame:
    """Changes no repository uses."""
    keyed = changes.withColumn("_path", strip_root(F.col("path"), root))
    # Distinct first: each task passes on a path once, so a path that everybody uses is no hot key.
    used = usage.select("api", strip_root(F.col("path_key"), root).alias("_path")).distinct()
    return keyed.join(used, ["api", "_path"], "left_anti").drop("_path")


def impact(sites: DataFrame) -> DataFrame:
    """Per repo and kind: changes hit, sites, and whether they can be automated.

    Renames are candidates for an automatic fix; the other kinds are located
    only.
    """
    per_change = sites.groupBy("repo", "kind", "api", "path").agg(F.count(F.lit(1)).alias("_n"))
    out = per_change.groupBy("repo", "kind").agg(
        F.count(F.lit(1)).alias("changes"), F.sum("_n").alias("sites")
    )
    return out.withColumn("auto_fix", F.col("kind") == "field_rename")


def rename_targets(changes: DataFrame, usage: DataFrame, root: str) -> DataFrame:
    """Sites to rename: the path is the changed one and ends in the old name."""
    renames = changes.where(F.col("kind") == "field_rename")
    hits = affected_sites(renames, usage, root)
    last = F.element_at(F.split("path", r"\."), -1)
    return hits.where(last == F.col("from")).select("repo", "file", "line", "col", "path", "from", "to")


def first_usage(usage: DataFrame) -> DataFrame:
    """Earliest site per repo and path."""
    return first_by(
        usage.select("repo", "path_key", "file", "line", "col"), ["repo", "path_key"], ["file", "line", "col"]
    )
