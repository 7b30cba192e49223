"""Source trees as a table of whole files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import in_scan_scope, language


def read_sources(spark: SparkSession, root: str, repo_level: int = 0) -> DataFrame:
    """(repo, path, lang, text) of every file in scan scope below ``root``.

    The folder at ``repo_level`` below the root names the repository. Scope is
    decided on the path alone, before any text is decoded downstream.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true")
        .option("wholetext", "true")
        .format("text")
        .load(root)
        .select(F.col("_metadata.file_path").alias("_full"), F.col("value").alias("text"))
    )
    clean_root = root.rstrip("/")
    relative = F.substring_index(F.col("_full"), clean_root + "/", -1)
    parts = F.split(relative, "/")
    return (
        files.withColumn("repo", parts[repo_level])
        .withColumn(
            "path", F.array_join(F.slice(parts, F.lit(repo_level + 2), F.size(parts)), "/")
        )
        .withColumn("lang", language(F.col("path")))
        .where(in_scan_scope(F.col("path")))
        .select("repo", "path", "lang", "text")
    )
