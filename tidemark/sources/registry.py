"""Registry and candidate queue as JSON, and their versioned snapshots."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import registry as R

REF = "struct<sourceUrl:string,contentHash:string,retrievedAt:string,excerpt:string>"
BLOCK = (
    "struct<status:string,officialSourceConfirmed:boolean,replacementConfirmed:boolean,"
    "autoApplyAllowed:boolean,quarantineReason:string,checkedAt:string,"
    "sources:array<string>,reasons:array<string>>"
)
RECORD = (
    "struct<entryId:string,provider:string,kind:string,deprecated:string,replacement:string,"
    "status:string,shutdownDate:string,sourceUrl:string,note:string,"
    f"verification:{BLOCK},evidence:array<{REF}>,param:string,on_models:array<string>,"
    "candidateId:string,proposedBy:string,proposedAt:string>"
)


FILE_SHIFT = 33  # bits of ``ord`` below the number of the file


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """(source, ord, record): one row per element of each JSON array file.

    ``ord`` decides "first entry wins": files in order of their names, then the
    position in the array. It is the position itself for a single file. Only the
    names of the files meet in one task to be numbered.
    """
    files = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source"), "value"
    )
    numbers = files.select("source").distinct().select(
        "source", (F.row_number().over(Window.orderBy("source")) - 1).cast("bigint").alias("_file")
    )
    items = F.from_json("value", "array<variant>")
    return (
        files.select("source", F.posexplode(items).alias("_pos", "item"))
        .select("source", "_pos", F.to_json("item").alias("record"))
        .join(numbers, "source")
        .select("source", (F.shiftleft("_file", FILE_SHIFT) + F.col("_pos")).alias("ord"), "record")
    )


def typed(valid: DataFrame, json: str = "record") -> DataFrame:
    """Columns of the engine's registry schema from checked JSON records."""
    r = F.from_json(F.col(json), RECORD)
    parsed = valid.withColumn("_r", r)
    block = F.col("_r.verification")
    switch = lambda name: F.when(
        block.isNotNull(), F.coalesce(block[name], F.lit(False))
    )
    quarantine = block["quarantineReason"]
    return parsed.select(
        "ord",
        F.col("_r.kind").alias("kind"),
        F.col("_r.provider").alias("provider"),
        F.col("_r.deprecated").alias("deprecated"),
        F.col("_r.replacement").alias("replacement"),
        F.col("_r.status").alias("status"),
        F.col("_r.shutdownDate").alias("shutdown_date"),
        F.col("_r.sourceUrl").alias("source_url"),
        F.col("_r.entryId").alias("entry_id"),
        F.col("_r.note").alias("note"),
        block["status"].alias("v_status"),
        switch("officialSourceConfirmed").alias("v_official"),
        switch("replacementConfirmed").alias("v_replacement"),
        switch("autoApplyAllowed").alias("v_auto"),
        F.when(F.trim(quarantine) != "", quarantine).alias("quarantine_reason"),
        block["checkedAt"].alias("checked_at"),
        block["sources"].alias("sources"),
        block["reasons"].alias("reasons"),
        F.col("_r.evidence").alias("evidence"),
        F.col("_r.param").alias("param"),
        F.col("_r.on_models").alias("on_models"),
        F.col("_r.candidateId").alias("candidate_id"),
        F.col("_r.proposedBy").alias("proposed_by"),
        F.col("_r.proposedAt").alias("proposed_at"),
    )


def load_registry(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(typed records, rejects)."""
    valid, rejects = R.split_valid(R.check_records(read_raw(spark, path)), strict)
    return typed(valid), rejects


def load_candidates(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    valid, rejects = R.split_valid(R.check_candidates(read_raw(spark, path)), strict)
    return typed(valid), rejects


def evidence_refs(records: DataFrame) -> DataFrame:
    """One row per evidence reference of a record."""
    return records.select(
        "ord", "deprecated", F.posexplode("evidence").alias("ref_no", "ref")
    ).select(
        "ord",
        "deprecated",
        "ref_no",
        F.col("ref.sourceUrl").alias("source_url"),
        F.col("ref.contentHash").alias("content_hash"),
        F.col("ref.retrievedAt").alias("retrieved_at"),
        F.col("ref.excerpt").alias("excerpt"),
    )


def save_version(df: DataFrame, root: str, version: int | str) -> str:
    """State is written as a new snapshot folder; older versions stay readable."""
    path = f"{root.rstrip('/')}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def committed_version(spark: SparkSession, root: str) -> int | None:
    """Newest version whose registry and queue were both written; None before the first."""
    try:
        marks = spark.read.schema("number bigint").parquet(f"{root.rstrip('/')}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return marks.agg(F.max("number")).first()[0]


def save_transition(next_registry: DataFrame, next_queue: DataFrame, root: str, version: int) -> None:
    """Registry, then queue, then the marker that makes the version the current one.

    Readers resolve both tables through the marker, so they see the version
    before until both are there. What a failed attempt left is overwritten by the
    next attempt; a committed version never is.
    """
    spark, root = next_registry.sparkSession, root.rstrip("/")
    newest = committed_version(spark, root)
    if newest is not None and version <= newest:
        raise ValueError(f"version {version} is not newer than the committed version {newest}")
    next_registry.write.mode("overwrite").parquet(f"{root}/registry/version={version}")
    next_queue.write.mode("overwrite").parquet(f"{root}/queue/version={version}")
    mark = spark.range(version, version + 1, numPartitions=1).select(F.col("id").alias("number"))
    mark.write.mode("overwrite").parquet(f"{root}/commits/version={version}")


def read_transition(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(registry, queue) of the newest committed version, or of an older one."""
    newest = committed_version(spark, root)
    wanted = newest if version is None else version
    if newest is None or wanted > newest:
        raise ValueError(f"no committed version {'' if wanted is None else wanted}".rstrip())
    base = root.rstrip("/")
    return (
        spark.read.parquet(f"{base}/registry/version={wanted}"),
        spark.read.parquet(f"{base}/queue/version={wanted}"),
    )
