"""Content-addressed document store and report sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.documents import document_keys, new_keys, snapshot_bodies, with_texts
from ..operators.joins import lookup_join
from ..session import durable

DOCUMENT = "doc_key string, content_hash string, url string, retrieved_at string, body string"


def stored_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).parquet(root)


def append_documents(
    captured: DataFrame, stored: DataFrame, root: str, batch: int | str, keys: DataFrame | None = None
) -> str:
    """Add documents whose hash is new; a stored hash is never written again.

    The body is the whole text that the hash was taken of. Of the stored side only
    the column of keys is read. Each batch overwrites its own folder only, so a
    retried batch is idempotent. ``keys`` are the ``document_keys`` of the captures:
    a caller that appends captures more than once hashes them once. The keys of new
    documents are written to the shared folder before their texts are looked up.
    """
    keys = document_keys(captured) if keys is None else keys
    fresh = with_texts(captured, durable(new_keys(keys, stored), "new")).withColumnRenamed("text", "body")
    path = f"{root.rstrip('/')}/batch={batch}"
    fresh.select(*[c.split()[0] for c in DOCUMENT.split(", ")]).write.mode("overwrite").parquet(path)
    return path


def snapshots(stored: DataFrame, excerpts: DataFrame, **sizes: int) -> DataFrame:
    """(doc_key, body): stored texts cut to size around the excerpts cited from them.

    A view for readers that can't take whole texts; the store keeps them whole.
    """
    texts = stored.select("doc_key", F.col("body").alias("text"))
    return snapshot_bodies(texts, excerpts.select("doc_key", "excerpt"), "doc_key", **sizes)


def load_document(stored: DataFrame, refs: DataFrame) -> DataFrame:
    """Stored bodies for evidence references (which carry ``doc_key``)."""
    return lookup_join(refs, stored.select("doc_key", "body"), ["doc_key"], "left")


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """(repo, section, body): one JSON object per finding, count or gate row.

    A document per repository would gather an unbounded array; lines of JSON
    partitioned by section carry the same content at any size.
    """
    out = None
    for name, df in sections.items():
        body = F.to_json(F.struct(*[c for c in df.columns if c != "repo"]))
        rows = df.select("repo", F.lit(name).alias("section"), body.alias("body"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: Rows of one report file: compressed files can't be split, so their size is what a reader holds to a task.
REPORT_ROWS = 1_000_000


def write_report(sections: dict[str, DataFrame], root: str) -> None:
    """Lines of JSON, compressed: every row spells the names of its fields out, which is most of its text."""
    rows = report_rows(sections).write.mode("overwrite").partitionBy("section")
    rows.option("maxRecordsPerFile", REPORT_ROWS).json(root, compression="gzip")
