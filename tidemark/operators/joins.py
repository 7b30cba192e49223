"""Joining a large fact table to a lookup table of unknown size.

``lookup_join`` is a plain equality join: adaptive execution sees the lookup's
real size in the shuffle statistics, broadcasts it if it is below the session's
threshold and splits skewed partitions otherwise. Nothing runs when the plan is
built and nothing is kept between queries, so a lookup over a folder that has
grown is always read anew.

``salted_join`` is for facts known to have keys that hold a large share of the
rows, where even a split of one shuffle partition would not be enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_KEY_SLOTS = 512  # a key is hot when it holds more than 1/512 of the rows
SALT_BUCKETS = 64


def hot_keys(facts: DataFrame, on: list[str], slots: int = HOT_KEY_SLOTS) -> DataFrame:
    """Keys holding more than 1/slots of the rows: fewer than ``slots`` of them."""
    counts = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    total = facts.agg(F.count(F.lit(1))).first()[0]
    return counts.where(F.col("_n") * slots > total).select(*on).dropna()


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    slots: int = HOT_KEY_SLOTS,
    buckets: int = SALT_BUCKETS,
) -> DataFrame:
    """Shuffle join whose hot keys are spread over ``buckets`` tasks.

    Only the hot keys are replicated on the lookup side. Rows with a null key
    cannot match, so they are spread as well and not sent to one task. The salt
    is a hash of all columns; facts that are equal in all of them should be made
    distinct or counted first.
    """
    hot = F.broadcast(hot_keys(facts, on, slots).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in facts.columns]), F.lit(buckets)).cast("int")
    any_null = F.lit(False)
    for key in on:
        any_null = any_null | F.col(key).isNull()
    left = facts.withColumn("_spread", spread).join(hot, on, "left")
    left = left.withColumn(
        "_salt", F.when(F.col("_hot") | any_null, F.col("_spread")).otherwise(F.lit(0))
    ).drop("_hot", "_spread")
    right = lookup.join(hot, on, "left")
    right = right.withColumn(
        "_salt",
        F.explode(
            F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(
                F.array(F.lit(0))
            )
        ),
    ).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(facts: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """inner / left / left_semi / left_anti join of facts to a lookup table."""
    return facts.join(lookup, on, how)


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` per key.

    An aggregate and not a window: each map task keeps one row per key, so a
    key that holds much of the table costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*").select(*df.columns)


def top_per_group(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key; Spark prunes to ``k`` per task before the shuffle."""
    from pyspark.sql import Window

    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
