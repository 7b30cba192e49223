"""Connected components of a table of links: union-find in tasks, hooking and pointer jumping between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, ship, tidied


class UnionFind:
    """Sets of integers; the smallest member is the root."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (up := self.parent.get(root, root)) != root:
            root = up
        while x != root:
            self.parent[x], x = root, self.parent.get(x, x)
        return root

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.parent.setdefault(a, a)
        self.parent.setdefault(b, b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


#: Links that one union-find holds before it hands on its forest.
HELD = 500_000


def forest(links: DataFrame) -> DataFrame:
    """(a, b) -> fewer links with the same components: each task keeps a forest, as stars."""
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = UnionFind()

        def flush() -> pa.RecordBatch:
            pairs = [(sets.find(x), x) for x in list(sets.parent)]
            kept = np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(kept[:, 0]), pa.array(kept[:, 1])], names=["a", "b"])

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sets.union(a, b)
            if len(sets.parent) > HELD:
                yield flush()
                sets = UnionFind()
        yield flush()

    return links.select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(tidied(run), "a long, b long")


def _step(links: DataFrame) -> DataFrame:
    """Every node keeps its least parent, passes that on to its other parents, and looks one step further up."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    others = links.join(least, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    above = least.select(F.col("b").alias("m"), F.col("m").alias("top"))
    up = least.join(above, "m", "left").select(F.coalesce("top", "m").alias("a"), "b")
    return up.union(others).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): for every node of the links (a, b), the smallest node that it reaches.

    Links of a node with itself and nulls are ignored.  Runs until a step changes nothing: then every
    node hangs on its component directly.
    """
    ordered = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    current = durable(forest(ordered), "components")
    before, now = None, _state(current)
    while now[0] and now != before:
        current = durable(_step(current), "components")
        before, now = now, _state(current)
    roots = current.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
