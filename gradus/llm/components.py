"""Connected components of an edge table, distributed (large-star and small-star rounds)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, few

#: Edges that one task contracts at a time.
TOGETHER = 1 << 19


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.join(least, "a")
    if large:
        return moved.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded number of edges at a time as stars: each node of them and the least that they connect it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    def out() -> pa.RecordBatch:
        ends = [(x, find(x)) for x in root]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([x for x, r in ends if x != r], pa.int64()), pa.array([r for x, r in ends if x != r], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(root.setdefault(a, a)), find(root.setdefault(b, b))
            root[max(a, b)] = min(a, b)
        if len(root) >= TOGETHER:
            yield out()
    yield out()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b: long): root is the least node it is connected to.

    Tasks contract what they hold of the edges first, then star rounds join what they found; these are
    logarithmic in what is left of a component's width. Each is written to the shared folder.
    """
    name = f"edges-{uuid.uuid4().hex}"
    edges = scratch.stored(few(edges.select("a", "b").where("a <> b")).mapInArrow(contracted, "a long, b long").distinct(), name)
    seen = None
    for turn in range(1 << 10):
        before, name = name, f"{name.split('.')[0]}.{turn}"
        edges = scratch.stored(few(_stars(_stars(edges, large=True), large=False)).mapInArrow(contracted, "a long, b long"), name)
        scratch.drop(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
    raise RuntimeError("no end of star rounds")
