"""Connected components of an edge table, and joins that check a side's size first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import settled

#: Rows of one or two longs that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Edges that one task may join by itself; more are joined by rounds of the whole cluster.
TASK_EDGES = 200_000


def sized(side: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint if it has no more than ``limit`` rows (counted unless given)."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= limit else side


def _joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    over: dict = {}
    kind = pa.int64()

    def top(x):
        while (up := over.setdefault(x, x)) != x:
            over[x] = over[up]
            x = up
        return x

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = top(a), top(b)
            over[max(x, y)] = min(x, y)
    nodes = list(over)
    for at in range(0, len(nodes), 50_000):
        own = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(own, kind), pa.array([top(x) for x in own], kind)], ["node", "root"])


def components(spark, edges: DataFrame, rounds: int = 60, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(a, b)``, longs or binaries; root is the smallest node of its component.

    Few edges (counted, ``task_edges``) are joined by one task. More go through alternating
    large-star and small-star steps, whose edge count never grows and which end after a
    logarithmic number of rounds; each round's edges are checkpointed.
    """
    kind = edges.schema["a"].dataType.simpleString()
    edges = settled(spark, edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"))
    if edges.count() <= task_edges:
        return edges.coalesce(1).mapInArrow(_joined_in_task, f"node {kind}, root {kind}")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = settled(spark, small.select("e.*").where("a <> b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
