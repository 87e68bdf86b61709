"""Connected components by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ship import ship
from .staging import shuffled, stage, unstage


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node reachable.

    Alternates large-star and small-star steps. Each step is a minimum by node, which Spark combines before
    the shuffle, and an inner join that adaptive execution splits where one node has most links. Every round
    is staged, so no lineage grows and lost executors cost one round at most. Only two numbers reach the
    driver a round, of all links; rounds go on while these change, which takes about as many as the logarithm of the
    longest chain. Nodes without links are absent; self links and repeated links change nothing; null ends
    are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = stage(e, "links"), None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(shuffled(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        after = stage(small.distinct(), "links")
        now = after.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("h")).first()
        unstage(e)
        e = after
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def contracted(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Links (a, b) of whole numbers with the same components, at most one for each node and task: a task joins what its
    own rows link, and gives each node with the smallest one that it found it linked to. Null ends and self links go."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if (x := root(x)) != (y := root(y)):
                    up[max(x, y)] = min(x, y)
        nodes = [x for x in up if root(x) != x]
        for i in range(0, len(nodes), 1 << 16):
            some = nodes[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([root(x) for x in some], pa.int64()), pa.array(some, pa.int64())], [a, b])

    whole = edges.select(F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b)).where(F.col(a) != F.col(b))
    return whole.mapInArrow(run, f"`{a}` long, `{b}` long")
