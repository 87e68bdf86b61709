"""Approximate nearest neighbours: a forest of random-projection trees under one shared priority queue.

A tree splits at each level along one random direction, at the median of a node's sample. A query goes down all trees with
one queue of nodes: a node's priority is the largest distance from the query to a plane that parts it from the node, so
nodes of all trees come in the order in which neighbours may still be in them. It goes on in two steps: leaves until
`first` vectors are seen, which bounds the distance r of the k-th neighbour, then all leaves whose priority is at most
z r / sqrt(dimensions). A neighbour at distance r in a random direction is about r / sqrt(dimensions) away along a tree's
direction, so leaves beyond that hold few. Candidates of the leaves are ranked by exact distances.

Leaves live in the shuffle: vectors go out once a tree, queries to the leaves that their queue names, and a task owns a
block of vectors of neighbouring leaves and a block of queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import map_batches, stage
from .vectors import usable

_BLOCK = 8192  # vectors, and queries, that a task has at most, but for chance
_LAST = (1 << 63) - 1


class Forest:
    """The trees for vectors of one dimension: directions by level and tree, and the thresholds of inner nodes."""

    def __init__(self, dim: int, trees: int, depth: int, seed: int):
        w = np.random.default_rng([seed, dim]).normal(size=(trees, depth, dim))
        self.dim, self.trees, self.depth = dim, trees, depth
        self.directions = w / np.sqrt((w * w).sum(2, keepdims=True))
        self.thresholds = np.zeros((trees, 1 << depth))
        self.sizes = np.zeros((trees, 1 << depth), np.int64)

    def project(self, vectors: np.ndarray) -> np.ndarray:
        """Places along each tree's and level's direction: (rows, trees, levels)."""
        return (vectors @ self.directions.reshape(-1, self.dim).T).reshape(len(vectors), self.trees, self.depth)

    def fit(self, places: np.ndarray) -> None:
        """Thresholds are the medians of a sample's places; a node without sample rows splits at 0."""
        for t in range(self.trees):
            node = np.ones(len(places), np.int64)
            for level in range(self.depth):
                x = places[:, t, level]
                o = np.lexsort((x, node))
                at, first, n = np.unique(node[o], return_index=True, return_counts=True)
                self.thresholds[t, at] = x[o][first + n // 2]
                node = 2 * node + (x >= self.thresholds[t, node])

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: (rows, trees)."""
        x = self.project(vectors)
        node = np.ones((len(vectors), self.trees), np.int64)
        for level in range(self.depth):
            node = 2 * node + (x[:, :, level] >= self.thresholds[np.arange(self.trees)[None, :], node])
        return node - (1 << self.depth)

    def count(self, sizes: dict[tuple[int, int], int]) -> None:
        """Takes the number of vectors of each (tree, leaf); units of 2^span neighbouring leaves hold about a block."""
        for (t, leaf), n in sizes.items():
            self.sizes[t, leaf] = n
        mean = max(1.0, self.sizes.sum() / self.sizes.size)
        self.span = min(self.depth, max(0, int(math.log2(_BLOCK / 2 / mean)))) if mean < _BLOCK / 2 else 0
        units = self.sizes.reshape(self.trees, -1, 1 << self.span).sum(2)
        self.blocks = np.maximum(1, -(-units // _BLOCK))

    def search(self, vector: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(priority, tree, leaf) in order of priority, from one queue for all trees."""
        x, thresholds, last = self.project(vector[None])[0].tolist(), self.thresholds, self.depth
        queue = [(0.0, t, 1, 0) for t in range(self.trees)]
        while queue:
            far, t, node, level = heapq.heappop(queue)
            while level < last:
                gap = x[t][level] - thresholds[t, node]
                near = 2 * node + (gap >= 0)
                heapq.heappush(queue, (max(far, abs(gap)), t, near ^ 1, level + 1))
                node, level = near, level + 1
            yield far, t, node - (1 << last)


def stack(embedding: pa.Array) -> np.ndarray:
    """The vectors of a batch, all of one dimension, in doubles."""
    flat = embedding.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(embedding), -1)


def _by_dim(cols: dict) -> list[tuple[int, np.ndarray]]:
    dim = cols["dim"].to_numpy(zero_copy_only=False)
    return [(int(d), np.flatnonzero(dim == d)) for d in np.unique(dim)]


def nearest_of(points: np.ndarray, low: np.ndarray, query: np.ndarray, most: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the `most` points nearest to query, ties to the smaller low, none beyond bound."""
    with np.errstate(all="ignore"):
        rough = (points * points).sum(1) + (query @ query) - 2 * (points @ query)
        slack = 1e-9 * ((points * points).sum(1) + query @ query)
        rough = np.where(np.isfinite(rough), rough - slack, -np.inf)
        at = np.arange(len(points))
        if len(points) > most:
            at = np.flatnonzero(rough <= np.partition(rough + 2 * np.where(np.isfinite(slack), slack, 0.0), most - 1)[most - 1])
        exact = np.sqrt(((points[at] - query) ** 2).sum(1))
    o = np.lexsort((low[at], exact))[:most]
    o = o[exact[o] <= bound]
    return at[o], exact[o]


def grow_forests(classes: DataFrame, trees: int, leaf: int, sample: int, seed: int) -> dict[int, Forest]:
    """A forest for each dimension of classes (dim, embedding).

    Depths follow the number of vectors, so that a leaf holds about `leaf`, as long as the sample leaves 16 rows a leaf.
    Thresholds are fitted on the places of about `sample` vectors in all, picked by a seeded hash.
    """
    counts = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row a dimension
    total = max(1, sum(counts.values()))
    forests = {}
    for dim, n in counts.items():
        depth = min(math.ceil(math.log2(max(1, n / leaf))), int(math.log2(max(1, min(n, sample * n / total) / 16))))
        forests[dim] = Forest(dim, trees if depth > 0 else 1, max(0, depth), seed)
    if not any(f.depth for f in forests.values()):
        return forests
    picked = classes.where(F.pmod(F.xxhash64(F.lit(seed), "embedding"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total)))

    def places(cols: dict) -> dict:
        out: list = [None] * len(cols["dim"])
        for dim, at in _by_dim(cols):
            x = forests[dim].project(stack(cols["embedding"].take(pa.array(at)))).reshape(len(at), -1)
            for i, row in zip(at, x):
                out[i] = row.tobytes()
        return {"dim": cols["dim"], "places": pa.array(out, pa.binary())}

    got = map_batches(picked.select("dim", "embedding", F.lit(b"1").alias("weight")), places, "dim int, places binary", "weight", 1024).toArrow().combine_chunks()
    dims = got["dim"].to_numpy()
    for dim, f in forests.items():
        own = got["places"].filter(pa.array(dims == dim)).to_pylist()
        if f.depth and own:
            f.fit(np.frombuffer(b"".join(own), np.float64).reshape(len(own), f.trees, f.depth))
    return forests


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", trees: int = 8, leaf: int = 256, first: int = 2048, sample: int = 1 << 16, reach: float = 0.25, seed: int = 23) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by `every`.

    score is the Euclidean distance of the given vectors in doubles; ties go to the smaller id, null ids last. All other
    rows of the same dimension are candidates, those of the query's own id too if ids repeat; a query row leaves itself
    out once, and repeated query rows get their k rows each. Vectors that are null, empty, zero or have null or non-finite
    components take no part. Equal vectors are one point of the index, which names its k + 1 smallest ids: no later one
    can be a result. The index holds every row; only its thresholds come from a sample. z is reach times the square root
    of the trees' depth. If fewer than k rows are seen in the first step, all leaves are. An empty table gives an empty
    result. Other columns aren't read.
    """
    kind = vectors.schema[embedding].dataType.elementType
    kind = "float" if isinstance(kind, T.FloatType) else "double"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind}>").alias("embedding")).where(usable(F.col("embedding")))
    # the first k + 1 ids of each vector; Spark keeps no more of them on either side of the shuffle
    nth = F.row_number().over(Window.partitionBy("embedding").orderBy(F.col("vec_id").asc_nulls_last()))
    firsts = v.withColumn("_n", nth).where(F.col("_n") <= k + 1).groupBy("embedding").agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", "vec_id"))), lambda r: r["vec_id"]).alias("ids"))
    classes = firsts.select(F.monotonically_increasing_id().alias("class_id"), F.size("embedding").alias("dim"), "embedding", "ids")
    classes = stage(classes, "nearest-classes")
    askers = v.where(F.col("vec_id") % every == 0)
    named = classes.select("class_id", "dim", F.col("embedding").alias("_embedding"))
    asked = stage(askers.join(named, F.col("embedding") == F.col("_embedding")).select("vec_id", "class_id", "dim", "embedding"), "nearest-askers")
    queries = stage(asked.dropDuplicates(["class_id"]).select(F.col("class_id").alias("q"), "dim", "embedding"), "nearest-queries")
    forests = grow_forests(classes, trees, leaf, sample, seed)

    points = "dim int, tree int, leaf int, class_id long, low long, copies int, embedding array<{}>".format(kind)

    def place(cols: dict) -> dict:
        rows, tree, leaves = [], [], []
        for dim, at in _by_dim(cols):
            own = forests[dim].leaves(stack(cols["embedding"].take(pa.array(at))))
            rows.append(np.repeat(at, own.shape[1])), tree.append(np.tile(np.arange(own.shape[1]), len(at))), leaves.append(own.ravel())
        take = pa.array(np.concatenate(rows))
        return {k: cols[k].take(take) for k in ("dim", "class_id", "low", "copies", "embedding")} | {"tree": np.concatenate(tree).astype(np.int32), "leaf": np.concatenate(leaves).astype(np.int32)}

    given = classes.select("class_id", "dim", F.coalesce(F.col("ids")[0], F.lit(_LAST)).alias("low"), F.size("ids").alias("copies"), "embedding", F.lit(b"1").alias("weight"))
    placed = stage(map_batches(given, place, points, "weight", 2048), "nearest-leaves")
    sizes: dict = {}
    for r in placed.groupBy("dim", "tree", "leaf").count().collect():  # trees times sample / 16 rows at most, whatever the table
        sizes.setdefault(r["dim"], {})[r["tree"], r["leaf"]] = r["count"]
    for dim, f in forests.items():
        f.count(sizes[dim])

    def visits(second: bool):
        def run(cols: dict) -> dict | None:
            q, bound = cols["q"].to_numpy(), cols["bound"].to_numpy(zero_copy_only=False)
            rows, tree, unit, block, named = [], [], [], [], []
            for dim, at in _by_dim(cols):
                f, x = forests[dim], stack(cols["embedding"].take(pa.array(at)))
                for i, vector in zip(at, x):
                    limit, seen, found = reach * math.sqrt(max(1, f.depth) / dim) * bound[i], 0, {}
                    for far, t, at_leaf in f.search(vector):
                        early = seen < first
                        seen += int(f.sizes[t, at_leaf])
                        if not early and (not second or far > limit):
                            break
                        if early != second:
                            found.setdefault((t, at_leaf >> f.span), []).append(at_leaf)
                    for (t, u), some in found.items():
                        n = int(f.blocks[t, u])
                        rows += [i] * n
                        tree += [t] * n
                        unit += [u] * n
                        block += range(n)
                        named += [some] * n
            if not rows:
                return None
            take = pa.array(np.array(rows, np.int64))
            return {"q": pa.array(q[np.array(rows, np.int64)]), "dim": cols["dim"].take(take), "bound": cols["bound"].take(take), "embedding": cols["embedding"].take(take), "tree": pa.array(tree, pa.int32()), "unit": pa.array(unit, pa.int32()), "block": pa.array(block, pa.int32()), "leaves": pa.array(named, pa.list_(pa.int32()))}

        return run

    def into_units(cols: dict) -> dict:
        out = {k: np.zeros(len(cols["dim"]), np.int32) for k in ("unit", "block")}
        tree, own, mix = (cols[k].to_numpy(zero_copy_only=False) for k in ("tree", "leaf", "mix"))
        for dim, at in _by_dim(cols):
            f = forests[dim]
            out["unit"][at] = own[at] >> f.span
            out["block"][at] = mix[at] % f.blocks[tree[at], out["unit"][at]]
        return {k: c for k, c in cols.items() if k not in ("mix", "weight")} | out

    def rank(points: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], [], []]
        if points.num_rows and asked.num_rows:
            points = points.sort_by("leaf")
            x, own, low = stack(points["embedding"].combine_chunks()), points["leaf"].to_numpy(), points["low"].to_numpy()
            ids, copies = points["class_id"].to_numpy(), points["copies"].to_numpy()
            at = {int(u): (i, j) for u, i, j in zip(*_runs(own))}
            y = stack(asked["embedding"].combine_chunks())
            for i, (q, limit, some) in enumerate(zip(asked["q"].to_pylist(), asked["bound"].to_pylist(), asked["leaves"].to_pylist())):
                rows = np.concatenate([np.arange(*at[u]) for u in some if u in at] or [np.zeros(0, np.int64)])
                near, far = nearest_of(x[rows], low[rows], y[i], k + 1, limit)
                near = rows[near]
                for o, c in zip(out, (np.full(len(near), q), ids[near], low[near], copies[near], far)):
                    o.append(c)
        columns = [np.concatenate(c) if c else np.zeros(0) for c in out]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()))], ["q", "class_id", "low", "copies", "score"])

    spread = map_batches(placed.withColumns({"mix": F.pmod(F.xxhash64("class_id"), F.lit(1 << 30)).cast("int"), "weight": F.lit(b"1")}), into_units, points + ", unit int, block int", "weight", 4096)
    best = Window.partitionBy("q").orderBy("score", "low", "class_id")

    def step(asked_: DataFrame, second: bool) -> DataFrame:
        sent = map_batches(asked_.withColumn("weight", F.lit(b"1")), visits(second), f"q long, dim int, bound double, embedding array<{kind}>, tree int, unit int, block int, leaves array<int>", "weight", 64)
        # queries of a unit go in parts as well, so that no task gets all of them; its vectors go to each part
        keys = ["dim", "tree", "unit", "block"]
        sent = stage(sent, "nearest-visits")
        parts = sent.groupBy(*keys).agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("n_parts"))
        sent = sent.join(parts, keys).withColumn("part", F.pmod(F.xxhash64(F.lit(5), "q"), F.col("n_parts")).cast("int")).drop("n_parts")
        there = spread.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")
        keys = [*keys, "part"]
        return there.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(rank, "q long, class_id long, low long, copies int, score double")

    def merged(found: DataFrame) -> DataFrame:
        """The k + 1 best classes of each query; a class that several trees found counts once."""
        return found.dropDuplicates(["q", "class_id"]).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)

    near = stage(merged(step(queries.withColumn("bound", F.lit(math.inf)), False)), "nearest-first")
    # the distance within which k rows besides the query's own are known to lie
    rows_so_far = F.sum("copies").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bounds = near.withColumn("_rows", rows_so_far).where(F.col("_rows") > k).groupBy("q").agg(F.min("score").alias("found"))
    again = queries.join(bounds, "q", "left").select("q", "dim", "embedding", F.coalesce("found", F.lit(math.inf)).alias("bound"))
    every_one = stage(merged(near.drop("_n").unionByName(step(again, True))).drop("_n"), "nearest-found")

    listed = every_one.join(classes.select("class_id", "ids"), "class_id").select("q", "score", F.explode("ids").alias("vec_id"))
    in_order = Window.partitionBy("q").orderBy(F.col("score"), F.col("vec_id").asc_nulls_last())
    listed = listed.withColumn("_n", F.row_number().over(in_order)).where(F.col("_n") <= k + 1)
    rows = listed.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_n", "score", "vec_id"))).alias("rows"))
    # a query's own row is the first of its distance and id, if it is listed at all
    whole = asked.select(F.col("vec_id").alias("query_id"), F.col("class_id").alias("q")).join(rows, "q")
    own = F.array_min(F.transform(F.filter("rows", lambda r: (r["score"] == 0) & (r["vec_id"] == F.col("query_id"))), lambda r: r["_n"]))
    kept = F.slice(F.filter("rows", lambda r: ~r["_n"].eqNullSafe(F.col("own"))), 1, k)
    return whole.withColumn("own", own).select("query_id", F.posexplode(kept).alias("at", "r")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "r.vec_id", "r.score")


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first row, row after the last) of each run."""
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    return sorted_keys[at], at, np.append(at[1:], len(sorted_keys))
