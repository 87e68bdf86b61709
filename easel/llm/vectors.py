"""Exact near-duplicates of vectors by a metric range join.

Unit vectors are points; a cosine bound is a distance bound r. Each label gets pivots; a point's home is the
cell of its nearest pivot p. A cell q must also see each outside point x that may lie within r of one of its
own: by the triangle inequality d(x, q) <= r + (radius of q) and d(x, q) <= d(x, p) + 2 r; for points in space
the bisector of p and q gives d(x, q)^2 - d(x, p)^2 <= 2 r d(p, q). A home point then finds all its links in its
own cell, so cells join independently and each link is counted once from either end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import components, map_batches, stage

BLOCK = 4096
_CHUNK = 1024  # columns of a block pair that are compared at once


def _units(embedding: pa.Array) -> np.ndarray:
    v = np.stack([np.asarray(x.values, np.float64) for x in embedding]) if len(embedding) else np.zeros((0, 1))
    return unit(v)


def unit(v: np.ndarray) -> np.ndarray:
    """Rows over their lengths; over their largest component first, so that no square leaves the range of doubles."""
    v = v / np.abs(v).max(-1, keepdims=True, initial=0)
    return v / np.sqrt((v * v).sum(-1, keepdims=True))


def usable(embedding: Column) -> Column:
    """No nulls, no infinities or NaN, not zero, not empty."""
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(ok & F.exists(embedding, lambda x: x != 0), F.lit(False))


def choose_pivots(classes: DataFrame, per_label: int, most: int, block: int) -> dict[tuple[int, int], np.ndarray]:
    """Unit pivots by (label, dimension): the vectors of the lowest seeded hashes, one for each `block` vectors of a
    label and per_label at least, `most` in all. A label without pivots is one cell."""
    h = F.xxhash64(F.lit(5), "class_id")
    want = classes.groupBy("label", "dim").agg(F.greatest(F.lit(per_label), F.least(F.lit(most), F.ceil(F.count("*") / block))).cast("int").alias("_want"))
    # a label is thinned by hash before it is ranked, so no task holds it whole
    salted = classes.join(want, ["label", "dim"]).withColumn("_salt", F.pmod(F.xxhash64(F.lit(7), "class_id"), 8 * F.col("_want")))
    thin = salted.groupBy("label", "dim", "_want", "_salt").agg(F.min_by("embedding", F.struct(h, "class_id")).alias("embedding"), F.min(h).alias("_h"))
    nth = F.row_number().over(Window.partitionBy("label", "dim").orderBy("_h", "_salt"))
    rows = thin.withColumn("_n", nth).where(F.col("_n") <= F.col("_want")).orderBy("_n", "label", "dim").limit(most).collect()
    out: dict = {}
    for r in rows:
        out.setdefault((r["label"], r["dim"]), []).append(unit(np.array(r["embedding"], np.float64)))
    return {k: np.stack(v) for k, v in out.items()}


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of near that connect what all of near connects; at most one for each row and column."""
    links, columns = [], near.any(0)
    rest = near.any(1)
    while rest.any():
        queue = [(0, int(rest.argmax()))]
        rest[queue[0][1]] = False
        while queue:
            side, x = queue.pop()
            if side == 0:
                new = np.flatnonzero(near[x] & columns)
                columns[new] = False
                links += [(x, int(y)) for y in new]
            else:
                new = np.flatnonzero(near[:, x] & rest)
                rest[new] = False
                links += [(int(y), x) for y in new]
            queue += [(1 - side, int(y)) for y in new]
    return links


def vector_links(classes: DataFrame, bound: float, per_label: int = 8, most: int = 4096, block: int = BLOCK) -> DataFrame:
    """Over distinct vectors (class_id, label, dim, embedding, copies): rows (a, b, others).

    Where b is null, others is a part of the number of vectors of other classes linked to class a; else a and b
    are linked, and these links are enough to give the components: at most one for each point of a block pair.
    A cell is met in pairs of a block of home points and a block of points that it sees, guests included, so no task
    holds a large cell whole.
    """
    # a cosine that rounds to the bound is up to 1e-8 away from it in distance near a pivot
    r = math.sqrt(max(0.0, 2 - 2 * bound)) + 1e-7
    pivots = choose_pivots(classes, per_label, most, block)
    apart = {k: np.sqrt(np.maximum(0, 2 - 2 * p @ p.T)) for k, p in pivots.items()}

    def groups(cols: dict) -> list:
        label, dim = cols["label"].to_numpy(zero_copy_only=False), cols["dim"].to_numpy(zero_copy_only=False)
        return [(key, np.flatnonzero((label == key[0]) & (dim == key[1]))) for key in {*zip(label.tolist(), dim.tolist())} & pivots.keys()]

    def to_pivots(cols: dict, key: tuple, at: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * _units(cols["embedding"].take(pa.array(at))) @ pivots[key].T))

    def nearest(cols: dict) -> dict:
        cell, dist, known = np.zeros(len(cols["label"]), np.int32), np.zeros(len(cols["label"])), np.zeros(len(cols["label"]), bool)
        for key, at in groups(cols):
            d = to_pivots(cols, key, at)
            cell[at], dist[at], known[at] = d.argmin(1), d.min(1), True
        return {**cols, "cell": pa.array(cell), "dist": pa.array(dist), "known": pa.array(known)}

    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "embedding")}
    point = f"class_id long, label {kinds['label']}, dim int, embedding {kinds['embedding']}, copies long"
    homes = stage(map_batches(classes.withColumn("weight", F.lit(b"1")), nearest, f"{point}, weight binary, cell int, dist double, known boolean", "weight", 2048).drop("weight"), "vector-cells")
    # cells that have a pivot, so `most` rows at most
    radius = {(c["label"], c["dim"], c["cell"]): c["radius"] for c in homes.where("known").groupBy("label", "dim", "cell").agg(F.max("dist").alias("radius")).collect()}

    def seen(cols: dict) -> dict:
        """The cells that must see each point, its home first."""
        dist, home = (cols[k].to_numpy(zero_copy_only=False) for k in ("dist", "cell"))
        rows, cell = [np.arange(len(home))], [home.astype(np.int64)]
        for key, at in groups(cols):
            d = to_pivots(cols, key, at)
            far = np.array([radius.get((*key, q), -1e9) for q in range(d.shape[1])])
            own = dist[at][:, None]
            see = (d <= r + far) & (d <= own + 2 * r) & (d * d - own * own <= 2 * r * apart[key][home[at]] + 1e-7)
            see[np.arange(len(at)), home[at]] = False
            x, q = np.nonzero(see)
            rows.append(at[x])
            cell.append(q)
        rows, cell = np.concatenate(rows), np.concatenate(cell)
        take = pa.array(rows)
        return {k: cols[k].take(take) for k in ("class_id", "label", "dim", "embedding", "copies")} | {"cell": pa.array(cell.astype(np.int32)), "home": pa.array(np.arange(len(rows)) < len(home))}

    # a point that many cells see is written once for each, so that guests can be counted before they are dealt out
    guests = map_batches(homes.withColumn("weight", F.lit(b"1")), seen, f"{point}, cell int, home boolean", "weight", 512)
    guests = stage(guests, "vector-guests")
    sizes = guests.groupBy("label", "dim", "cell").agg(F.ceil(F.count_if("home") / block).cast("int").alias("nh"), F.ceil(F.count("*") / block).cast("int").alias("no"))
    sized = guests.join(sizes, ["label", "dim", "cell"])
    mine = lambda n: F.pmod(F.xxhash64(F.lit(3), "class_id"), F.col(n)).cast("int")
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = "struct<i:int,j:int,as_home:boolean>"
    as_other = F.transform(all_of("nh"), lambda i: F.struct(i.alias("i"), mine("no").alias("j"), F.lit(False).alias("as_home")))
    as_home = F.transform(all_of("no"), lambda j: F.struct(mine("nh").alias("i"), j.alias("j"), F.lit(True).alias("as_home")))
    met = sized.where("nh > 0").withColumn("at", F.explode(F.concat(as_other, F.when(F.col("home"), as_home).otherwise(F.array().cast(f"array<{pair}>")))))
    met = met.select("class_id", "label", "dim", "embedding", "copies", "cell", "at.i", "at.j", "at.as_home")

    def join(table: pa.Table) -> pa.Table:
        at_home = table.column("as_home").to_numpy()
        ids, copies = table.column("class_id").to_numpy(), table.column("copies").to_numpy()
        units = _units(table.column("embedding").combine_chunks())
        h, o = np.flatnonzero(at_home), np.flatnonzero(~at_home)
        others, a, b = np.zeros(len(h), np.int64), [], []
        for k in range(0, len(o), _CHUNK):
            part = o[k : k + _CHUNK]
            near = (units[h] @ units[part].T >= bound) & (ids[h][:, None] != ids[part][None, :])
            others += near @ copies[part]
            for x, y in spanning(near):
                a.append(ids[h[x]])
                b.append(ids[part[y]])
        some = others > 0
        n = int(some.sum())
        return pa.table({"a": pa.array([*ids[h][some], *a], pa.int64()), "b": pa.array([None] * n + b, pa.int64()), "others": pa.array([*others[some].tolist(), *[None] * len(b)], pa.int64())})

    return met.groupBy("label", "dim", "cell", "i", "j").applyInArrow(join, "a long, b long, others long")


def vector_groups(vectors: DataFrame, bound: float = 0.93, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", per_label: int = 8, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Vectors link where labels are equal, dimensions are equal and the cosine is at least bound. Equal vectors are
    one class with a number of copies, joined once. Rows with a null label, or whose vector is null, empty, zero or
    has null or non-finite components, link with nothing and are their own component. Rows are rows: those of one id
    count and link each by its vector, n_links counts rows, and a row without an id links as any other but never names
    a component, whose id is null where it has no other rows. Whole numbers are compared as longs as labels, others as
    strings; floats and doubles stay what they are. kept is whether the ids are the same, null and null too.
    An empty table gives an empty result. Other columns aren't read.
    """
    kind = vectors.schema[embedding].dataType.elementType.simpleString()
    labels = "long" if isinstance(vectors.schema[label].dataType, T.IntegralType) else "string"
    v = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast(f"array<{kind if kind in ('float', 'double') else 'double'}>").alias("embedding"), F.col(label).cast(labels).alias("label"))
    v = v.withColumn("ok", usable(F.col("embedding")) & F.col("label").isNotNull())
    classes = v.where("ok").groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # the number of a class is its own key, as ids may repeat; the table is written, so it stays
    classes = stage(classes.select(F.monotonically_increasing_id().alias("class_id"), "label", F.size("embedding").alias("dim"), "embedding", "copies", "low"), "vector-classes")
    found = stage(vector_links(classes.drop("low"), bound, per_label, block=block), "vector-links")
    others = found.where("b is null").groupBy("a").agg(F.sum("others").alias("others"))
    # nodes in order of their smallest id, so that the smallest node of a component has its id
    node = F.struct(F.col("low").isNull().alias("none"), "low", "class_id")
    ends = found.where("b is not null").select("a", "b")
    for side in ("a", "b"):
        ends = ends.join(classes.select(F.col("class_id").alias("_c"), node.alias(f"node_{side}")), F.col(side) == F.col("_c")).drop("_c")
    roots = components(ends, "node_a", "node_b").select(F.col("node.class_id").alias("_node"), F.struct("root.low").alias("root"))
    named = classes.join(others, classes["class_id"] == others["a"], "left").join(roots, classes["class_id"] == roots["_node"], "left")
    named = named.select(F.col("label").alias("_label"), F.col("embedding").alias("_embedding"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.when(F.col("root").isNull(), F.col("low")).otherwise(F.col("root.low")).alias("low"))
    linked = v.where("ok").join(named, (v["label"] == named["_label"]) & (v["embedding"] == named["_embedding"])).select("vec_id", F.col("n").alias("n_links"), F.col("low").alias("component_id"))
    alone = v.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
