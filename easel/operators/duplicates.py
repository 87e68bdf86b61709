"""Near-duplicate images: hash pairs, verification, groups, and which copy to keep."""

from __future__ import annotations

from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from easel.functions.rasters import dot
from easel.plans.components import components, contracted
from easel.plans.ship import ship
from easel.plans.staging import shuffled, stage, unstage

from .hamming import Part, best_layout, close_classes
from .tags import with_position

MIN_GAP = 6.0


def distance(a: Column, b: Column, words: int) -> Column:
    """Differing bits of two arrays of `words` longs."""
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(words)])


def hamming_pairs(sig: DataFrame, threshold: int, words: int = 1, bits: int = 64, id: str = "id", hash: str = "hash", keep: tuple[str, ...] = (), rows: int | None = None) -> DataFrame:
    """(a, b, dist, sim[, a_x, b_x of kept columns]) of all pairs a < b within threshold bits; sim is 1 - dist / (bits * words).

    Exact, by an index over the distinct hashes that is laid out for their number (or for `rows`): see hamming.py. Equal
    hashes are one class there, and ids and kept columns come in by the class after, so copies cost what they put out.
    Null ids or hashes pair with nothing; nor do rows of one id.
    """
    s = sig.where(F.col(id).isNotNull() & F.col(hash).isNotNull()).select(F.col(id).alias("id"), F.col(hash).alias("h"), *keep)
    s = stage(s, "hashes")
    classes = stage(s.select("h").distinct().select(F.monotonically_increasing_id().alias("c"), "h"), "hash-classes")
    total = bits * words
    layout = best_layout(total, threshold, classes.count() if rows is None else rows)
    near = close_classes(classes, threshold, words, bits, layout)
    members = s.join(shuffled(classes.withColumnRenamed("h", "_h")), F.col("h") == F.col("_h")).select("id", "c", *keep)
    side = lambda n: members.select(F.col("c").alias(f"c{n}"), F.col("id").alias(f"id{n}"), F.struct(*[F.lit(1).alias("_"), *keep]).alias(f"kept{n}"))
    apart = near.join(shuffled(side(1)), F.col("x") == F.col("c1")).join(shuffled(side(2)), F.col("y") == F.col("c2")).where("id1 != id2")
    equal = side(1).join(shuffled(side(2)), (F.col("c1") == F.col("c2")) & (F.col("id1") < F.col("id2"))).withColumn("dist", F.lit(0))
    cols = ["id1", "id2", "kept1", "kept2", "dist"]
    both = apart.select(*cols).unionByName(equal.select(*cols))
    first = F.col("id1") < F.col("id2")
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    both = both.select(pick("id1", "id2").alias("a"), pick("id2", "id1").alias("b"), "dist", pick("kept1", "kept2").alias("ka"), pick("kept2", "kept1").alias("kb"))
    return both.select("a", "b", "dist", (1 - F.col("dist") / total).alias("sim"), *[F.col(f"k{x}.{c}").alias(f"{x}_{c}") for x in "ab" for c in keep])


def verify_hash(pairs: DataFrame, threshold: int, words: int = 1, hash: str = "phash") -> DataFrame:
    """Pairs whose second hash also agrees; columns a_<hash> and b_<hash>."""
    return pairs.where(distance(F.col(f"a_{hash}"), F.col(f"b_{hash}"), words) <= threshold)


def verify_histogram(pairs: DataFrame, threshold: float = 0.5, hist: str = "unit") -> DataFrame:
    """Pairs whose centred unit histograms correlate enough; a missing histogram passes, a flat one gives 0."""
    r = dot(F.col(f"a_{hist}"), F.col(f"b_{hist}"))
    return pairs.where(F.col(f"a_{hist}").isNull() | F.col(f"b_{hist}").isNull() | (r >= threshold))


def descriptor_matches(pairs: DataFrame, descriptors: DataFrame, words: int = 4, ratio: float = 0.75, least: int = 4) -> DataFrame:
    """(a, b, matches): good matches of the pairs' descriptors (id, kp, d): the nearest is clearly nearer than the
    second nearest. Pairs with a side of fewer than 2 descriptors, or with fewer than `least` matches, are left out."""
    n = descriptors.groupBy("id").agg(F.count("*").alias("n")).where("n >= 2").select("id")
    able = descriptors.join(n, "id", "left_semi")
    left = able.select(F.col("id").alias("a"), F.col("kp").alias("ka"), F.col("d").alias("da"))
    right = able.select(F.col("id").alias("b"), F.col("kp").alias("kb"), F.col("d").alias("db"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("dist", distance(F.col("da"), F.col("db"), words))
    # the two nearest; those that can't be are dropped before the shuffle
    nth = F.row_number().over(Window.partitionBy("a", "b", "ka").orderBy("dist", "kb"))
    two = met.withColumn("_n", nth).where("_n <= 2").groupBy("a", "b", "ka").agg(F.min("dist").alias("near"), F.max("dist").alias("next"))
    good = two.where(F.col("near") < ratio * F.col("next"))
    return good.groupBy("a", "b").agg(F.count("*").alias("matches")).where(F.col("matches") >= least)


def descriptor_candidates(descriptors: DataFrame, linked: DataFrame | None = None, words: int = 4, bits: int = 64, parts: int = 16, least: int = 4) -> DataFrame:
    """(a, b, shared), a < b: images whose descriptors (id, kp, d), cut into parts, have at least `least` values of parts in
    common, but for the pairs in linked (a, b).

    Exact. Of two sets with `least` values in common, each with its values in one order, rarest first, some value is
    common to both without their last least - 1. So only these shorter lists are joined: an image's most frequent values
    are never a key, and the rest is counted over whole sets for the pairs that met.
    """
    ship(descriptors.sparkSession)
    total = words * bits
    cut = [Part(n * total // parts, (n + 1) * total // parts - n * total // parts, 0, 0, 0) for n in range(parts)]
    key = lambda n, p: F.lit(n << 57).bitwiseOR(_part_value(F.col("d"), p, bits)) if p.width <= 56 else F.xxhash64(F.lit(n), _part_value(F.col("d"), p, bits))
    own = descriptors.where(F.col("id").isNotNull() & F.col("d").isNotNull()).select("id", F.explode(F.array(*[key(n, p) for n, p in enumerate(cut)])).alias("k")).distinct()
    own = stage(own, "parts-of-descriptors")
    often = own.groupBy("k").agg(F.count("*").alias("_n")).where("_n > 1")
    both = own.join(often, "k")
    sets = both.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_n", "k"))).alias("s")).where(F.size("s") >= least)  # as long as an image has descriptors
    sets = stage(sets.select("id", F.col("s.k").alias("keys")), "sets")
    rare = sets.select("id", F.explode(F.slice("keys", F.lit(1), F.size("keys") - (least - 1))).alias("k"))
    met = rare.select(F.col("id").alias("a"), "k").join(rare.select(F.col("id").alias("b"), "k"), "k").where("a < b").select("a", "b").distinct()
    if linked is not None:
        met = met.join(linked.select("a", "b").distinct(), ["a", "b"], "left_anti")
    side = lambda n: sets.select(F.col("id").alias(n), F.col("keys").alias(f"_{n}"))
    shared = F.size(F.array_intersect("_a", "_b"))
    return met.join(side("a"), "a").join(side("b"), "b").select("a", "b", shared.alias("shared")).where(F.col("shared") >= least)


def _part_value(hash: Column, part: Part, bits: int) -> Column:
    """The bits of a part as a long."""
    value, at, done = F.lit(0).cast("long"), part.start, 0
    while done < part.width:
        n = min(part.width - done, bits - at % bits)
        own = F.shiftrightunsigned(hash[at // bits], at % bits).bitwiseAND(F.lit((1 << n) - 1 if n < 64 else -1))
        value = value.bitwiseOR(F.shiftleft(own, done))
        at, done = at + n, done + n
    return value


def valid_homography(h: Column, width: Column, height: Column) -> Column:
    """The image's corners map to a strictly convex outline in positive order, its area 0.1 to 10 times the image's."""
    corners = [(F.lit(0.0), F.lit(0.0)), (width.cast("double"), F.lit(0.0)), (width.cast("double"), height.cast("double")), (F.lit(0.0), height.cast("double"))]
    at = []
    for x, y in corners:
        w = h[6] * x + h[7] * y + h[8]
        at.append(((h[0] * x + h[1] * y + h[2]) / F.nullif(w, F.lit(0.0)), (h[3] * x + h[4] * y + h[5]) / F.nullif(w, F.lit(0.0))))
    turns = [(at[(i + 1) % 4][0] - at[i][0]) * (at[(i + 2) % 4][1] - at[(i + 1) % 4][1]) - (at[(i + 1) % 4][1] - at[i][1]) * (at[(i + 2) % 4][0] - at[(i + 1) % 4][0]) for i in range(4)]
    area = F.abs(reduce(lambda s, t: s + t, [at[i][0] * at[(i + 1) % 4][1] - at[(i + 1) % 4][0] * at[i][1] for i in range(4)])) / 2
    share = area / (width * height)
    return F.coalesce(reduce(lambda s, t: s & t, [t > 0 for t in turns]) & (share >= 0.1) & (share <= 10), F.lit(False))


def max_similarity(items: DataFrame, edges: DataFrame, groups: DataFrame, id: str = "id") -> DataFrame:
    """(id, similarity): 100 times the best of all incident links, one decimal; null for items without a group."""
    ends = edges.select(F.col("a").alias("_i"), "sim").unionByName(edges.select(F.col("b").alias("_i"), "sim"))
    best = ends.groupBy("_i").agg(F.max("sim").alias("_s"))
    grouped = groups.select(F.col("id").alias("_g"), "group")
    out = items.join(shuffled(best), F.col(id) == F.col("_i"), "left").join(shuffled(grouped), F.col(id) == F.col("_g"), "left")
    return out.select(id, F.when(F.col("group").isNotNull(), F.round(F.col("_s") * 100, 1)).alias("similarity"))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of nodes with links; component is the smallest id reachable. Whole numbers are linked within tasks
    first."""
    if isinstance(edges.schema[a].dataType, T.LongType) and isinstance(edges.schema[b].dataType, T.LongType):
        edges = contracted(edges, a, b)
    return components(edges, a, b).select(F.col("node").alias("id"), F.col("root").alias("component"))


def peel(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, their centres) of star_groups() over links that are distinct, one node after another."""
    ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    n, m = len(ids), len(x)
    order = np.argsort(at, kind="stable")
    to = np.concatenate([at[m:], at[:m]])[order].astype(np.int32)
    left = np.bincount(at, minlength=n)
    start = np.concatenate([[0], np.cumsum(left)]).tolist()
    alive, centre, top = np.ones(n, bool), np.full(n, -1), int(left.max(initial=0))
    # by degree, then id; a degree only falls, so an entry that is out of date comes too early and goes back
    heap = ((top - left) * n + np.arange(n)).tolist()
    heapify(heap)
    while heap:
        k = heappop(heap)
        i = k % n
        if not alive[i]:
            continue
        if (now := int(left[i])) != top - k // n:
            if now:
                heappush(heap, (top - now) * n + i)
            continue
        near = to[start[i] : start[i + 1]]
        near = near[alive[near]]
        centre[near] = centre[i] = i
        alive[near] = alive[i] = False
        np.subtract.at(left, np.concatenate([to[start[j] : start[j + 1]] for j in near.tolist()]), 1)
    got = centre >= 0
    return ids[got], ids[centre[got]]


def star_groups(edges: DataFrame, a: str = "a", b: str = "b", most: int = 1 << 22) -> DataFrame:
    """(id, group): repeatedly the node of highest remaining degree (ties: smallest id) takes its remaining
    neighbours; group is the centre's id. Nodes left without links have no row.

    Components of up to `most` links, and all that is left once it has no more, are each finished in one task. Larger
    ones go in rounds over the whole graph: every node that is best within two steps becomes a centre at once, which
    gives what taking them one by one gives, as such centres share no neighbour. Components are looked up again
    whenever half of the links are gone. Each round takes the best node of all at least, so the rounds end.
    """
    ship(edges.sparkSession)
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    both = stage(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    kind = both.schema["x"].dataType.simpleString()

    def finish(links: pa.Table) -> pa.Table:
        return pa.table(list(peel(links.column("x").to_numpy(), links.column("y").to_numpy())), ["id", "group"])

    def finished(links: DataFrame) -> DataFrame:
        return stage(links.where("x < y").groupBy("root").applyInArrow(finish, f"id {kind}, `group` {kind}"), "star")

    parts: list[DataFrame] = []
    split = None
    while (n := both.count() // 2) > most:
        if split is None or n <= split // 2:
            roots = components(both.where("x < y"), "x", "y")
            marked = stage(both.join(shuffled(roots), F.col("x") == F.col("node")).select("x", "y", "root"), "marked")
            small = marked.groupBy("root").count().where(F.col("count") <= 2 * most).select("root")
            parts.append(finished(marked.join(shuffled(small), "root", "left_semi")))
            after = stage(marked.join(shuffled(small), "root", "left_anti").select("x", "y"), "edges")
            unstage(marked), unstage(both)
            both, split = after, after.count() // 2
            continue
        rank = both.groupBy("x").agg(F.struct(F.count("*").alias("deg"), (-F.col("x")).alias("neg")).alias("own"))
        best1 = both.join(shuffled(rank.select(F.col("x").alias("_y"), "own")), F.col("y") == F.col("_y")).groupBy("x").agg(F.max("own").alias("near")).join(shuffled(rank), "x").select("x", "own", F.greatest("own", "near").alias("one"))
        best2 = both.join(shuffled(best1.select(F.col("x").alias("_y"), "one")), F.col("y") == F.col("_y")).groupBy("x").agg(F.max("one").alias("two")).join(shuffled(best1), "x")
        centres = best2.where("own >= one and own >= two").select(F.col("x").alias("c"))
        members = both.join(shuffled(centres), F.col("x") == F.col("c")).select(F.col("y").alias("id"), F.col("c").alias("group")).unionByName(centres.select(F.col("c").alias("id"), F.col("c").alias("group")))
        members = stage(members, "star")
        parts.append(members)
        gone = members.select(F.col("id").alias("_g"))
        rest = both.join(shuffled(gone), F.col("x") == F.col("_g"), "left_anti").join(shuffled(gone), F.col("y") == F.col("_g"), "left_anti")
        after = stage(rest, "edges")
        unstage(both)
        both = after
        if len(parts) >= 32:  # plans stay short
            whole = stage(reduce(lambda p, q: p.unionByName(q), parts), "star")
            for p in parts:
                unstage(p)
            parts = [whole]
    parts.append(finished(both.withColumn("root", F.lit(0))))
    unstage(both)
    return reduce(lambda p, q: p.unionByName(q), parts)


#: What decides between copies, most first.
QUALITY_ORDER = ("score", "area", "sharpness", "bytes_per_pixel", "file_size")


def rank_quality(items: DataFrame, group: str = "group", order: str = "file", min_gap: float = MIN_GAP) -> DataFrame:
    """Adds rank, best (the first of the group), gap and action: keep, remove from a gap of min_gap on, or review.
    Rows without a group keep."""
    w = Window.partitionBy(group).orderBy(*[F.desc(c) for c in QUALITY_ORDER], order)
    cols = ("score", "area", "sharpness", "bytes_per_pixel", "has_alpha", "format")
    out = items.where(F.col(group).isNotNull()).withColumns({"rank": F.row_number().over(w), "best": F.first(F.struct(order, *cols)).over(w)})
    alone = items.where(F.col(group).isNull()).withColumns({"rank": F.lit(1), "best": F.struct(order, *cols)})
    out = out.unionByName(alone).withColumn("gap", F.round(F.col("best.score") - F.col("score"), 1))
    return out.withColumn("action", F.when(F.col("rank") == 1, "keep").when(F.col("gap") >= min_gap, "remove").otherwise("review"))


def quality_reason(ranked: DataFrame) -> DataFrame:
    """Adds reason: why a row ranks below its group's best, from what rank_quality() adds."""
    best = lambda c: F.col(f"best.{c}")
    why = (
        F.when(F.col("score").isNull() | best("score").isNull(), "no_quality")
        .when(F.col("rank") == 1, "best_in_group")
        .when(F.col("gap") < MIN_GAP, "small_gap")
        .when(best("area") > 1.08 * F.col("area"), "lower_resolution")
        .when(best("sharpness") > 1.18 * F.col("sharpness"), "less_sharp")
        .when(best("bytes_per_pixel") > 1.25 * F.col("bytes_per_pixel"), "more_compressed")
        .when(best("has_alpha") & ~F.col("has_alpha"), "missing_alpha")
        .when(best("format") != F.col("format"), "lower_format")
        .otherwise("lower_overall")
    )
    return ranked.withColumn("reason", why)


def dedup_report(items: DataFrame, groups: DataFrame, edges: DataFrame, id: str = "id") -> tuple[DataFrame, DataFrame]:
    """(per item: id, group, similarity; totals: group_count, duplicate_count). Empty inputs give zero totals."""
    sim = max_similarity(items, edges, groups, id).select(F.col(id).alias("_s"), "similarity")
    out = items.join(shuffled(groups.select(F.col("id").alias("_g"), "group")), F.col(id) == F.col("_g"), "left").join(shuffled(sim), F.col(id) == F.col("_s"), "left").select(id, "group", "similarity")
    return out, out.agg(F.countDistinct("group").alias("group_count"), F.count("group").alias("duplicate_count"))


def cleanup(items: DataFrame, strategy: str, group: str = "group", order: str = "pos") -> DataFrame:
    """What stays: quality drops action remove; first keeps each group's first row and all rows without a group."""
    if strategy == "quality":
        return items.where(F.coalesce(F.col("action"), F.lit("")) != "remove")
    if strategy != "first":
        raise ValueError(f"unknown strategy {strategy}")
    first = items.where(F.col(group).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(order))).where("_n = 1").drop("_n")
    return first.unionByName(items.where(F.col(group).isNull()))


def order_by_group(items: DataFrame, group: str = "group", order: str = "pos", rejected: str | None = None) -> DataFrame:
    """Rejected rows first if that column is given; then by group, rows without one last."""
    first = [F.col(rejected).desc()] if rejected else []
    return items.orderBy(*first, F.col(group).asc_nulls_last(), order)


def place_by_group(items: DataFrame, group: str = "group", order: str = "pos", rejected: str | None = None) -> DataFrame:
    """Adds place: the row's place in order_by_group(), which should not tie."""
    first = [~F.col(rejected)] if rejected else []
    return with_position(items, [*first, F.col(group).isNull(), F.col(group), F.col(order)], "place")
