"""Source divergence audit: term distributions of sources against each other, by a partitioned cube.

Counts of terms by (language, source) are summed before the shuffle. The comparison of all sources of a language over all
its terms is a cube with three sides: sources, sources, terms. It is cut along each into blocks; a task owns one cell, two
blocks of sources and one of terms, and gets the slices of counts of both blocks. Partial divergences of a cell are exact
integers, so they are added up along the terms in any order. Terms that neither block has in a cell cost nothing there:
how many of them there are is all that counts, which the last step adds.
"""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import map_batches, stage

SCALE = 1_000_000_000
#: Letters stay, A to Z lower-cased; other ASCII parts terms, and bytes from 0x80 on are letters all.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(_LETTERS).split(b" ")


def count_terms(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): how often a group has a term, and in how many of its rows. Summed by batch first."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))

    def counted(cols: dict) -> dict:
        n, docs_ = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
        for group, t in zip(zip(cols["lang"].to_pylist(), cols["source"].to_pylist()), cols["text"]):
            found = terms_of(t.as_py())
            n[group].update(found)
            docs_[group].update(set(found))
        out: list[list] = [[], [], [], [], []]
        for group, own in n.items():
            own.pop(b"", None)
            own = own or {None: 0}  # a group without terms has a row as well
            for o, c in zip(out, ([group[0]] * len(own), [group[1]] * len(own), list(own), list(own.values()), [docs_[group][t] if t is not None else 0 for t in own])):
                o += c
        return {"lang": pa.array(out[0], pa.string()), "source": pa.array(out[1], pa.string()), "term": pa.array(out[2], pa.binary()), "n": pa.array(out[3], pa.int64()), "docs": pa.array(out[4], pa.int64())}

    each = map_batches(rows, counted, "lang string, source string, term binary, n long, docs long", "text", 8 << 20)
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), in decimals, so that no count overflows."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(F.lit(SCALE)) * wide(count + 1), wide(total + terms)) + 1


def shares(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """The same over an array, by long division in base 1000: exact for totals up to 9e15."""
    left, out = count + 1, np.zeros_like(count)
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + left // (total + terms), left % (total + terms)
    return out + 1


def audit_sources(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, groups_a_block: int = 64, terms_a_block: int = 2048) -> DataFrame:
    """(lang, source, part, item, value, rank).

    A language keeps the terms of at least `least_docs` of its rows; every group of (lang, source) gives each of them a
    share p, counts plus one over all. Part `pair`: for each other source of the language, as item, the sum over all kept
    terms of floor((p - q)^2 / q), q the item's share. Part `term`: the `top` kept terms of the group with the largest such
    value among those that it has and of which p is above the language's own share q. Ranks start at 1 for each group and
    part, ties by the item's bytes. Null text, lang and source are empty. A group without terms is a group; where a
    language keeps no term, its pairs have 0. Equal rows count each. Very long texts are counted whole, one at a time. An
    empty table gives an empty result. Other columns aren't read. Values are exact while a sum stays below 2^63.
    """
    counts = stage(count_terms(docs, text, lang, source), "divergence-counts")
    # rows of one term are those of a language's sources, once each
    per_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"))
    kept = stage(per_term.where(F.col("docs") >= least_docs).select("lang", "term", "all"), "divergence-terms")
    langs = counts.select("lang").distinct().join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("all_total")), "lang", "left")
    langs = langs.select("lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all_total", F.lit(0)).alias("all_total"))
    of_term = kept.select(F.col("lang").alias("_lang"), F.col("term").alias("_term"), "all")
    own = stage(counts.join(of_term, (F.col("lang") == F.col("_lang")) & (F.col("term") == F.col("_term"))).select("lang", "source", "term", "n", "all"), "divergence-kept")
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # a row a source
    per_lang = Window.partitionBy("lang")
    groups = groups.select("lang", "source", number.alias("g"), F.coalesce("total", F.lit(0)).alias("total"), "terms", "all_total", F.ceil(F.count("*").over(per_lang) / groups_a_block).cast("int").alias("n_blocks"), F.greatest(F.lit(1), F.ceil(F.col("terms") / terms_a_block)).cast("int").alias("n_slices"))
    groups = stage(groups, "divergence-groups")

    # to its cells: with each block of sources, in ascending order, so that a cell has both directions
    block = F.expr(f"g div {groups_a_block}").cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("a"), F.greatest(b, F.col("block")).alias("b")))
    spread = lambda df: df.withColumn("block", block).withColumn("cell", F.explode(cells))
    slice_of = F.pmod(F.xxhash64(F.lit(29), "term"), F.col("n_slices")).cast("int")
    numbered = own.join(groups.select("lang", "source", "g", "n_blocks", "n_slices"), ["lang", "source"])
    filled = spread(numbered.withColumn("slice", slice_of)).select("lang", "cell.a", "cell.b", "slice", "g", F.xxhash64(F.lit(31), "term").alias("t1"), F.xxhash64(F.lit(37), "term").alias("t2"), "n", F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("terms"))
    heads = spread(groups.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n_slices") - 1)))).select("lang", "cell.a", "cell.b", "slice", "g", F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("t2"), F.lit(0).cast("long").alias("n"), "total", "terms")

    def compare(cell: pa.Table) -> pa.Table:
        """Sums over the terms that either block has here, for the pairs of the cell, both ways."""
        c = {k: cell[k].to_numpy() for k in ("g", "t1", "t2", "n")}
        head = cell["total"].is_valid().to_numpy()
        g = c["g"][head]
        o = np.argsort(g)
        g, total, terms = g[o], cell["total"].drop_null().to_numpy()[o], int(cell["terms"].to_numpy().max())
        pair = np.stack([c["t1"][~head], c["t2"][~head]], 1)
        known, at = np.unique(pair, axis=0, return_inverse=True) if len(pair) else (pair, np.zeros(0, np.int64))
        n = np.zeros((len(g), len(known)), np.int64)
        n[np.searchsorted(g, c["g"][~head]), at.ravel()] = c["n"][~head]
        a, b = cell["a"][0].as_py(), cell["b"][0].as_py()
        if not len(known):
            return pa.table([pa.array([], t) for t in (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())], names)
        p = np.stack([shares(row, int(t), terms) for row, t in zip(n, total)])
        left, right = np.flatnonzero(g // groups_a_block == a), np.flatnonzero(g // groups_a_block == b)
        x, y, v = [], [], []
        for i in left:
            # rows of the right block at a time, no more than a few million numbers
            for j in range(0, len(right), step := max(1, (1 << 22) // len(known))):
                q = p[right[j : j + step]]
                square = (p[i] - q) ** 2
                x += [g[i]] * len(q) + ([] if a == b else g[right[j : j + step]].tolist())
                y += g[right[j : j + step]].tolist() + ([] if a == b else [g[i]] * len(q))
                v += (square // q).sum(1).tolist() + ([] if a == b else (square // p[i]).sum(1).tolist())
        return pa.table([pa.array([cell["lang"][0].as_py()] * len(x)), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(v, pa.int64()), pa.array([len(known)] * len(x), pa.int64())], names)

    names = ["lang", "g", "other", "value", "seen"]
    partial = filled.unionByName(heads).groupBy("lang", "a", "b", "slice").applyInArrow(compare, "lang string, g int, other int, value long, seen long")
    sums = partial.where("g != other").groupBy("lang", "g", "other").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    mine = groups.select("lang", "g", "source", F.col("total"), "terms")
    theirs = groups.select(F.col("lang").alias("_lang"), F.col("g").alias("other"), F.col("source").alias("item"), F.col("total").alias("other_total"))
    pairs = mine.join(theirs, (F.col("lang") == F.col("_lang")) & (F.col("g") != F.col("other"))).drop("_lang").join(sums, ["lang", "g", "other"], "left")
    zero = F.lit(0).cast("long")
    some = F.greatest(F.col("terms"), F.lit(1))
    p0, q0 = share(zero, F.col("total"), some), share(zero, F.col("other_total"), some)
    f = lambda p, q: F.call_function("div", (p - q) * (p - q), q)
    rest = F.when(F.col("terms") > 0, (F.col("terms") - F.coalesce("seen", zero)) * f(p0, q0)).otherwise(zero)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", (F.coalesce("value", zero) + rest).cast("long").alias("value"))

    of_group = groups.select("lang", "source", "total", "terms", "all_total")
    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("all"), F.col("all_total"), F.col("terms"))
    worth = own.join(of_group, ["lang", "source"]).withColumns({"p": p, "q": q}).where("n > 0 and p > q")
    terms = worth.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), f(F.col("p"), F.col("q")).cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).cast("int")
    # Spark keeps the first `top` of a group in each task before it sends them on
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
