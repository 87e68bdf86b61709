"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets come from water-filling over one row per source. Equal-token blocks are seats: sources, then the
shards of each source, get integer quotas by highest quotients v / (2k + 1). A shard's blocks are picked by
a seeded affine walk over block numbers, which is a bijection, so exactly the quota is taken without ranking
rows. Shards hold a bounded number of words, so a source with a third of all words is many groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from easel.operators.tags import with_position

from .shared import SPACE, fresh, stage

#: Shards that get their quotas in one window.
BUNCH = 4096
#: Primes above any number of blocks in a shard: steps of such a size, modulo that number, visit each block once.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")).cast("long")


def source_targets(sources: DataFrame, weights=(5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """Adds target to (source, source_size): shares by weight of all words, at most max_repeat times a size.

    Resharing the excess by weight raises all uncapped sources in proportion to their weights, so each target
    is min(cap, level * weight) with one level for all. Sources in order of cap / weight reach their caps
    first; the level is where what is left, over the weights left, no longer reaches the next cap.
    Sources go in code point order with null last, so weights repeat in that order. One row a source.
    """
    by_code = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    s = sources.withColumn("rank", F.row_number().over(by_code))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("weight", w).withColumn("cap", (max_repeat * F.col("source_size")).cast("double"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy("rank")
    s = s.withColumn("total", F.sum("source_size").over(everything).cast("double")).withColumn("all_weight", F.sum("weight").over(everything))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(filling), F.lit(0.0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(filling), F.lit(0.0))))
    # the level is that of the first source that it does not fill: later ones are no higher, earlier ones do not fit
    s = s.withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    s = s.withColumn("found", F.max(F.when(F.col("fits"), F.col("level"))).over(everything))
    return s.withColumn("target", F.least("cap", F.coalesce(F.col("found") * F.col("weight"), F.col("cap")))).select("source", "rank", "source_size", "target")


def sainte_lague(parties: DataFrame, key: list[str], order: list[str], votes: str, seats: str) -> DataFrame:
    """Adds quota: of `seats` seats (a column, equal within key) by highest quotients votes / (2k + 1).

    Any divisor that deals out M seats to n parties gives each between v(M - n/2)/V - 1/2 and v(M + n/2)/V + 1/2,
    so the lower bound is granted and only the few quotients between the bounds compete. Ties go by `order`. Key and order columns hold no nulls.
    """
    whole = Window.partitionBy(*key)
    p = parties.withColumns({"_V": F.sum(votes).over(whole).cast("double"), "_n": F.count("*").over(whole)})
    edge = lambda sign: F.col(votes) * (F.col(seats) + sign * F.col("_n") / 2) / F.col("_V")
    some = F.col("_V") > 0
    p = p.withColumn("_low", F.when(some, F.greatest(F.lit(0), F.ceil(edge(-1) - 0.5) - 1)).otherwise(F.lit(0)).cast("long"))
    p = p.withColumn("_high", F.when(some, F.greatest(F.col("_low"), F.floor(edge(1) + 0.5) + 1)).otherwise(F.col("_low")).cast("long"))
    p = p.withColumn("_left", F.col(seats) - F.sum("_low").over(whole))
    rivals = p.where((F.col("_high") > F.col("_low")) & (F.col(votes) > 0)).select(*key, *order, "_left", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)).alias("_k"), F.col(votes).alias("_v"))
    ranked = rivals.withColumn("_r", F.row_number().over(whole.orderBy((F.col("_v") / (2 * F.col("_k") + 1)).desc(), *order, "_k")))
    won = ranked.where("_r <= _left").groupBy(*key, *order).agg(F.count("*").alias("_won"))
    joined = p.join(won, list(dict.fromkeys([*key, *order])), "left")
    return joined.select(*parties.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def _numbered_copies(narrow: DataFrame, shard_words: int) -> DataFrame:
    """Adds _lot: 0, but where equal rows have more words than a shard they are counted off in lots of a shard's words,
    so that they can go to many shards."""
    same = ["source", "doc_id", "_mix", "size"]
    hot = narrow.groupBy(*same).agg(F.count("*").alias("_n")).where(F.col("_n") * F.col("size") > shard_words)
    hot = stage(hot.select(*[F.col(c).alias(f"_h{i}") for i, c in enumerate(same)]), "mix-hot")
    is_hot = lambda df: [df[c].eqNullSafe(hot[f"_h{i}"]) for i, c in enumerate(same)]
    few = narrow.join(hot, is_hot(narrow), "left_anti").withColumn("_lot", F.lit(0).cast("long"))
    placed = with_position(narrow.join(hot, is_hot(narrow), "left_semi"), [*same, "_row"], "_at")
    first = placed.groupBy(*same).agg(F.min("_at").alias("_first")).select("_first", *[F.col(c).alias(f"_f{i}") for i, c in enumerate(same)])
    found = placed.join(first, [placed[c].eqNullSafe(first[f"_f{i}"]) for i, c in enumerate(same)])
    lot = F.expr(f"(_at - _first) div greatest(1, {shard_words} div greatest(1, size))")
    return few.unionByName(found.select(*narrow.columns, lot.cast("long").alias("_lot")))


def _doc_plan(docs: DataFrame, doc_id: str, text: str, source: str, weights, max_repeat: int, seed: int, block: int, shard_words: int, row: str | None = None) -> DataFrame:
    """Per row: size, source_size, target, and what is needed to say which of its words are taken; _row is the column
    row, or a number made here."""
    own = F.col(row) if row else F.monotonically_increasing_id()
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("_mix"), own.alias("_row"))
    narrow = stage(narrow, "mix-sizes")
    targets = source_targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    seats = targets.withColumn("one", F.lit(1)).withColumn("seats", F.round(F.sum("target").over(Window.partitionBy("one")) / block).cast("long"))
    targets = stage(sainte_lague(seats, ["one"], ["rank"], "target", "seats").withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long")).drop("one", "seats"), "mix-targets")
    numbered = _numbered_copies(narrow, shard_words)
    with_source = numbered.join(targets.select(F.col("source").alias("_s"), "rank", "source_size", "target", "n_shards"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    with_source = with_source.withColumn("shard", F.pmod(F.when(F.col("_lot") == 0, F.col("_mix")).otherwise(F.xxhash64("_mix", "_lot")), F.col("n_shards")))
    shards = with_source.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size")).withColumn("bunch", F.expr(f"shard div {BUNCH}"))
    shards = stage(shards, "mix-shards")
    bunches = shards.groupBy("rank", "bunch").agg(F.sum("shard_size").alias("bunch_size")).join(targets.select("rank", F.col("quota").alias("seats")), "rank")
    bunches = sainte_lague(bunches, ["rank"], ["bunch"], "bunch_size", "seats").select("rank", "bunch", F.col("quota").alias("seats"))
    quotas = sainte_lague(shards.join(bunches, ["rank", "bunch"]), ["rank", "bunch"], ["shard"], "shard_size", "seats")
    quotas = stage(quotas.select("rank", "shard", "shard_size", "quota"), "mix-quotas")
    placed = with_source.withColumn("start", F.sum("size").over(Window.partitionBy("rank", "shard").orderBy("_mix", "doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)))
    placed = placed.withColumn("start", F.coalesce("start", F.lit(0))).join(quotas, ["rank", "shard"])
    n = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / block)).cast("long")
    placed = placed.withColumn("n_blocks", n).withColumn("seats", F.least(F.col("quota"), max_repeat * F.col("n_blocks")))
    return placed.withColumns({
        "passes": F.expr("seats div n_blocks"),
        "extra": F.expr("seats % n_blocks"),
        "offset": F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), F.col("n_blocks")),
        "step": _step(F.col("n_blocks"), F.xxhash64(F.lit(seed + 1), "rank", "shard")),
    })


def _step(n: Column, mix: Column) -> Column:
    """A seeded step out of those that aren't next to 0 modulo n; 1 where there is none."""
    some = F.filter(F.array(*[F.pmod(F.lit(p), n) for p in STEPS]), lambda r: (r > 1) & (r < n - 1))
    return F.when(F.size(some) > 0, F.get(some, F.pmod(mix, F.greatest(F.size(some), F.lit(1))).cast("int"))).otherwise(F.lit(1)).cast("long")


def _chosen(block: int) -> Column:
    """The blocks that touch this row and are in the shard's last, partial pass."""
    touching = F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))
    walk = lambda j: F.pmod(j * F.col("step") + F.col("offset"), F.col("n_blocks")) < F.col("extra")
    return F.when((F.col("size") > 0) & (F.col("extra") > 0), F.filter(touching, walk)).otherwise(F.array().cast("array<bigint>"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=(5, 2, 1), max_repeat: int = 3, seed: int = 17, block: int = 16, shard_words: int = 1_000_000) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) for each row.

    A null text has size 0 and takes nothing. Null is a source of its own, last in order. A null id is an id as any
    other. Repeated rows take each by themselves; which of those equal in id, text and source takes what may change, not
    what is taken. Equal rows with more words than a shard go to many. A long text is part of one shard, which it makes
    as large as it needs. An empty table gives an empty result. Other columns of docs aren't read. Windows go over one
    row a source, over up to 4,096 shards (a million words each) or as many bunches of them, and over a shard's rows.
    """
    p = _doc_plan(docs, doc_id, text, source, weights, max_repeat, seed, block, shard_words)
    part = F.aggregate(_chosen(block), F.lit(0).cast("long"), lambda s, j: s + F.least((j + 1) * block, F.col("start") + F.col("size")) - F.greatest(j * block, F.col("start")))
    return p.select("doc_id", "size", "source_size", "target", (F.col("passes") * F.col("size") + part).alias("taken"), "source")


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", n_chars: str = "n_chars", weights=(5, 2, 1), max_repeat: int = 3, seed: int = 17, block: int = 16, shard_words: int = 1_000_000) -> DataFrame:
    """The mix itself, with the columns of docs, of any names: one row for each full pass over a document, and one with
    the words of its chosen blocks, space-joined, for the partial pass. Documents that take nothing have no row. Each row
    takes by a plan of its own, whatever ids, texts and sources repeat: rows are numbered in a table written first. An
    empty table stays empty. Very long texts are rows as any; their chosen words are cut out in one value.
    """
    own, passes, spans, copy = (fresh(x) for x in ("row", "passes", "spans", "copy"))
    numbered = stage(docs.withColumn(own, F.monotonically_increasing_id()), "mix-rows")
    p = _doc_plan(numbered, doc_id, text, source, weights, max_repeat, seed, block, shard_words, own)
    parts = F.transform(_chosen(block), lambda j: F.struct((F.greatest(j * block, F.col("start")) - F.col("start")).alias("at"), (F.least((j + 1) * block, F.col("start") + F.col("size")) - F.greatest(j * block, F.col("start"))).alias("n")))
    some = p.withColumn("_parts", parts).where("size > 0 and (passes > 0 or size(_parts) > 0)")
    plan = some.select(F.col("_row").alias(own), F.col("passes").cast("int").alias(passes), F.col("_parts").alias(spans))
    words = F.filter(F.split(F.col(text), SPACE + "+"), lambda w: w != "")
    both = numbered.join(plan, own)
    # the words are one value that the inner function uses, so that they are split once for a row
    part = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(spans, lambda s: F.slice(w, (s["at"] + 1).cast("int"), s["n"].cast("int")))), " "))[0]
    given = [F.col(f"`{c}`") for c in docs.columns]
    full = both.where(F.col(passes) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(passes)))).select(*given)
    partial = both.where(F.size(spans) > 0).withColumn(text, part)
    if n_chars in docs.columns:
        partial = partial.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return full.unionByName(partial.select(*given))
