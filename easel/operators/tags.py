"""Tables of tags and captions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from easel.functions.tags import split_tags


def tag_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """(tag, n): occurrences over all rows, repeats within a row included."""
    return df.select(F.explode(split_tags(F.col(text))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def search_sort_tags(stats: DataFrame, keyword: str = "", by: str = "count", descending: bool = True) -> DataFrame:
    """Tags that hold the keyword, case aside, in order of name or count; equal counts by name."""
    k = keyword.strip().lower()
    out = stats.where(F.lower("tag").contains(k)) if k else stats
    key = F.col("n") if by == "count" else F.col("tag")
    return out.orderBy(key.desc() if descending else key.asc(), "tag")


def filter_by_tags(df: DataFrame, tags: Sequence[str], mode: str = "and", text: str = "text") -> DataFrame:
    """Rows with all (and), any (or) or none of the tags; no tags keep all rows."""
    if not tags:
        return df
    have, want = split_tags(F.col(text)), F.array(*[F.lit(t) for t in tags])
    conditions = {"and": F.size(F.array_except(want, have)) == 0, "or": F.arrays_overlap(want, have), "none": ~F.arrays_overlap(want, have)}
    return df.where(conditions[mode])


def edit(df: DataFrame, change, text: str = "text") -> DataFrame:
    """Applies change(column) and adds changed: whether the text differs now."""
    new = change(F.col(text))
    return df.withColumn("_new", new).withColumn("changed", ~F.col("_new").eqNullSafe(F.col(text))).withColumn(text, F.col("_new")).drop("_new")


def changed_rows(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that were changed; if none was, all with some text."""
    some = df.agg(F.coalesce(F.bool_or("changed"), F.lit(False)).alias("_any"))
    return df.crossJoin(F.broadcast(some)).where(F.when(F.col("_any"), F.col("changed")).otherwise(F.coalesce(F.trim(text), F.lit("")) != "")).drop("_any")


def target_rows(df: DataFrame, selected: DataFrame, key: str = "file") -> DataFrame:
    """The selected rows, or all where nothing is selected."""
    if selected.limit(1).count() == 0:
        return df
    return df.join(selected.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left_semi")


def skip_existing(df: DataFrame, captions: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Rows without a caption that isn't blank."""
    have = captions.where(F.coalesce(F.trim(text), F.lit("")) != "").select(F.col(key).alias("_k")).distinct()
    return df.join(have, F.col(key) == F.col("_k"), "left_anti")


def with_position(df: DataFrame, order: str | Sequence[Column | str], name: str = "_pos") -> DataFrame:
    """Adds the row's place in order, from 0, without one task for all rows: rows are counted by range, and the
    ranges' counts, a row each, give their starts. Null places come first, unless a column says otherwise; ties are
    broken by nothing, so the order should not repeat."""
    from easel.plans.staging import stage

    given = [order] if isinstance(order, str) else list(order)
    keys = [F.col(c) if isinstance(c, str) else c for c in given]
    # a column of the range's number; the order's own values are kept for the count within
    keep = {f"_o{i}": k for i, k in enumerate(keys)}
    by = [F.col(c).asc_nulls_first() for c in keep]
    ranged = stage(df.withColumns(keep).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return ranged.withColumn("_local", local).join(starts, "_part").withColumn(name, F.col("_start") + F.col("_local")).drop("_part", "_start", "_local", *keep)


def assign_round_robin(df: DataFrame, configs: Sequence[dict], order: str = "pos") -> DataFrame:
    """Adds config, error: row i gets usable config i mod n; without a usable one every row has an error. A config
    is usable if it has a name and a model."""
    usable = [c["name"] for c in configs if c.get("name") and c.get("model")]
    if not usable:
        return df.withColumns({"config": F.lit(None).cast("string"), "error": F.lit("no usable config")})
    at = (F.col("_pos") % len(usable) + 1).cast("int")
    return with_position(df, order).withColumns({"config": F.element_at(F.array(*[F.lit(c) for c in usable]), at), "error": F.lit(None).cast("string")}).drop("_pos")


def fill_cancelled(inputs: DataFrame, results: DataFrame, key: str = "file", cols: Sequence[str] = ("text",)) -> DataFrame:
    """A row for each input: its result, or ok false with the error 'cancelled'."""
    r = results.select(F.col(key).alias("_k"), "ok", "error", *cols)
    out = inputs.select(key).join(r, F.col(key) == F.col("_k"), "left")
    missing = F.col("_k").isNull()
    return out.select(key, F.coalesce("ok", F.lit(False)).alias("ok"), F.when(missing, "cancelled").otherwise(F.col("error")).alias("error"), *cols)
