"""File names of outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from easel.plans.staging import stage


def stem_of(name: Column) -> Column:
    """The base name without its last extension; a leading dot is part of the stem."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def dir_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def output_name(path: Column, suffix: str, ext: str | Column, out_dir: Column | None = None, always: bool = False) -> Column:
    """stem, then _suffix where the output goes to the source's own folder (or always), then the extension."""
    mark = F.lit(f"_{suffix}")
    if not always and out_dir is not None:
        mark = F.when(dir_of(path) == out_dir, mark).otherwise(F.lit(""))
    return F.concat(stem_of(path), mark, F.lit(ext) if isinstance(ext, str) else ext)


def sanitize(name: Column, most: int = 120, fallback: str = "file", collapse: bool = True) -> Column:
    """Reserved and control characters become _, white space single spaces; dots, spaces and _ at the ends go."""
    s = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f]', "_")
    if collapse:
        s = F.regexp_replace(s, r"\s+", " ")
    s = F.left(F.regexp_replace(s, r"^[. _]+|[. _]+$", ""), F.lit(most))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(fallback))


def parts_of(name: Column) -> tuple[Column, Column]:
    """(all before the last extension, the extension with its dot or an empty string)."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r".(\.[^.]*)$", 1)


def resolve_collisions(df: DataFrame, name: str = "name", order: str = "pos", existing: DataFrame | None = None, first: int = 1) -> DataFrame:
    """Adds unique_name: the first row of a name keeps it, others get _first, _first+1, .. before the extension.

    existing has a column of the same name with taken names: then also the first row is numbered. Numbers whose name is
    taken, or given to some row, are left out: the r-th row to be numbered gets the r-th free one. As a generated name
    tells its stem and number, names of two stems never meet, so numbers are free or not beforehand. A taken number t with
    i smaller ones has t - first - i free ones before it, so the r-th free number is first + r and as many as there are
    taken ones with r or fewer before them: a count along one order of rows and taken numbers, made by ranges, whatever
    the number of either. Null names stay null.
    """
    from easel.operators.tags import with_position

    given = df.where(F.col(name).isNotNull())
    placed = stage(with_position(given, [name, order], "_at"), "names")
    taken = existing.select(F.col(name).alias("_taken")).where("_taken is not null").distinct() if existing is not None else df.limit(0).select(F.col(name).alias("_taken"))
    start = placed.groupBy(F.col(name).alias("_name")).agg(F.min("_at").alias("_start"), F.count("*").alias("_rows"))
    start = start.join(taken, F.col("_name") == F.col("_taken"), "left").select("_name", (F.col("_start") + F.when(F.col("_taken").isNull(), 1).otherwise(0)).alias("_start"), F.col("_taken").isNull().alias("_keeps"), "_rows")
    start = stage(start, "stems")
    numbered = placed.join(start.drop("_rows", "_keeps"), F.col(name) == F.col("_name")).withColumn("_r", F.col("_at") - F.col("_start")).drop("_start", "_name")
    # numbers that are out of use, of names that have rows to number; longer ones are never reached
    full_stem, ext = parts_of(F.col("_used"))
    used = start.select(F.col("_name").alias("_used")).union(taken).distinct()
    used = used.select(F.concat(F.regexp_extract(full_stem, r"^(.+)_(?:0|[1-9][0-9]{0,17})$", 1), ext).alias("_of"), F.regexp_extract(full_stem, r"_([0-9]{1,18})$", 1).try_cast("long").alias("_k"), F.regexp_extract(full_stem, r"^(.+)_(?:0|[1-9][0-9]{0,17})$", 1).alias("_stem"))
    wanted = start.where(F.col("_rows") > F.col("_keeps").cast("int")).select("_name")
    used = used.where((F.col("_stem") != "") & (F.col("_k") >= first)).join(wanted, F.col("_of") == F.col("_name")).select("_name", "_k")
    ranked = with_position(used, ["_name", "_k"], "_i")
    lowest = ranked.groupBy(F.col("_name").alias("_n")).agg(F.min("_i").alias("_first"))
    ranked = ranked.join(lowest, F.col("_name") == F.col("_n")).select("_name", (F.col("_k") - first - (F.col("_i") - F.col("_first"))).alias("_r"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_at"), F.col("_k").alias("_tie"))
    rows = numbered.where("_r >= 0").select(F.col(name).alias("_name"), "_r", F.lit(1).alias("_kind"), "_at", F.col("_at").alias("_tie"))
    along = stage(with_position(ranked.unionByName(rows), ["_name", "_r", "_kind", "_tie"], "_u"), "numbers")
    lowest = along.groupBy(F.col("_name").alias("_n")).agg(F.min("_u").alias("_first"))
    free = along.where("_kind = 1").join(lowest, F.col("_name") == F.col("_n")).select(F.col("_at").alias("_row"), (F.lit(first) + F.col("_u") - F.col("_first")).alias("_number"))
    stem, ext = parts_of(F.col(name))
    pick = F.when(F.col("_number").isNull(), F.col(name)).otherwise(F.concat(stem, F.lit("_"), F.col("_number").cast("string"), ext))
    out = placed.join(free, F.col("_at") == F.col("_row"), "left").withColumn("unique_name", pick).drop("_at", "_row", "_number")
    return out.unionByName(df.where(F.col(name).isNull()).withColumn("unique_name", F.lit(None).cast("string")))
