"""Posts of image sites: one schema, filters, a resume ledger and numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from easel.plans.staging import stage

SAFE = ("s", "safe", "general", "g")



def score_value(raw: Column) -> Column:
    """A score given as a number or as an object with a total; anything else is 0."""
    plain, total = F.get_json_object(raw, "$.score"), F.get_json_object(raw, "$.score.total")
    return F.coalesce(total.try_cast("double").cast("bigint"), plain.try_cast("double").cast("bigint"), F.lit(0))


_FIELDS = ("id", "file_url", "original_url", "large_file_url", "jpeg_url", "sample_url", "preview_url", "preview_file_url", "artist_name", "tag_string_artist", "artist", "author", "owner", "tag_string", "tags", "rating", "score")


def normalize_posts(posts: DataFrame, raw: str = "raw", kind: str = "site_kind") -> DataFrame:
    """Adds id, url, artist, tags, score and rating from three JSON layouts.

    danbooru: the artist is artist_name or the first of tag_string_artist. Others: artist, author or owner. The
    URL is the original or the largest there is; // gets https. Spaces part tags, and _ in them is a space.
    """
    dan = F.col(kind) == "danbooru"
    # one parse for all fields; what is no text comes as its JSON
    posts = posts.withColumn("_p", F.from_json(F.col(raw), ", ".join(f"`{f}` string" for f in _FIELDS)))
    some = lambda *names: F.coalesce(*[F.nullif(F.col(f"_p.{n}"), F.lit("")) for n in names])
    url = some(*_FIELDS[1:8])
    artist = F.when(dan, F.coalesce(some("artist_name"), F.nullif(F.split_part(F.coalesce(some("tag_string_artist"), F.lit("")), F.lit(" "), F.lit(1)), F.lit("")))).otherwise(some("artist", "author", "owner"))
    tags = F.filter(F.split(F.coalesce(some("tag_string", "tags"), F.lit("")), r"\s+"), lambda t: t != "")
    score = F.col("_p.score")
    total = F.when(score.startswith("{"), F.get_json_object(score, "$.total")).otherwise(score)
    return posts.withColumns({
        "id": F.coalesce(some("id"), F.lit("")),
        "url": F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(F.coalesce(url, F.lit(""))),
        "artist": F.coalesce(artist, F.lit("unknown")),
        "tags": F.array_join(F.transform(tags, lambda t: F.replace(t, F.lit("_"), F.lit(" "))), ","),
        "score": F.coalesce(total.try_cast("double").cast("bigint"), F.lit(0)),
        "rating": F.lower(F.coalesce(some("rating"), F.lit(""))),
    }).drop("_p")


def rating_allowed(rating: Column, mode: str) -> Column:
    """safe takes the safe ratings, nsfw all others and blanks, any other mode everything."""
    safe = F.lower(F.coalesce(rating, F.lit(""))).isin(*SAFE)
    return safe if mode == "safe" else ~safe if mode == "nsfw" else F.lit(True)


def filter_posts(posts: DataFrame, ledger: DataFrame | None = None, min_score: int = 0, filter_ai: bool = False, rating: str = "all", order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """Posts with an id and URL, not in the ledger, of an allowed rating and score; the first of each id."""
    ok = (F.coalesce(F.col("id"), F.lit("")) != "") & (F.coalesce(F.col("url"), F.lit("")) != "") & (F.col("score") >= min_score) & rating_allowed(F.col("rating"), rating)
    if filter_ai:
        ok = ok & ~F.lower(F.coalesce(F.col("tags"), F.lit(""))).contains("ai generated")
    out = posts.where(ok)
    if ledger is not None:
        out = out.join(ledger.select(F.col("id").alias("_done")).distinct(), F.col("id") == F.col("_done"), "left_anti")
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where("_n = 1").drop("_n")


def accept_up_to(posts: DataFrame, limit: int, ledger: DataFrame | None = None, order: tuple[str, ...] = ("page", "pos", "id")) -> DataFrame:
    """The first posts in order, up to limit less what the ledger has."""
    done = ledger.select("id").distinct().count() if ledger is not None else 0
    from .tags import with_position

    return with_position(posts, order, "_place").where(F.col("_place") < max(0, limit - done)).drop("_place")


def artist_sequence(posts: DataFrame, order: tuple[str, ...] = ("page", "pos", "id")) -> DataFrame:
    """Adds file_name: the artist, made safe, a running number of four digits for the artist, the URL's extension. Posts
    are counted by ranges of the whole order, so an artist of many posts is no one task's work."""
    from easel.functions.names import sanitize

    from .tags import with_position

    placed = stage(with_position(posts, ["artist", *order], "_at"), "artists")
    starts = placed.groupBy(F.col("artist").alias("_artist")).agg(F.min("_at").alias("_start"))
    posts = placed.join(starts, F.col("artist").eqNullSafe(F.col("_artist"))).withColumn("_n", F.col("_at") - F.col("_start") + 1)
    n = F.col("_n").cast("string")
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("url", r"(\.[A-Za-z0-9]+)(?:[?#].*)?$", 1)), F.lit("")), F.lit(".jpg"))
    number = F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
    return posts.withColumn("file_name", F.concat(sanitize(F.concat(F.col("artist"), F.lit("_"), number)), ext)).drop("_at", "_artist", "_start", "_n")


def expand_pages(posts: DataFrame, id: str = "id", url: str = "url", count: str = "page_count", animated: str = "animated", keep_animated: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pages, skipped): a row for each page of a work, _p0 in its URL numbered; animated works are skipped with a
    reason, or one archive."""
    still, moving = posts.where(~F.coalesce(F.col(animated), F.lit(False))), posts.where(F.coalesce(F.col(animated), F.lit(False)))
    pages = still.withColumn("page_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.coalesce(F.col(count), F.lit(1))) - 1)))
    no = F.col("page_no").cast("string")
    pages = pages.withColumns({"key": F.concat(F.col(id).cast("string"), F.lit("_p"), no), "page_url": F.replace(F.col(url), F.lit("_p0"), F.concat(F.lit("_p"), no))})
    if keep_animated:
        pages = pages.unionByName(moving.withColumns({"page_no": F.lit(0), "key": F.concat(F.col(id).cast("string"), F.lit("_ugoira")), "page_url": F.col(url)}))
        return pages, moving.limit(0).withColumn("reason", F.lit("animated"))
    return pages, moving.withColumn("reason", F.lit("animated"))


def page_slice(ids: DataFrame, start: int, end: int, size: int = 48, limit: int | None = None, id: str = "id") -> DataFrame:
    """Distinct ids, largest number first, of pages start to end (from 1) of `size`, at most limit. Ids that aren't
    numbers are left out. The slice has (end - start + 1) * size rows at most."""
    top = ids.select(F.col(id).try_cast("bigint").alias("id")).where("id is not null").distinct().orderBy(F.col("id").desc()).limit(end * size)
    n = F.row_number().over(Window.orderBy(F.col("id").desc()))
    out = top.withColumn("_n", n).where(F.col("_n") > (start - 1) * size)
    return (out.where(F.col("_n") <= (start - 1) * size + limit) if limit is not None else out).drop("_n")


def first_seen(ids: DataFrame, limit: int, id: str = "id", pos: str = "pos") -> DataFrame:
    """Distinct ids in the order in which they are first seen, at most limit."""
    return ids.groupBy(id).agg(F.min(pos).alias("first_pos")).orderBy("first_pos", id).limit(limit)


def bookmark_count(raw: Column, names: tuple[str, ...] = ("bookmark_count", "bookmarkCount", "total_bookmarks", "bookmarks", "favorites")) -> Column:
    """The first alias that is a number, or an object with total or count; null when none is."""
    found = [F.get_json_object(raw, f"$.{n}{p}").try_cast("bigint") for n in names for p in ("", ".total", ".count")]
    return F.coalesce(*found)


def min_bookmarks(posts: DataFrame, least: int, raw: str = "raw") -> DataFrame:
    """Posts with at least so many bookmarks, or of which no number is known."""
    n = bookmark_count(F.col(raw))
    return posts.where(n.isNull() | (n >= least))


def skip_reason_counts(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    return skipped.groupBy(F.coalesce(F.col(reason), F.lit("other")).alias("reason")).agg(F.count("*").alias("n"))


def not_done(items: DataFrame, ledger: DataFrame, id: str = "id") -> DataFrame:
    """Items whose id isn't in the ledger; a null id is never done."""
    return items.join(ledger.select(F.col("id").alias("_done")).distinct(), F.col(id).cast("string") == F.col("_done"), "left_anti")


def advance_ledger(ledger: DataFrame, results: DataFrame, id: str = "id", ok: str = "ok") -> DataFrame:
    """The ledger with the ids that succeeded, once each."""
    return ledger.select("id").unionByName(results.where(F.col(ok)).select(F.col(id).cast("string").alias("id"))).where("id is not null").distinct()
