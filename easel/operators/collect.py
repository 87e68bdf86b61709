"""Image candidates from tables of web pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from easel.functions import urls as U

#: Attributes of img and source that hold links, in order; fixed values.
IMAGE_ATTRIBUTES = ("src", "data-src", "data-original", "data-lazy-src", "data-url", "data-image")
SRCSETS = ("srcset", "data-srcset")
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag's text, or null."""
    pattern = rf"(?is)\s{name}{_VALUE}"
    found = F.concat(*[F.coalesce(F.regexp_extract(tag, pattern, k), F.lit("")) for k in (1, 2, 3)])
    return F.when(tag.rlike(pattern), found)


def _tags(pages: DataFrame, names: str, html: str) -> DataFrame:
    return pages.select("*", F.posexplode(F.regexp_extract_all(F.col(html), F.lit(rf"(?is)(<(?:{names})\b[^>]*>)"), F.lit(1))).alias("pos", "tag"))


def links(pages: DataFrame, tags: str, attrs: tuple[str, ...], srcsets: tuple[str, ...] = (), kind: str = "page", phase: int = 0, html: str = "html") -> DataFrame:
    """pages' columns, kind, phase, pos, attr_pos and link for each attribute of each tag, in the page's order."""
    found = [F.struct(F.lit(i).alias("attr_pos"), attribute(F.col("tag"), a).alias("link")) for i, a in enumerate(attrs)]
    out = _tags(pages, tags, html).withColumn("a", F.explode(F.array(*found)))
    out = out.select(*pages.columns, "pos", "a.attr_pos", "a.link")
    for k, s in enumerate(srcsets):
        parts = F.transform(F.split(attribute(F.col("tag"), s), ","), lambda x: F.regexp_extract(F.trim(x, F.lit(" \t\r\n")), r"^\S+", 0))
        more = _tags(pages, tags, html).select(*pages.columns, "pos", F.posexplode(parts).alias("k", "link"))
        out = out.unionByName(more.select(*pages.columns, "pos", (F.lit(len(attrs) + 1000 * k) + F.col("k")).alias("attr_pos"), "link"))
    return out.select(*pages.columns, F.lit(kind).alias("kind"), F.lit(phase).alias("phase"), "pos", "attr_pos", "link").where("link is not null and link != ''")


def _found(pages: DataFrame, pattern: str, kind: str, phase: int, html: str) -> DataFrame:
    hits = F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))
    return pages.select("*", F.posexplode(hits).alias("pos", "link")).select(*pages.columns, F.lit(kind).alias("kind"), F.lit(phase).alias("phase"), "pos", F.lit(0).alias("attr_pos"), "link")


def image_links(pages: DataFrame, include_srcset: bool = True, html: str = "html") -> DataFrame:
    """All links of a page that may be images, of five kinds: page, meta, link, style, inline."""
    out = links(pages, "img|source", IMAGE_ATTRIBUTES, SRCSETS if include_srcset else (), html=html)
    meta = _tags(pages, "meta", html).where(F.lower(F.concat_ws(" ", attribute(F.col("tag"), "property"), attribute(F.col("tag"), "name"))).contains("image"))
    link = _tags(pages, "link", html).where(
        (F.lower(F.coalesce(attribute(F.col("tag"), "as"), F.lit(""))) == "image") | F.lower(F.coalesce(attribute(F.col("tag"), "type"), F.lit(""))).startswith("image/") | F.lower(F.coalesce(attribute(F.col("tag"), "rel"), F.lit(""))).contains("icon")
    )
    for rows, name, kind, phase in ((meta, "content", "meta", 0), (link, "href", "link", 0)):
        rows = rows.select(*pages.columns, F.lit(kind).alias("kind"), F.lit(phase + 1 + (kind == "link")).alias("phase"), "pos", F.lit(0).alias("attr_pos"), attribute(F.col("tag"), name).alias("link"))
        out = out.unionByName(rows.where("link is not null"))
    style = _found(pages, r"""(?i)url\(\s*["']?([^"')]+)["']?\s*\)""", "style", 3, html).where(F.coalesce(U.image_type(F.concat(F.lit("http://h/"), F.regexp_replace("link", "[#].*$", ""))), F.lit("")) != "")
    inline = _found(pages, r"""(?i)(https?://[^\s"'<>()]+\.(?:png|jpe?g|webp|gif|bmp|tiff?|avif)(?:\?[^\s"'<>()]*)?)""", "inline", 4, html)
    return out.unionByName(style).unionByName(inline)


def extract_candidates(pages: DataFrame, found: DataFrame | None = None, types: tuple[str, ...] = (), max_per_source: int = 120, page_id: str = "page_id", url: str = "url", image_only: bool = True) -> DataFrame:
    """(page_id, url, kind, rank): normalised links in order of phase and place, the first of each URL a page, at
    most max_per_source (1 to 500) of them. found defaults to image_links(pages)."""
    found = image_links(pages) if found is None else found
    c = found.withColumn("_u", U.normalize_url(F.col("link"), F.col(url))).where("_u is not null")
    if image_only:
        c = c.where(U.allowed_type(F.col("_u"), types))
    order = [F.col(x) for x in ("phase", "pos", "attr_pos")]
    first = c.withColumn("_n", F.row_number().over(Window.partitionBy(page_id, "_u").orderBy(*order))).where("_n = 1")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(page_id).orderBy(*order)))
    return ranked.where(F.col("rank") <= max(1, min(500, max_per_source))).select(page_id, F.col("_u").alias("url"), "kind", "rank")


def scan_sources(candidates: DataFrame, order: tuple[str, ...] = ("page_id", "rank")) -> DataFrame:
    """The first candidate of each URL over all sources."""
    return candidates.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy(*order))).where("_n = 1").drop("_n")


def direct_sources(sources: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(direct images, pages to expand, invalid): by whether the URL is an image's, another http(s) URL, or neither."""
    ok = F.coalesce(F.col(url).rlike(r"^(?i:https?)://[^/?#\s]+"), F.lit(False))
    image = F.coalesce(U.image_type(F.col(url)), F.lit("")) != ""
    return sources.where(ok & image).withColumn("kind", F.lit("direct")), sources.where(ok & ~image), sources.where(~ok).withColumn("error", F.lit("invalid source"))


def search(df: DataFrame, keyword: str, cols: list[str]) -> DataFrame:
    """Rows where some column holds the keyword, case aside; an empty keyword keeps all."""
    k = keyword.strip().lower()
    return df.where(reduce(lambda a, b: a | b, [F.lower(F.coalesce(F.col(c), F.lit(""))).contains(k) for c in cols])) if k else df


def attach_results(candidates: DataFrame, results: DataFrame, key: str = "id", cols: tuple[str, ...] = ("filename", "error")) -> DataFrame:
    """Results joined to their candidates: status saved or failed, other columns where the result has a value."""
    r = results.select(F.col(key).alias("_k"), F.col("ok").alias("_ok"), *[F.col(c).alias(f"_{c}") for c in cols])
    out = candidates.join(r, F.col(key) == F.col("_k"), "left")
    new = {c: F.coalesce(f"_{c}", c) for c in cols} | {"status": F.when(F.col("_ok"), "saved").when(~F.col("_ok"), "failed").otherwise(F.col("status"))}
    return out.withColumns(new).drop("_k", "_ok", *[f"_{c}" for c in cols])
