"""URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and the canonical image type of each; fixed values.
TYPES = {"jpg": "jpg", "jpeg": "jpg", "png": "png", "webp": "webp", "gif": "gif", "bmp": "bmp", "tif": "tiff", "tiff": "tiff", "avif": "avif"}
#: Entities that links hold, in the order in which they are decoded; fixed values.
ENTITIES = (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"))


def _decoded(col: Column) -> Column:
    out = F.trim(col, F.lit(" \t\r\n\f"))
    for entity, plain in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return out


def _without_dots(path: Column) -> Column:
    """A path with its . and .. segments resolved; .. at the top is dropped."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        F.filter(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p != "."),
        F.array().cast("array<string>"),
        lambda s, p: F.when(p != "..", F.concat(s, F.array(p))).otherwise(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))),
    )
    # a path that ends in a dot segment ends in a slash
    return F.concat(F.lit("/"), F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/"))


def normalize_url(link: Column, base: Column) -> Column:
    """An absolute http(s) URL without fragment, or null: entities decoded, relative links resolved against base.

    Empty, data:, blob:, javascript: and other schemes give null, as does a relative link on a base that isn't http(s).
    """
    u = F.regexp_replace(_decoded(link), "#.*$", "")
    origin = F.regexp_extract(base, r"^(?i:(https?)://[^/?#]+)", 0)
    scheme = F.regexp_extract(base, r"^(?i:(https?):)", 0)
    base_path = F.regexp_extract(base, r"^(?i:https?)://[^/?#]+([^?#]*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(base_path, r"^/(.*/)?", 1))
    base_query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    path, query = F.regexp_extract(u, r"^[^?]*", 0), F.regexp_extract(u, r"^[^?]*(\?.*)?$", 1)
    absolute = F.concat(F.regexp_extract(u, r"^(?i:https?)://[^/?]+", 0), _without_dots(F.regexp_replace(F.regexp_extract(u, r"^(?i:https?)://[^/?]+([^?]*)", 1), "^$", "/")), query)
    resolved = (
        F.when(u.rlike(r"^(?i:https?)://[^/?]"), absolute)
        .when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(origin == "", F.lit(None))
        .when(u.startswith("//"), F.concat(scheme, u))
        .when(u.startswith("/"), F.concat(origin, _without_dots(path), query))
        .when(u.startswith("?"), F.concat(origin, F.when(base_path == "", F.lit("/")).otherwise(base_path), u))
        .when(u == "", F.concat(origin, F.when(base_path == "", F.lit("/")).otherwise(base_path), base_query))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), query))
    )
    return F.when((_decoded(link) == "") | link.isNull(), F.lit(None)).otherwise(resolved)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def image_type(url: Column) -> Column:
    """Canonical type by the path's extension; '' without one; null for an extension that isn't an image's."""
    ext = F.lower(F.regexp_extract(path_of(url), r"\.([^./]+)$", 1))
    known = F.lit(None).cast("string")
    for e, t in TYPES.items():
        known = F.when(ext == e, t).otherwise(known)
    return F.when(ext == "", "").otherwise(known)


def allowed_type(url: Column, types: list[str] | tuple = ()) -> Column:
    """No types allow all images; options are canonical too, so jpeg allows jpg. No extension is allowed."""
    wanted = sorted({TYPES.get(t.lower(), t.lower()) for t in types})
    t = image_type(url)
    ok = t.isNotNull() & ((t == "") | t.isin(wanted)) if wanted else t.isNotNull()
    return F.coalesce(ok, F.lit(False))


def candidate_id(source_idx: Column, url: Column) -> Column:
    """Source number and a digest of the whole URL."""
    return F.concat_ws("-", source_idx.cast("string"), F.sha2(url, 256))


def derive_filename(url: Column, content_type: Column) -> Column:
    """The decoded base name, made safe; with a known extension, else the content type's, else .jpg."""
    base = F.regexp_extract(path_of(url), r"([^/]*)$", 1)
    base = F.coalesce(F.try_url_decode(F.replace(base, F.lit("+"), F.lit("%2B"))), base)
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r'[<>:"/\\|?*\x00-\x1f]', "_"), r"\s+", " "), r"^[. _]+|[. _]+$", "")
    safe = F.coalesce(F.nullif(safe, F.lit("")), F.lit("image"))
    ext = F.lower(F.regexp_extract(safe, r"\.([^.]+)$", 1))
    sent = F.lower(F.regexp_extract(content_type, r"^\s*image/([A-Za-z0-9.+-]+)", 1))
    by_type = F.lit(None).cast("string")
    for e, t in TYPES.items():
        by_type = F.when(sent == e, t).otherwise(by_type)
    return F.when(ext.isin(list(TYPES)), safe).otherwise(F.concat(safe, F.lit("."), F.coalesce(by_type, F.lit("jpg"))))


def host_of(url: Column) -> Column:
    """The host without a leading www., else 'unknown'."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit("")), F.lit("unknown"))
