"""Queries for pages, URLs and posts."""

from __future__ import annotations

from pyspark.sql import functions as F

from easel.functions import urls as U
from easel.operators import collect as C
from easel.operators import posts as P

from .tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


#: All links of the pages, in order: their HTML has a@href and no images.
_HREFS = r"""hrefs as (select page_id, url, pos, regexp_extract(tag, '\shref\s*=\s*"([^"]*)"', 1) link from
 (select page_id, url, unnest(l) tag, generate_subscripts(l, 1) pos from (select page_id, url, regexp_extract_all(html, '(?is)<a\b[^>]*>') l from pages)) where regexp_matches(tag, '\shref\s*=\s*"[^"]+"')),
 plain as (select *, regexp_replace(replace(replace(replace(replace(replace(trim(link, ' 	'), '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '#.*$', '') u, regexp_extract(url, '^https?://[^/?#]+') origin from hrefs),
 found as (select *, case when regexp_matches(u, '^https?://[^/?]+$') then concat(u, '/') when regexp_matches(u, '^https?://') then u when regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*:') then null when starts_with(u, '/') then concat(origin, u) when starts_with(u, '?') then concat(regexp_replace(url, '[?#].*$', ''), u) when u = '' then regexp_replace(url, '#.*$', '')
   else concat(origin, '/', regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', ''), '^/(.*/)?', 1), u) end abs from plain)"""


def _hrefs(spark, d):
    return C.links(table(spark, d, "pages"), "a", ("href",))


@query(f"with {_HREFS} select page_id, pos - 1 pos, abs from found")
def c1_normalize_url(spark, d):
    return _hrefs(spark, d).select("page_id", "pos", U.normalize_url(F.col("link"), F.col("url")).alias("abs"))


@query(f"""with {_HREFS}, one as (select page_id, abs, min(pos) pos from found where abs is not null group by 1, 2)
 select page_id, abs url, 'page' kind, rank from (select *, row_number() over (partition by page_id order by pos) rank from one) where rank <= 120""")
def c2_extract_candidates(spark, d):
    return C.extract_candidates(table(spark, d, "pages"), _hrefs(spark, d), image_only=False)


def _image_pages(spark, d):
    """Pages of their own host with images of all kinds of tags, named after the page and the length of its text."""
    i = F.col("page_id").cast("string")
    n = F.length("html").cast("string")
    html = F.concat(
        F.lit('<IMG src="/img/'), i, F.lit('.png" data-src="/img/'), n, F.lit('.jpg#x"><source srcset="/s/'), i, F.lit('.webp 1x, /s/'), i, F.lit('-2.webp 2x"><img src="/img/'), i,
        F.lit('.png"><meta property="og:image" content="https://h.test/e'), (F.col("page_id") % 7).cast("string"), F.lit('.png"><link rel="icon" href="/f.gif"><p style="background:url(\'/g/'), n, F.lit('.gif\')"></p> https://h.test/h'), i, F.lit('.bmp <a href="/no.png">x</a>'),
    )
    return table(spark, d, "pages").select("page_id", "url", html.alias("html"))


_IMAGES = """i as (select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) h, page_id::varchar i, length(html)::varchar n from pages),
 c as (select page_id, unnest([{u: concat(h, '/img/', i, '.png'), k: 'page', r: 1}, {u: concat(h, '/img/', n, '.jpg'), k: 'page', r: 2}, {u: concat(h, '/s/', i, '.webp'), k: 'page', r: 3}, {u: concat(h, '/s/', i, '-2.webp'), k: 'page', r: 4},
 {u: concat('https://h.test/e', page_id % 7, '.png'), k: 'meta', r: 5}, {u: concat(h, '/f.gif'), k: 'link', r: 6}, {u: concat(h, '/g/', n, '.gif'), k: 'style', r: 7}, {u: concat('https://h.test/h', i, '.bmp'), k: 'inline', r: 8}]) c from i)"""


@query(f"with {_IMAGES} select page_id, c.u url, c.k kind, c.r rank from c")
def c2_image_candidates(spark, d):
    return C.extract_candidates(_image_pages(spark, d))


@query(f"with {_IMAGES} select page_id, url, kind, rank from (select page_id, c.u url, c.k kind, c.r rank, row_number() over (partition by c.u order by page_id, c.r) o from c) where o = 1")
def c4_scan_image_sources(spark, d):
    return C.scan_sources(C.extract_candidates(_image_pages(spark, d)))


@query("select page_id, case when page_id % 3 = 0 then concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), '/a', page_id, '.png') when page_id % 3 = 1 then url else concat('ftp:', page_id) end url, case page_id % 3 when 0 then 'direct' when 1 then 'expand' else 'invalid' end kind, case when page_id % 3 = 2 then 'invalid source' end error from pages where page_id % 3 != 1 or not regexp_matches(lower(url), '\\.(png|jpe?g|webp|gif|bmp|tiff?|avif)$')")
def c4_direct_sources(spark, d):
    """Sources of three sorts by page: an image's URL, the page's own, and no URL; pages that are images are left out."""
    i = F.col("page_id")
    host = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    s = table(spark, d, "pages").where(~((i % 3 == 1) & F.lower("url").rlike(r"\.(png|jpe?g|webp|gif|bmp|tiff?|avif)$")))
    s = s.select("page_id", F.when(i % 3 == 0, F.concat(host, F.lit("/a"), i.cast("string"), F.lit(".png"))).when(i % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("ftp:"), i.cast("string"))).alias("url"))
    direct, pages, invalid = C.direct_sources(s)
    none = F.lit(None).cast("string").alias("error")
    return direct.select("page_id", "url", "kind", none).unionByName(pages.select("page_id", "url", F.lit("expand").alias("kind"), none)).unionByName(invalid.select("page_id", "url", F.lit("invalid").alias("kind"), "error"))


@query(r"""with t as (select page_id, url, lower(regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '\.([^./]+)$', 1)) e from pages),
 c as (select *, case when e = '' then '' when e in ('jpg', 'jpeg') then 'jpg' when e in ('tif', 'tiff') then 'tiff' when e in ('png', 'webp', 'gif', 'bmp', 'avif') then e end image_type from t)
 select page_id, image_type, image_type is not null and image_type in ('', 'jpg', 'png') allowed from c""")
def c3_image_type(spark, d):
    return table(spark, d, "pages").select("page_id", U.image_type(F.col("url")).alias("image_type"), U.allowed_type(F.col("url"), ["jpeg", "png"]).alias("allowed"))


@query(f"""with {_HREFS}, one as (select page_id, abs, min(pos) pos from found where abs is not null group by 1, 2),
 ranked as (select *, row_number() over (partition by page_id order by pos) rank from one)
 select page_id, abs url, 'page' kind, rank from (select *, row_number() over (partition by abs order by page_id, rank) n from ranked where rank <= 120) where n = 1""")
def c4_scan_sources(spark, d):
    return C.scan_sources(C.extract_candidates(table(spark, d, "pages"), _hrefs(spark, d), image_only=False))


@query("select page_id, concat(page_id, '-', sha256(url)) id from pages")
def c5_candidate_id(spark, d):
    return table(spark, d, "pages").select("page_id", U.candidate_id(F.col("page_id"), F.col("url")).alias("id"))


@query(r"""with b as (select page_id, regexp_extract(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) base from pages),
 s as (select page_id, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(url_decode(base), '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '^[. _]+|[. _]+$', '', 'g'), ''), 'image') safe from b)
 select page_id, case when lower(regexp_extract(safe, '\.([^.]+)$', 1)) in ('jpg','jpeg','png','webp','gif','bmp','tif','tiff','avif') then safe else concat(safe, '.', case page_id % 3 when 0 then 'png' when 1 then 'tiff' else 'jpg' end) end filename from s""")
def c6_derive_filename(spark, d):
    sent = F.element_at(F.array(F.lit("image/png; q=1"), F.lit("image/tif"), F.lit("text/html")), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", U.derive_filename(F.col("url"), sent).alias("filename"))


@query("select doc_id, lang, source from documents where contains(lower(coalesce(text, '')), 'license') or contains(lower(coalesce(source, '')), 'license')")
def c7_search(spark, d):
    return C.search(table(spark, d, "documents"), " License ", ["text", "source"]).select("doc_id", "lang", "source")


@query(r"select page_id, coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\.', ''), ''), 'unknown') host from pages")
def c8_host_of(spark, d):
    return table(spark, d, "pages").select("page_id", U.host_of(F.col("url")).alias("host"))


@query("""select e.event_id id, coalesce(r.filename, concat('old', e.event_id)) filename, coalesce(r.error, null) error, case when r.ok then 'saved' when not r.ok then 'failed' else 'ready' end status from events e left join
 (select event_id id, event_type != 'error' ok, case when event_type != 'error' then concat('f', event_id) end filename, case when event_type = 'error' then 'bad' end error from events where event_id % 3 != 0) r on r.id = e.event_id""")
def c9_attach_results(spark, d):
    e = table(spark, d, "events")
    c = e.select(F.col("event_id").alias("id"), F.concat(F.lit("old"), F.col("event_id")).alias("filename"), F.lit(None).cast("string").alias("error"), F.lit("ready").alias("status"))
    ok = F.col("event_type") != "error"
    r = e.where("event_id % 3 != 0").select(F.col("event_id").alias("id"), ok.alias("ok"), F.when(ok, F.concat(F.lit("f"), F.col("event_id"))).alias("filename"), F.when(~ok, "bad").alias("error"))
    return C.attach_results(c, r)


_POSTS = """posts as (select cast(event_id as varchar) id, concat('https://h.test/', event_id, '_p0.png') url, concat('u', user_id % 50) artist, cast(trunc("value") as bigint) score, event_type rating, case when event_id % 9 = 0 then 'a,AI generated' else 'a b,c' end tags, cast(event_id // 40 as int) page, cast(event_id % 40 as int) pos from events)"""


def _posts(spark, d):
    return table(spark, d, "events").selectExpr("cast(event_id as string) id", "concat('https://h.test/', event_id, '_p0.png') url", "concat('u', user_id % 50) artist", "cast(value as bigint) score", "event_type rating", "case when event_id % 9 = 0 then 'a,AI generated' else 'a b,c' end tags", "cast(event_id div 40 as int) page", "cast(event_id % 40 as int) pos")


def _ledger(spark, d):
    return table(spark, d, "events").where("event_id % 4 = 0").selectExpr("cast(event_id as string) id")


@query("""select event_id, cast(event_id as varchar) id, case event_id % 3 when 0 then concat('https://h.test/', event_id, '.png') when 1 then concat('http://x/l', event_id) else '' end url, case event_id % 3 when 0 then concat('z', user_id) when 1 then concat('w', user_id) else 'unknown' end artist, case event_id % 3 when 2 then '' else 'a b,c' end tags, cast(case event_id % 3 when 0 then json_extract_string(props, '$.k')::bigint when 1 then user_id else 0 end as bigint) score, case event_id % 3 when 0 then event_type else '' end rating from events""")
def p1_normalize_posts(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("event_id").alias("id"), F.concat(F.lit("//h.test/"), F.col("event_id"), F.lit(".png")).alias("file_url"), F.lit("a_b c").alias("tag_string"), F.concat(F.lit("z"), F.col("user_id"), F.lit(" y")).alias("tag_string_artist"), F.struct(F.get_json_object("props", "$.k").cast("int").alias("total")).alias("score"), F.col("event_type").alias("rating"))))
    raw = raw.when(F.col("event_id") % 3 == 1, F.to_json(F.struct(F.col("event_id").alias("id"), F.concat(F.lit("http://x/l"), F.col("event_id")).alias("sample_url"), F.lit("a_b c").alias("tags"), F.concat(F.lit("w"), F.col("user_id")).alias("author"), F.col("user_id").alias("score"))))
    raw = raw.otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.lit("none").alias("score"))))
    kind = F.when(F.col("event_id") % 3 == 0, "danbooru").otherwise("other")
    return P.normalize_posts(table(spark, d, "events").withColumns({"raw": raw, "site_kind": kind})).select("event_id", "id", "url", "artist", "tags", "score", "rating")


@query("select event_id, cast(case when event_id % 3 = 0 then json_extract_string(props, '$.k')::bigint when event_id % 3 = 1 then user_id else 0 end as bigint) score from events")
def p2_score_value(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"score":{"total":'), F.get_json_object("props", "$.k"), F.lit("}}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"score":'), F.col("user_id"), F.lit("}"))).otherwise('{"score":"?"}')
    return table(spark, d, "events").select("event_id", P.score_value(raw).alias("score"))


@query("select event_id, case event_id % 5 when 0 then true when 1 then true else false end safe, not case event_id % 5 when 0 then true when 1 then true else false end nsfw from events")
def p3_rating_allowed(spark, d):
    r = F.element_at(F.array(F.lit("S"), F.lit("general"), F.lit("q"), F.lit(""), F.lit(None)), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", P.rating_allowed(r, "safe").alias("safe"), P.rating_allowed(r, "nsfw").alias("nsfw"))


@query(f"with {_POSTS} select id, artist, score from posts where cast(id as bigint) % 4 != 0 and score >= 10 and not contains(lower(tags), 'ai generated') and rating not in ('s', 'safe', 'general', 'g')")
def p4_filter_posts(spark, d):
    twice = _posts(spark, d).unionByName(_posts(spark, d).withColumn("page", F.col("page") + 1000000))
    return P.filter_posts(twice, _ledger(spark, d), 10, True, "nsfw").select("id", "artist", "score")


@query(f"with {_POSTS} select id, page, pos from posts order by page, pos, id limit (select greatest(0, 3 * (select count(*) from events) // 4 - count(*)) from posts where cast(id as bigint) % 4 = 0)")
def p5_accept_up_to(spark, d):
    posts = _posts(spark, d)
    return P.accept_up_to(posts, 3 * posts.count() // 4, _ledger(spark, d)).select("id", "page", "pos")


@query(f"with {_POSTS} select id, concat(artist, '_', lpad(cast(n as varchar), cast(greatest(4, length(cast(n as varchar))) as int), '0'), '.png') file_name from (select *, row_number() over (partition by artist order by page, pos, id) n from posts)")
def p6_artist_sequence(spark, d):
    return P.artist_sequence(_posts(spark, d)).select("id", "file_name")


@query("""select concat(event_id, '_p', n) "key", concat('https://h.test/', event_id, '_p', n, '.png') page_url from (select event_id, unnest(range(greatest(1, json_extract_string(props, '$.k')::int % 4))) n from events where event_type != 'error')""")
def p7_expand_pages(spark, d):
    e = table(spark, d, "events").selectExpr("event_id id", "concat('https://h.test/', event_id, '_p0.png') url", "cast(get_json_object(props, '$.k') as int) % 4 page_count", "event_type = 'error' animated")
    return P.expand_pages(e)[0].select("key", "page_url")


@query("select distinct user_id id from events order by user_id desc limit 96 offset 48")
def p8_page_slice(spark, d):
    return P.page_slice(table(spark, d, "events").select(F.col("user_id").cast("string").alias("id")), 2, 3)


@query("select user_id id, min(event_id) first_pos from events group by 1 order by 2, 1 limit 100")
def p8_first_seen(spark, d):
    return P.first_seen(table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("pos")), 100)


@query("select event_id from events where event_id % 3 = 2 or json_extract_string(props, '$.k')::int >= 50")
def p9_min_bookmarks(spark, d):
    k = F.get_json_object("props", "$.k")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"bookmarkCount":'), k, F.lit("}"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"favorites":{"count":'), k, F.lit("}}"))).otherwise('{"bookmarks":"many"}')
    return P.min_bookmarks(table(spark, d, "events").withColumn("raw", raw), 50).select("event_id")


@query("select coalesce(case when event_type = 'view' then null else event_type end, 'other') reason, count(*) n from events group by 1")
def p10_skip_reason_counts(spark, d):
    return P.skip_reason_counts(table(spark, d, "events").select(F.nullif("event_type", F.lit("view")).alias("reason")))


@query("select cast(event_id as varchar) id from events where event_id % 4 = 0 or (event_id % 4 != 0 and event_type != 'error')")
def p11_resume_ledger(spark, d):
    todo = P.not_done(table(spark, d, "events").selectExpr("event_id id", "event_type != 'error' ok"), _ledger(spark, d))
    return P.advance_ledger(_ledger(spark, d), todo)
