"""Queries for rasters, duplicates and clusters over the embeddings and part tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from easel.functions import rasters as R
from easel.functions.rasters import unit_centered
from easel.operators import duplicates as D

from .staging import stage
from .tables import images, table, with_images

QUERIES, ORACLE = {}, {}
THRESHOLD = 20


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE[name or f.__name__] = sql
        return f

    return keep


def _rasters(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")
    return v.withColumn("rows", R.to_rows(F.col("v"), 8))


def signatures(spark, d):
    """Sign bits as a 64-bit hash, the DCT hash, and the centred unit vector as a histogram."""
    return _rasters(spark, d).select(F.col("vec_id").alias("id"), F.array(R.sign_bits(F.col("v"))).alias("hash"), F.array(R.cosine_hash(R.dct_low(F.col("rows"), 8, 8))).alias("phash"), R.unit_centered(F.col("v")).alias("unit"), "label")


_V = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings)"
_SIGN = "s as (select vec_id, label, list_transform(e, lambda x: case when x > 0 then 1 else 0 end) b, e from v)"
_DIST = "list_sum(list_transform(list_zip(l.b, r.b), lambda z: abs(z[1] - z[2])))"
_EDGES = f"{_V}, {_SIGN}, edges as (select l.vec_id a, r.vec_id b, {_DIST}::int dist, 1 - {_DIST} / 64 sim from s l join s r on l.vec_id < r.vec_id where {_DIST} <= {THRESHOLD})"
_ME = lambda i: f"e[{i}]"
_BITS = lambda cond, n: " + ".join(f"(case when {cond(i)} then {1 << i}::hugeint else 0 end)" for i in range(n))


def _signed(x: str) -> str:
    return f"(case when {x} >= 9223372036854775808::hugeint then {x} - 18446744073709551616::hugeint else {x} end)::bigint"


@query(f"with {_V} select vec_id, ({_BITS(lambda i: f'e[{i // 7 * 8 + i % 7 + 2}] > e[{i // 7 * 8 + i % 7 + 1}]', 56)})::bigint dhash from v")
def f1_dhash(spark, d):
    return _rasters(spark, d).select("vec_id", R.row_differences(F.col("rows")).alias("dhash"))


_B8 = R.dct_basis(8, 8)
_COEF = ", ".join("(" + " + ".join(f"{_B8[k // 8][i] * _B8[k % 8][j]!r}::double * e[{i * 8 + j + 1}]" for i in range(8) for j in range(8)) + ")" for k in range(64))


@query(f"with {_V}, c as (select vec_id, [{_COEF}] c from v), m as (select vec_id, c, list_median(c) m from c), t as (select vec_id, {_BITS(lambda i: f'c[{i + 1}] > m', 64)} t from m) select vec_id, {_signed('t')} phash from t")
def f2_phash(spark, d):
    return _rasters(spark, d).select("vec_id", R.cosine_hash(R.dct_low(F.col("rows"), 8, 8)).alias("phash"))


@query(f"""with {_V}, n as (select vec_id, list_transform(range(16), lambda b: len(list_filter(e, lambda x: cast(floor((x + 0.5) / (1.0::double / 16)) as int) = b))::double) n from v),
 s as (select *, sqrt(list_sum(list_transform(n, lambda x: x * x))) s from n) select vec_id, list_transform(n, lambda x: case when s > 0 then x / s else x end) hist from s""")
def f3_histogram(spark, d):
    return _rasters(spark, d).select("vec_id", R.histogram(F.col("v"), -0.5, 0.5, 16).alias("hist"))


@query(f"with {_V} select vec_id, list_transform(range(64), lambda i: e[(i // 8 * 8 + 7 - i % 8)::int + 1]) flat from v")
def f8_mirror(spark, d):
    return _rasters(spark, d).select("vec_id", F.flatten(R.mirror(F.col("rows"))).alias("flat"))


@query(f"with {_V} select vec_id, list_transform(range(12), lambda i: e[(((vec_id % 4) + i // 3) * 8 + 2 + i % 3)::int + 1]) flat from v")
def f9_crop_pixels(spark, d):
    return _rasters(spark, d).select("vec_id", F.flatten(R.crop(F.col("rows"), F.lit(2), (F.col("vec_id") % 4).cast("int"), F.lit(3), F.lit(4))).alias("flat"))


def _pairs(spark, d):
    v = _rasters(spark, d).select("vec_id", "v")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


_NEXT = f"{_V}, p as (select l.vec_id, l.e v, r.e w from v l join v r on r.vec_id = l.vec_id + 1)"


@query(f"with {_NEXT} select vec_id, 10 * log10(1 / (list_sum(list_transform(list_zip(v, w), lambda z: pow(greatest(0, least(1, z[1])) - greatest(0, least(1, z[2])), 2))) / 64 + 0.000001::double)) psnr from p")
def f15_psnr(spark, d):
    return _pairs(spark, d).select("vec_id", R.psnr(F.col("v"), F.col("w")).alias("psnr"))


@query(f"with {_NEXT}, c as (select vec_id, len(list_filter(list_zip(v, w), lambda z: z[1] >= 0.1 and z[2] >= 0.1)) i, len(list_filter(list_zip(v, w), lambda z: z[1] >= 0.1 or z[2] >= 0.1)) u from p) select vec_id, case when u = 0 then 1.0::double else i / u end jaccard from c")
def f16_jaccard(spark, d):
    return _pairs(spark, d).select("vec_id", R.jaccard(F.col("v"), F.col("w"), 0.1).alias("jaccard"))


@query(f"with {_EDGES} select a, b, dist, sim from edges")
def d1_hamming_pairs(spark, d):
    return D.hamming_pairs(signatures(spark, d), THRESHOLD)


_LEVELS = (0.1, -0.12, 0.15, -0.2)


@query(f"""with {_V}, s as (select vec_id, flatten([{", ".join(f"list_transform(e, lambda x: case when x > {t!r}::double then 1 else 0 end)" for t in _LEVELS)}]) b from v)
 select l.vec_id a, r.vec_id b, {_DIST}::int dist, 1 - {_DIST} / 256 sim from s l join s r on l.vec_id < r.vec_id where {_DIST} <= 40""")
def d1_hamming_pairs_256(spark, d):
    """Four longs a row, as the grid hashes have, at 40 of 256 bits."""
    v = _rasters(spark, d)
    above = lambda t: F.transform("v", lambda x: x - F.lit(t))
    words = [R.sign_bits(above(t)) for t in _LEVELS]
    return D.hamming_pairs(v.select(F.col("vec_id").alias("id"), F.array(*words).alias("hash")), 40, words=4)


@query(f"""with {_EDGES}, c as (select vec_id, [{_COEF}] c from v), m as (select vec_id, c, list_median(c) m from c), p as (select vec_id, list_transform(c, lambda x: case when x > m then 1 else 0 end) b from m)
 select e.a, e.b, e.dist from edges e join p l on l.vec_id = e.a join p r on r.vec_id = e.b where {_DIST} <= 30""")
def d2_verify_hash(spark, d):
    return D.verify_hash(D.hamming_pairs(signatures(spark, d), THRESHOLD, keep=("phash",)), 30).select("a", "b", "dist")


@query(f"""with {_EDGES}, u as (select vec_id, list_transform(e, lambda x: x - list_avg(e)) c from v)
 select e.a, e.b, e.dist from edges e join u l on l.vec_id = e.a join u r on r.vec_id = e.b where list_dot_product(l.c, r.c) / (sqrt(list_dot_product(l.c, l.c)) * sqrt(list_dot_product(r.c, r.c))) >= 0.3""")
def d3_hist_correlation(spark, d):
    return D.verify_histogram(D.hamming_pairs(signatures(spark, d), THRESHOLD, keep=("unit",)), 0.3).select("a", "b", "dist")


_CORNERS = """h as (select file, width w, height h, 1.0 + (file % 7) * 0.1 a, (file % 5) * 0.2 - 0.4 b, (file % 3) * 0.3 c, (file % 11) * 0.25 d from images),
 q as (select *, (file % 4) * 0.0002 g from h), k as (select file, w, h, list_transform([[0, 0], [w, 0], [w, h], [0, h]], lambda p: [(a * p[1] + b * p[2] + 5) / (g * p[1] + 1), (c * p[1] + d * p[2] + 3) / (g * p[1] + 1)]::double[]) p from q),
 t as (select *, list_transform([1, 2, 3, 4], lambda i: (p[i % 4 + 1][1] - p[i][1]) * (p[(i + 1) % 4 + 1][2] - p[i % 4 + 1][2]) - (p[i % 4 + 1][2] - p[i][2]) * (p[(i + 1) % 4 + 1][1] - p[i % 4 + 1][1])) turn,
 abs(list_sum(list_transform([1, 2, 3, 4], lambda i: p[i][1] * p[i % 4 + 1][2] - p[i % 4 + 1][1] * p[i][2]))) / 2 / (w * h) share from k)"""


@query(with_images("select 1").replace(" select 1", "") + f", {_CORNERS} select file, coalesce(list_min(turn) > 0 and share >= 0.1 and share <= 10, false) valid from t")
def d6_valid_homography(spark, d):
    f = F.col("file")
    lit = lambda x: F.lit(float(x))
    h = F.array(lit(1) + (f % 7) * lit(0.1), (f % 5) * lit(0.2) - lit(0.4), lit(5), (f % 3) * lit(0.3), (f % 11) * lit(0.25), lit(3), (f % 4) * lit(0.0002), lit(0), lit(1))
    return images(spark, d).select("file", D.valid_homography(h, F.col("width"), F.col("height")).alias("valid"))


@query(f"with {_EDGES}, n as (select a id, sim from edges union all select b, sim from edges) select v.vec_id id, case when count(n.sim) > 0 and v.vec_id % 2 = 0 then round(max(n.sim) * 100, 1) end similarity from v left join n on n.id = v.vec_id group by v.vec_id")
def d7_max_similarity(spark, d):
    e = D.hamming_pairs(signatures(spark, d), THRESHOLD)
    ends = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct().where("id % 2 = 0").withColumn("group", F.lit(0))
    return D.max_similarity(signatures(spark, d).select("id"), e, ends)


@query(f"with recursive {_EDGES}, n as (select a x, b y from edges union select b, a from edges), r as (select x id, x reach from n union select r.id, n.y from r join n on n.x = r.reach) select id, min(reach) component from r group by id")
def d8_components(spark, d):
    return D.connected_components(D.hamming_pairs(signatures(spark, d), THRESHOLD))


@query(f"""with recursive {_EDGES}, n as materialized (select a x, b y from edges union select b, a from edges),
 walk(step, gone, c, m) as (select 0, []::bigint[], null::bigint, []::bigint[] union all select step + 1, list_concat(gone, m2), c2, m2 from (select w.step, w.gone, p.c c2, list_prepend(p.c, p.m) m2 from walk w,
 lateral (select x c, list(y) m from n where not list_contains(w.gone, x) and not list_contains(w.gone, y) group by x order by count(*) desc, x limit 1) p)) select unnest(m) id, c "group" from walk where c is not null""")
def d9_star_groups(spark, d):
    return D.star_groups(D.hamming_pairs(signatures(spark, d), THRESHOLD))


def _ranked(spark, d):
    from easel.functions.geometry import quality_score

    q = quality_score(images(spark, d)).withColumn("area", F.col("width").cast("long") * F.col("height"))
    return D.quality_reason(D.rank_quality(q, "grp", "file"))


_RANKED = """q as (select *, width::bigint * height area, file_size / (width::double * height) bytes_per_pixel from images),
 s as (select *, round(38 * greatest(0, least(1, ln(1 + area::double) / ln(1 + 16777216.0::double))) + 30 * greatest(0, least(1, ln(1 + sharpness) / ln(1201.0::double))) + 12 * greatest(0, least(1, contrast / 80)) + 10 * greatest(0, least(1, bytes_per_pixel / 0.8))
 + 8 * (case format when 'png' then 1.0 when 'webp' then 0.94 when 'jpg' then 0.84 when 'bmp' then 0.8 else 0.76 end)::double + (case when has_alpha then 2.0 else 0.0 end)::double, 1) score from q),
 w as (select *, row_number() over g rank, first_value(score) over g bs, first_value(area) over g ba, first_value(sharpness) over g bh, first_value(bytes_per_pixel) over g bb, first_value(has_alpha) over g bal, first_value(format) over g bf from s
 window g as (partition by grp, case when grp is null then file end order by score desc, area desc, sharpness desc, bytes_per_pixel desc, file_size desc, file)),
 a as (select *, round(bs - score, 1) gap, case when rank = 1 then 'keep' when round(bs - score, 1) >= 6 then 'remove' else 'review' end action from w)"""


@query(with_images("select 1").replace(" select 1", "") + f", {_RANKED} select file, rank, gap, action from a")
def d10_rank_quality(spark, d):
    return _ranked(spark, d).select("file", "rank", "gap", "action")


@query(with_images("select 1").replace(" select 1", "") + f""", {_RANKED} select file, case when rank = 1 then 'best_in_group' when gap < 6 then 'small_gap' when ba > 1.08::double * area then 'lower_resolution' when bh > 1.18::double * sharpness then 'less_sharp'
 when bb > 1.25::double * bytes_per_pixel then 'more_compressed' when bal and not has_alpha then 'missing_alpha' when bf != format then 'lower_format' else 'lower_overall' end reason from a""")
def d11_quality_reason(spark, d):
    return _ranked(spark, d).select("file", "reason")


@query(f"with recursive {_EDGES}, n as (select a x, b y, sim from edges union select b, a, sim from edges), r as (select x id, x reach from n union select r.id, n.y from r join n on n.x = r.reach), c as (select id, min(reach) component from r group by id), m as (select x, max(sim) s from n group by x) select v.vec_id id, component \"group\", round(s * 100, 1) similarity from v left join c on c.id = v.vec_id left join m on m.x = v.vec_id")
def d12_dedup_report(spark, d):
    s = signatures(spark, d)
    e = D.hamming_pairs(s, THRESHOLD)
    return D.dedup_report(s.select("id"), D.connected_components(e).withColumnRenamed("component", "group"), e)[0]


@query(with_images("select file from images where grp is null union all select min(file) from images where grp is not null group by grp"))
def d13_cleanup_first(spark, d):
    return D.cleanup(images(spark, d), "first", "grp").select("file")


@query(with_images("select 1").replace(" select 1", "") + f", {_RANKED} select file from a where action != 'remove'")
def d13_cleanup_quality(spark, d):
    return D.cleanup(_ranked(spark, d), "quality").select("file")


@query(with_images("select file, grp, row_number() over (order by grp nulls last, pos) - 1 place from images"))
def d14_order_by_group(spark, d):
    return D.place_by_group(images(spark, d), "grp").select("file", "grp", "place")


def saved_again(images):
    """The images, and a slightly blurred, noisy copy of every third one, numbered from a million million on."""
    from easel.operators import image_jobs as J

    copies = J.blur_noise(images.where("cast(file as long) % 3 = 0"), 0.4, 2.0)
    return images.unionByName(copies.withColumn("file", (F.col("file").cast("long") + 10**12).cast("string")))


def flagship(spark, d):
    """Signatures of images without their margins, every third image being there twice, blurred and noisy the second time:
    pairs by the difference hash, verified by the cosine hash and the hue histogram, in star groups with the similarity of
    each member and what to do about it."""
    from easel.operators import image_jobs as J

    from .pixel_queries import framed

    s = J.signatures(saved_again(framed(spark, d))).select(F.col("file").cast("long").alias("id"), F.col("dhash").alias("hash"), "phash", F.col("hist").alias("unit"))
    s = stage(s.withColumn("unit", unit_centered(F.col("unit"))), "signatures")
    e = D.hamming_pairs(s, 40, words=4, keep=("phash", "unit"))
    e = stage(D.verify_histogram(D.verify_hash(e, 40, 4), 0.5).select("a", "b", "sim"), "verified")
    groups = D.star_groups(e)
    return D.dedup_report(s.select("id"), groups, e)[0].withColumn("action", F.when(F.col("group").isNull() | (F.col("group") == F.col("id")), "keep").otherwise("review"))


QUERIES["flagship_dedup"] = flagship
