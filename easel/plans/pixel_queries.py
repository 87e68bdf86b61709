"""Queries for pixel jobs, detections and sinks. Vectors become rasters of 64 bytes, a byte a component, or are framed()."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from easel.operators import boxes as B
from easel.operators import duplicates as D
from easel.operators import image_jobs as J
from easel.sources import images as S

from .ship import ship
from .staging import shared_dir
from .tables import images, table, with_images

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def rasters(spark, d, channels: int = 1):
    """(file, ok, error, height, width, channels, data) of the vectors: 8 x 8 grey, or 4 x 4 with transparency."""
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), ((x + 0.5) * 255).cast("int"))).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform("embedding", byte), ""))
    side = F.lit(8 if channels == 1 else 4)
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("file"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), side.alias("height"), side.alias("width"), F.lit(channels).alias("channels"), data.alias("data"))


def framed(spark, d, side: int = 96):
    """The vectors as side x side colour images: all 64 components, mixed over the inside of a flat frame whose width
    differs from image to image."""
    ship(spark)
    byte = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), ((x + 0.5) * 255).cast("int"))).cast("long")), 2, "0")
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("file"), (F.col("vec_id") % 5 * 5).cast("int").alias("frame"), F.unhex(F.array_join(F.transform("embedding", byte), "")).alias("own"))
    y, x = np.mgrid[:side, :side]
    mixed = np.stack([(y * (7 + k) + x * (3 + 2 * k) + x * y // 16) % 64 for k in range(3)], -1)

    def image(frame: int, own: bytes | None) -> bytes | None:
        if own is None or len(own) < 64:
            return None
        out, inside = np.full((side, side, 3), 0xE0, np.uint8), slice(max(0, frame), side - max(0, frame))
        out[inside, inside] = np.frombuffer(own, np.uint8)[mixed[inside, inside]]
        return out.tobytes()

    def draw(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                data = [image(*r) for r in zip(some.column("frame").to_pylist(), some.column("own").to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column("file"), pa.array(data, pa.binary())], ["file", "data"])

    drawn = rows.mapInArrow(draw, "file string, data binary")
    return drawn.select("file", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(3).alias("channels"), "data")


def _hex(df):
    return df.select("file", "ok", "error", "height", "width", F.hex("data").alias("pixels"))


_BYTES = "b as (select vec_id, list_transform(embedding, lambda x: greatest(0, least(255, cast(trunc((x::double + 0.5::double) * 255) as int)))) p from embeddings)"
_HEX = "array_to_string(list_transform({}, lambda v: printf('%02X', v::int)), '')"


@query()
def f1_image_signatures(spark, d):
    return J.signatures(framed(spark, d))


@query()
def f4_hsv_feature(spark, d):
    return J.color_features(framed(spark, d))


# framed() in SQL: g is the luma of each pixel, a the activity, both row by row; then the box of the content.
_E = lambda y, x: f"round_even(g[({y}) * 96 + {x} + 1], 0)"
_UP, _DOWN, _LEFT, _RIGHT = "abs(i // 96 - 1)", "(95 - abs(94 - i // 96))", "abs(i % 96 - 1)", "(95 - abs(94 - i % 96))"
_TONE = lambda k: f"(case when least(i // 96, i % 96) >= frame and greatest(i // 96, i % 96) < 96 - frame then p[((i // 96 * {7 + k} + i % 96 * {3 + 2 * k} + (i // 96) * (i % 96) // 16) % 64)::int + 1] else 224 end)"
_STRIPS = lambda at: f"list_transform(range(24), lambda s: list_sum(list_transform(range(384), lambda j: a[({at})::int + 1])) / 384)"
_BOX = f"""{_BYTES}, fr as (select vec_id, p, vec_id % 5 * 5 frame from b),
 lum as (select vec_id, list_transform(range(9216), lambda i: {_TONE(0)} * 0.114::double + {_TONE(1)} * 0.587::double + {_TONE(2)} * 0.299::double) g from fr),
 act as (select vec_id, g, list_transform(range(9216), lambda i: abs(2 * ({_E(_UP, _LEFT)} + {_E(_UP, _RIGHT)} + {_E(_DOWN, _LEFT)} + {_E(_DOWN, _RIGHT)}) - 8 * {_E("i // 96", "i % 96")})) a from lum),
 strips as (select vec_id, g, {_STRIPS("s * 384 + j")} rows, {_STRIPS("j // 4 * 96 + s * 4 + j % 4")} cols, greatest(list_sum(a) / 9216 / 4, 1) least_loud from act),
 loud as (select vec_id, g, list_filter(range(24), lambda s: rows[s::int + 1] > least_loud) r, list_filter(range(24), lambda s: cols[s::int + 1] > least_loud) c from strips),
 ends as (select vec_id, g, coalesce(list_min(r), 0) * 4 t, (coalesce(list_max(r), 23) + 1) * 4 b, coalesce(list_min(c), 0) * 4 l, (coalesce(list_max(c), 23) + 1) * 4 r from loud),
 cut as (select *, (b - t) * (r - l) / 9216::double between 0.25 and 0.9 and least(b - t, r - l) >= 32 trimmed from ends),
 box as (select vec_id, g, trimmed, case when trimmed then t else 0 end top, case when trimmed then b else 96 end bottom, case when trimmed then l else 0 end "left", case when trimmed then r else 96 end "right" from cut)"""
_IN = lambda y, x: f"part[({y}) * w + {x} + 1]"


@query(f'with {_BOX} select cast(vec_id as varchar) file, true ok, null error, 96 height, 96 width, top::int top, bottom::int bottom, "left"::int "left", "right"::int "right", trimmed from box')
def f5_content_box(spark, d):
    return J.content_box(J.activity(framed(spark, d))).drop("rows", "cols", "mean")


@query(f"""with {_BOX}, part as (select vec_id, bottom - top h, "right" - "left" w, list_transform(range((bottom - top) * ("right" - "left")), lambda i: g[(top + i // ("right" - "left")) * 96 + "left" + i % ("right" - "left") + 1]) part from box),
 lap as (select vec_id, part, list_transform(range(h * w), lambda i: {_IN("abs(i // w - 1)", "i % w")} + {_IN("h - 1 - abs(h - 2 - i // w)", "i % w")} + {_IN("i // w", "abs(i % w - 1)")} + {_IN("i // w", "w - 1 - abs(w - 2 - i % w)")} - 4 * part[i + 1]) l from part)
 select cast(vec_id as varchar) file, true ok, null error, round(list_var_pop(l), 3) sharpness, round(list_stddev_pop(part), 3) contrast, false has_alpha from lap""")
def f6_pixel_stats(spark, d):
    return J.pixel_stats(framed(spark, d)).withColumns({c: F.round(c, 3) for c in ("sharpness", "contrast")})


@query(f"with {_BYTES}, w as (select vec_id, p, list_transform(range(48), lambda i: p[(i // 3 * 4 + i % 3)::int + 1] * (p[(i // 3 * 4)::int + 4] / 255::double) + 255 * (1 - p[(i // 3 * 4)::int + 4] / 255::double)) v from b) select cast(vec_id as varchar) file, true ok, null error, 4 height, 4 width, {_HEX.format('list_transform(v, lambda x: round_even(x, 0))')} pixels from w")
def f7_flatten_alpha(spark, d):
    return _hex(J.flatten_alpha(rasters(spark, d, 4)))


_FILE = "cast(vec_id as varchar) file, true ok, null error"
_PIXELS = lambda n, at: _HEX.format(f"list_transform(range({n}), lambda i: {at})")


@query(f"with {_BYTES} select {_FILE}, 8 height, 8 width, {_PIXELS(64, 'p[(i // 8 * 8 + 7 - i % 8)::int + 1]')} pixels from b")
def f8_mirror_pixels(spark, d):
    return _hex(J.mirror(rasters(spark, d)))


@query(f"with {_BYTES} select {_FILE}, 8 height, 4 width, {_PIXELS(32, 'p[(i // 4 * 8 + 2 + i % 4)::int + 1]')} pixels from b")
def f9_center_crop_pixels(spark, d):
    return _hex(J.center_crop(rasters(spark, d), 1, 2))


@query(f"""with {_BYTES}, box as (select vec_id, p, 'left' name, 0 x1, vec_id % 5 y1, 3 x2, 8 y2 from b union all select vec_id, p, 'over', 6, 2, 20, vec_id % 3 + 3 from b union all select vec_id, p, 'none', 4, 4, 4, 6 from b where vec_id % 2 = 0),
 cut as (select *, least(x2, 8) - x1 w, least(y2, 8) - y1 h from box) select cast(vec_id as varchar) file, w > 0 and h > 0 ok, case when w <= 0 or h <= 0 then 'empty box' end error, name, case when w > 0 then h::int end height, case when w > 0 then w::int end width,
 case when w > 0 then {_HEX.format('list_transform(range(w * h), lambda i: p[((y1 + i // w) * 8 + x1 + i % w)::int + 1])')} end pixels from cut""")
def f9_crop_boxes(spark, d):
    """Three boxes an image: one inside, one over the edge, one empty."""
    i = F.col("vec_id").cast("int")
    box = lambda name, *at: F.struct(F.lit(name).alias("name"), *[(F.lit(v) if isinstance(v, int) else v).cast("int").alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), at)])
    boxes = F.array(box("left", 0, i % 5, 3, 8), box("over", 6, 2, 20, i % 3 + 3), box("none", 4, 4, 4, 6))
    rows = table(spark, d, "embeddings").select(i.cast("string").alias("file"), F.explode(boxes).alias("b")).where("b.name != 'none' or cast(file as long) % 2 = 0").select("file", "b.*")
    return J.crop_boxes(rasters(spark, d), rows).select("file", "ok", "error", "name", "height", "width", F.hex("data").alias("pixels"))


@query(f"""with {_BYTES}, i as (select vec_id, list_transform(range(32), lambda i: p[(i // 4 * 8 + 2 + i % 4)::int + 1]) q from b)
 select {_FILE}, '9x16' bucket, 7 height, 4 width, {_HEX.format('q[1:28]')} pixels from i""")
def g3_auto_crop_pixels(spark, d):
    """The middle 4 x 8 pixels, cut to the nearest of the ratios: 9:16, as wide and not as high."""
    return J.auto_crop(J.center_crop(rasters(spark, d), 1, 2)).select("file", "ok", "error", "bucket", "height", "width", F.hex("data").alias("pixels"))


# g10: the persons' boxes on images of vectors, by number of the image
@query(f"""with {_BYTES}, k as (select vec_id, p, 1 + vec_id % 3 x1, vec_id % 2 y1 from b), part as (select vec_id, p, 'full' kind, x1, y1, x1 + 4 x2, y1 + 6 y2 from k
 union all select vec_id, p, 'head', greatest(0, floor(x1 + 2 - 1.5::double * 2 / 2))::bigint, greatest(0, floor(y1 + 1 - 1.5::double * 2 / 2))::bigint, least(8, floor(x1 + 2 + 1.5::double))::bigint, least(8, floor(y1 + 1 + 1.5::double))::bigint from k)
 select cast(vec_id as varchar) file, true ok, null error, kind name, (y2 - y1)::int height, (x2 - x1)::int width, {_HEX.format('list_transform(range((x2 - x1) * (y2 - y1)), lambda i: p[((y1 + i // (x2 - x1)) * 8 + x1 + i % (x2 - x1))::int + 1])')} pixels from part""")
def g10_person_crop_pixels(spark, d):
    """A person of 4 x 6 pixels an image, with a head of 2 x 2, as person_crops() plans their boxes."""
    i = F.col("vec_id")
    corner = lambda x, y, w, h: F.struct(x.cast("double").alias("x1"), y.cast("double").alias("y1"), (x + w).cast("double").alias("x2"), (y + h).cast("double").alias("y2"), F.lit(0.9).alias("score"))
    x, y = 1 + i % 3, i % 2
    rows = table(spark, d, "embeddings")
    persons = rows.select(i.cast("string").alias("file"), F.lit(0).alias("person"), corner(x, y, 4, 6).alias("box"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    heads = rows.select(i.cast("string").alias("file"), F.lit(0).alias("person"), F.lit("head").alias("kind"), corner(x + 1, y, 2, 2).alias("box"))
    crops = B.person_crops(persons, heads).select("file", F.col("kind").alias("name"), "box.*")
    return J.crop_boxes(rasters(spark, d), crops).select("file", "ok", "error", "name", "height", "width", F.hex("data").alias("pixels"))


@query(f"with {_BYTES} select {_FILE}, 16 height, 16 width, {_PIXELS(256, 'p[(i // 32 * 8 + i % 16 // 2)::int + 1]')} pixels from b")
def g8_upscale_tiles(spark, d):
    """Tiles of 3 pixels with 1 around them, each enlarged by itself by doubling pixels, put together again."""
    return _hex(J.upscale(rasters(spark, d), lambda x: x.repeat(2, 0).repeat(2, 1), 2, 3, 1))


@query()
def f10_cutout(spark, d):
    return _hex(J.cutout(rasters(spark, d), 2, 0.5))


@query()
def f11_perspective(spark, d):
    return _hex(J.perspective(rasters(spark, d), 0.3))


@query()
def f12_blur_noise(spark, d):
    return _hex(J.blur_noise(rasters(spark, d), 0.8, 3.0))


@query(f"""with {_BYTES}, m as (select vec_id, list_transform(range(16), lambda i: (p[(i // 4 * 16 + i % 4 * 2)::int + 1] + p[(i // 4 * 16 + i % 4 * 2)::int + 2] + p[(i // 4 * 16 + i % 4 * 2)::int + 9] + p[(i // 4 * 16 + i % 4 * 2)::int + 10]) / 4::double) v from b)
 select {_FILE}, 4 height, 4 width, {_HEX.format('list_transform(v, lambda x: round_even(x, 0))')} pixels from m""")
def f13_resize_pixels(spark, d):
    return _hex(J.resize(rasters(spark, d), 4, 4, "area"))


def _kernel(name: str, n: int, m: int, curve: str, support: int) -> str:
    """SQL tables of a kernel's weights from n samples (i) to m (o); curve is of x."""
    wide = max(n / m, 1)
    return f"""{name}0 as (select o.range o, i.range i, (i.range + 0.5::double - (o.range + 0.5::double) * {n / m!r}::double) / {wide!r}::double x from range({m}) o, range({n}) i),
 {name}1 as (select o, i, {curve} w from {name}0 where abs(x) < {support}), {name} as (select o, i, w / sum(w) over (partition by o) w from {name}1)"""


_LANCZOS = "case when x = 0 then 1 else sin(pi() * x) / (pi() * x) * sin(pi() * x / 3) / (pi() * x / 3) end"
_CUBIC = "case when abs(x) <= 1 then (1.5::double * abs(x) - 2.5::double) * x * x + 1 else -0.5::double * (((abs(x) - 5) * abs(x) + 8) * abs(x) - 4) end"
_PX = "px as (select vec_id, j.range // 8 y, j.range % 8 x, p[j.range::int + 1] v from b, range(64) j)"
_ROUND = "greatest(0, least(255, round_even(sum(v * w), 0)))"


def _passes(kx: str, ky: str, px: str = "px") -> str:
    return f"""across as (select vec_id, y, o, {_ROUND} v from {px} join {kx} k on i = x group by all),
 down as (select vec_id, k.o y, a.o x, {_ROUND} v from across a join {ky} k on i = y group by all)"""


@query(f"""with {_BYTES}, {_kernel('k', 8, 4, _LANCZOS, 3)}, {_PX}, {_passes('k', 'k')}
 select {_FILE}, 4 height, 4 width, string_agg(printf('%02X', v::int), '' order by y, x) pixels from down group by vec_id""")
def f13_resize_lanczos(spark, d):
    return _hex(J.resize(rasters(spark, d), 4, 4))


@query(f"""with {_BYTES}, {_kernel('kx', 8, 6, _LANCZOS, 3)}, {_kernel('ky', 8, 6, _LANCZOS, 3)}, {_PX}, {_passes('kx', 'ky')}, f as (select vec_id, case when vec_id % 2 = 0 then 2.0::double * 0.75::double else 3 end cx from b),
 cut as (select d.*, greatest(0, least(cx - 1.5::double, 3))::double l from down d join f using (vec_id)) select {_FILE}, 6 height, 3 width, string_agg(printf('%02X', v::int), '' order by y, x) pixels from cut where x >= trunc(l) and x < trunc(l) + 3 group by vec_id""")
def f13_cover(spark, d):
    """3 x 6 pixels of 8 x 8, around a box in every second image."""
    face = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.lit(2.0).alias("w"), F.lit(2.0).alias("h"), F.lit(0.9).alias("score"))
    faces = F.when(F.col("file").cast("long") % 2 == 0, F.array(face)).otherwise(F.array(face.withField("score", F.lit(0.1))))
    return _hex(J.cover(rasters(spark, d).withColumn("faces", faces), 3, 6, boxes="faces"))


@query(f"""with {_BYTES}, {_kernel('k', 8, 6, "1 - abs(x)", 1)}, {_PX}, {_passes('k', 'k')}, field as (select vec_id, j.range // 10 y, j.range % 10 x from b, range(60) j)
 select {_FILE}, 6 height, 10 width, string_agg(printf('%02X', coalesce(v, 114)::int), '' order by f.y, f.x) pixels from (select f.*, d.v from field f left join down d on d.vec_id = f.vec_id and d.y = f.y and d.x = f.x - 2) f group by vec_id""")
def f13_letterbox(spark, d):
    return _hex(J.letterbox(rasters(spark, d), 10, 6))


@query(f"""with {_BYTES}, {_kernel('k', 8, 4, _CUBIC, 2)}, {_PX}, narrow as (select vec_id, y, x, case when x >= 2 and x < 6 then v else 255 end v from px), {_passes('k', 'k', 'narrow')}
 select {_FILE}, 4 height, 4 width, string_agg(printf('%02X', v::int), '' order by y, x) pixels from down group by vec_id""")
def f13_square_pad(spark, d):
    """The middle 4 x 8 pixels in a white square of 8, then 4."""
    return _hex(J.square_pad(J.center_crop(rasters(spark, d), 1, 2), 4))


@query(f"""with {_BYTES}, fr as (select vec_id, p, vec_id % 5 * 5 frame from b), t as (select vec_id, [{_TONE(0)} for i in range(9216)] t0, [{_TONE(1)} for i in range(9216)] t1, [{_TONE(2)} for i in range(9216)] t2 from fr),
 m as (select vec_id, list_transform(range(432), lambda q: list_avg(list_transform(range(64), lambda j: (case q // 144 when 0 then t2 when 1 then t1 else t0 end)[((q % 144 // 12 * 8 + j // 8) * 96 + q % 12 * 8 + j % 8)::int + 1]))) v from t)
 select cast(vec_id as varchar) file, list_transform(v, lambda x: round((x / 255::double - 0.5::double) / 0.5::double, 5)) input from m""")
def f14_model_input(spark, d):
    return J.model_input(framed(spark, d), 12, "symmetric").select("file", F.transform("input", lambda x: F.round(x.cast("double"), 5)).alias("input"))


@query("""with v as (select vec_id kp, vec_id // 64 id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) b from embeddings), n as (select id from v group by 1 having count(*) >= 2),
 m as (select l.id a, r.id b, l.kp ka, list_sum(list_transform(list_zip(l.b, r.b), lambda z: abs(z[1] - z[2]))) d from v l join v r on r.id = l.id + 1 where l.id in (select id from n) and r.id in (select id from n)),
 t as (select a, b, ka, list(d order by d)[1:2] two from m group by 1, 2, 3) select a, b, count(*) matches from t where two[1] < 0.9::double * two[2] group by 1, 2 having count(*) >= 2""")
def d4_descriptor_matches(spark, d):
    from easel.functions.rasters import sign_bits

    desc = table(spark, d, "embeddings").select(F.expr("vec_id div 64").alias("id"), F.col("vec_id").alias("kp"), F.array(sign_bits(F.col("embedding"))).alias("d"))
    ids = desc.select("id").distinct()
    pairs = ids.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    return D.descriptor_matches(pairs, desc, words=1, ratio=0.9, least=2)


@query("""with v as (select vec_id // 8 id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) b from embeddings), k as (select distinct id, n.range n, b[(n.range * 64 // 6 + 1)::int:((n.range + 1) * 64 // 6)::int] part from v, range(6) n)
 select l.id a, r.id b, count(*)::int shared from k l join k r on l.n = r.n and l.part = r.part and l.id < r.id where r.id != l.id + 1 group by 1, 2 having count(*) >= 2""")
def d4_descriptor_candidates(spark, d):
    """Images of 8 descriptors each, those of neighbouring numbers being linked already."""
    from easel.functions.rasters import sign_bits

    desc = table(spark, d, "embeddings").select(F.expr("vec_id div 8").alias("id"), F.col("vec_id").alias("kp"), F.array(sign_bits(F.col("embedding"))).alias("d"))
    linked = desc.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).distinct()
    return D.descriptor_candidates(desc, linked, words=1, parts=6, least=2)


@query()
def d5_geometric_verify(spark, d):
    far = F.when(F.col("l_linenumber") % 4 == 0, F.col("l_quantity") * 3).otherwise(0.0)
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.col("l_suppkey") * 7 % 400).cast("double")
    m = table(spark, d, "lineitem").select(F.expr("l_orderkey div 64").alias("a"), F.expr("l_orderkey div 64 + 1").alias("b"), x.alias("xa"), y.alias("ya"), (1.1 * x + 5 + far).alias("xb"), (0.9 * y + 3).alias("yb"))
    found = J.geometric_verify(m)
    return found.where(D.valid_homography(F.col("h"), F.lit(500), F.lit(400))).select("a", "b", "inliers", "ratio")


def _detected(spark, d):
    box = F.struct((F.col("l_partkey") % 200).cast("double").alias("cx"), (F.col("l_suppkey") % 150).cast("double").alias("cy"), (40 + F.col("l_quantity")).alias("w"), (30 + F.col("l_quantity")).alias("h"), F.array(F.col("l_discount") * 9, F.col("l_tax") * 10).alias("scores"))
    return B.detections(table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.sort_array(F.collect_list(box)).alias("boxes")), 0.3, 0.45)


_CORNERS = ("x1", "y1", "x2", "y2")
_JOINT = "greatest(0, least(k.x2, b.x2) - greatest(k.x1, b.x1)) * greatest(0, least(k.y2, b.y2) - greatest(k.y1, b.y1))"
# boxes of a file are taken best first; walk holds what is kept after each
_KEPT = f"""raw as (select l_orderkey file, (l_partkey % 200)::double cx, (l_suppkey % 150)::double cy, 40 + l_quantity w, 30 + l_quantity h, l_discount * 9 s1, l_tax * 10 s2, greatest(l_discount * 9, l_tax * 10) score from lineitem),
 scored as (select file, row_number() over (partition by file order by score desc, cx, cy, w, h, s1, s2) r, cx - w / 2 x1, cy - h / 2 y1, cx + w / 2 x2, cy + h / 2 y2, score from raw where score > 0.3),
 walk(file, r, kept) as (select distinct file, 0::bigint, []::struct(x1 double, y1 double, x2 double, y2 double, score double)[] from raw
 union all select b.file, b.r, case when len(list_filter(kept, lambda k: {_JOINT} / ((k.x2 - k.x1) * (k.y2 - k.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_JOINT} + 1e-6) > 0.45)) > 0 then kept
 else list_append(kept, struct_pack(x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2, score := b.score)) end from walk join scored b on b.file = walk.file and b.r = walk.r + 1),
 kept as (select file, max_by(kept, r) kept from walk group by file), person as (select file, unnest(range(len(kept))) person, unnest(kept) box from kept)"""


@query(f"with recursive {_KEPT} select k.file, person::int place, {', '.join(f'round(box.{c}, 6) {c}' for c in (*_CORNERS, 'score'))} from kept k left join person p on p.file = k.file")
def g9_detections_nms(spark, d):
    found = _detected(spark, d).select("file", F.posexplode_outer("boxes").alias("place", "box"))
    return found.select("file", "place", *[F.round(f"box.{c}", 6).alias(c) for c in (*_CORNERS, "score")])


@query(f"""with recursive {_KEPT}, part as (select file, person, 0 rank, 'full' kind, box.x1 x1, box.y1 y1, box.x2 x2, box.y2 y2 from person union all select file, person, 1, 'half', box.x1, box.y1, box.x2, box.y2 from person
 union all select file, person, 2, 'head', (box.x1 + box.x2) / 2 - side, (box.y1 + box.y2) / 2 - side, (box.x1 + box.x2) / 2 + side, (box.y1 + box.y2) / 2 + side from (select *, 1.5::double * greatest(box.x2 - box.x1, box.y2 - box.y1) / 2 side from person where person % 2 = 0)),
 inside as (select file, person, rank, kind, greatest(0, least(260, floor(x1)))::int x1, greatest(0, least(200, floor(y1)))::int y1, greatest(0, least(260, floor(x2)))::int x2, greatest(0, least(200, floor(y2)))::int y2 from part)
 select file, person::int person, kind, x1, y1, x2, y2, printf('%04d', row_number() over (order by file, person, rank) - 1) number from inside where x2 > x1 and y2 > y1""")
def g10_person_crops(spark, d):
    found = _detected(spark, d).select("file", F.posexplode("boxes").alias("person", "box")).withColumns({"width": F.lit(260), "height": F.lit(200)})
    part = lambda kind, k: found.where(f"person % {k} = 0").select("file", "person", F.lit(kind).alias("kind"), "box")
    crops = B.person_crops(found, part("half", 1).unionByName(part("head", 2)))
    return crops.select("file", "person", "kind", *[f"box.{c}" for c in _CORNERS], "number")


_TYPES = "select distinct p_type name, case length(p_type) % 5 when 0 then 'artist' when 1 then 'Character' when 2 then '9' when 3 then 'unheard of' end category from part"


@query(f"select row_number() over (order by name) - 1 idx, name, case category when 'artist' then 1 when 'Character' then 4 when '9' then 9 else 0 end category from ({_TYPES})")
def s5_read_vocab(spark, d):
    """The types of parts as a vocabulary: one small file in the order of names."""
    at = f"{shared_dir(spark)}/vocab-{uuid.uuid4().hex}"
    kinds = table(spark, d, "part").select(F.col("p_type").alias("name")).distinct()
    code = F.expr("case length(name) % 5 when 0 then 'artist' when 1 then 'Character' when 2 then '9' when 3 then 'unheard of' end")
    kinds.withColumn("category", code).coalesce(1).sortWithinPartitions("name").write.option("header", True).csv(at)
    return S.read_vocab(spark, at, "csv")


@query(with_images("select file, concat(path, '#', file) name, case when width < 600 then concat(regexp_extract(concat(path, '#', file), '^(.*/)?', 1), 'del/', regexp_extract(concat(path, '#', file), '([^/]*)$', 1)) end target from images"))
def s8_quarantine(spark, d):
    named = images(spark, d).withColumn("name", F.concat("path", F.lit("#"), F.col("file")))
    kept, gone = S.quarantine(named, F.col("width") < 600, "name")
    return kept.withColumn("target", F.lit(None).cast("string")).unionByName(gone).select("file", "name", "target")


@query(with_images("select file, concat('group_', grp + 1) folder from images where grp is not null"))
def s6_save_grouped(spark, d):
    at = f"{shared_dir(spark)}/grouped-{uuid.uuid4().hex}"
    named = images(spark, d).withColumn("name", F.concat(F.substring("format", 1, 1), F.lit(".png")))
    return S.save_grouped(named, at, "grp").select("file", "folder")


@query(with_images("select file, text from images"))
def s4_write_sidecars(spark, d):
    at = f"{shared_dir(spark)}/sidecars-{uuid.uuid4().hex}"
    S.write_sidecars(images(spark, d), at)
    return spark.read.parquet(at)


@query(with_images("select file, concat(format, '_', n, '.png') saved_name from (select *, row_number() over (partition by format order by file) n from images) where n > 1 union all select file, concat(format, '.png') from (select *, row_number() over (partition by format order by file) n from images) where n = 1").replace("'_', n,", "'_', n - 1,"))
def s7_save_output(spark, d):
    at = f"{shared_dir(spark)}/output-{uuid.uuid4().hex}"
    return S.save_output(images(spark, d).withColumn("name", F.concat("format", F.lit(".png"))), at).select("file", "saved_name")


def _bitmaps(spark, d, folder: str) -> str:
    """Writes the vectors as bitmap files of 8 x 8 pixels, in two folders by whether their number is even."""
    at = f"{shared_dir(spark)}/{folder}-{uuid.uuid4().hex}"

    def save(batches):
        import os.path
        import struct

        from pyarrow import fs

        files, top = fs.FileSystem.from_uri(at)
        for b in batches:
            for file, data in zip(b.column("file").to_pylist(), b.column("data").to_pylist()):
                # rows from the bottom up, three bytes a pixel
                body = b"".join(bytes(v for v in data[y * 8 : y * 8 + 8] for _ in range(3)) for y in range(7, -1, -1))
                head = b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 8, 8, 1, 24, 0, len(body), 2835, 2835, 0, 0)
                where = os.path.join(top, "even" if int(file) % 2 == 0 else "odd")
                files.create_dir(where, recursive=True)
                with files.open_output_stream(os.path.join(where, f"{int(file) // 2}.bmp")) as out:
                    out.write(head + body)
            yield b.select(["file"])

    rasters(spark, d).select("file", "data").mapInArrow(save, "file string").count()
    return at


_HERE = "concat(case when vec_id % 2 = 0 then 'even/' else 'odd/' end, vec_id // 2)"
_LAST = lambda c: F.regexp_extract(c, r"([^/]*/[^/]*)$", 1)


@query(f"select concat({_HERE}, '.bmp') file, concat(vec_id // 2, '.bmp') name, 246::bigint size from embeddings")
def s1_read_image_index(spark, d):
    return S.read_image_index(spark, _bitmaps(spark, d, "index")).select(_LAST("file").alias("file"), "name", "size")


@query(f"with {_BYTES} select concat({_HERE}, '.bmp') file, true ok, null error, 8 height, 8 width, 3 channels, {_PIXELS(192, 'p[(i // 3)::int + 1]')} pixels from b")
def s2_read_images(spark, d):
    i = S.read_images(spark, _bitmaps(spark, d, "images"))
    return i.select(_LAST("file").alias("file"), "ok", "error", "height", "width", "channels", F.hex("data").alias("pixels"))


@query(f"""with t as (select vec_id, {_HERE} stem, concat('label ', label, case when vec_id % 3 = 0 then ' ' else '' end) text from embeddings where vec_id % 4 != 3)
 select concat({_HERE.replace('vec_id', 'e.vec_id')}, '.bmp') file, coalesce(trim(text), '') text from embeddings e left join t on t.vec_id = e.vec_id""")
def s3_read_sidecars(spark, d):
    """Texts beside images of equal stems in two folders, for three images of four; written and read as files."""
    at = f"{shared_dir(spark)}/texts-{uuid.uuid4().hex}"
    i = F.col("vec_id")
    file = F.concat(F.lit(at + "/"), F.when(i % 2 == 0, "even/").otherwise("odd/"), F.expr("vec_id div 2").cast("string"), F.lit(".bmp"))
    rows = table(spark, d, "embeddings").select("vec_id", file.alias("file"), F.concat(F.lit("label "), F.col("label").cast("string"), F.when(i % 3 == 0, " ").otherwise("")).alias("text"))
    S.write_sidecar_files(rows.where("vec_id % 4 != 3"))
    return S.read_sidecars(spark, rows.drop("text"), at).select(_LAST("file").alias("file"), "text")
