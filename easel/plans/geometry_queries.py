"""Queries for size rules, plans and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from easel.functions import geometry as G
from easel.functions import names as N

from .tables import images, with_images

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = with_images(sql)
        return f

    return keep


@query("select file, width, height, (width < 512 or width > 2500 or height < 300) filtered from images")
def g1_resolution_filter(spark, d):
    return G.resolution_filter(images(spark, d), 512, 2500, 300, 0).select("file", "width", "height", "filtered")


@query("""select file, crop_width, crop_height, cast(floor((width - crop_width) / 2) as int) "left", cast(floor((height - crop_height) / 2) as int) top from
 (select *, case when width / height > 3 / 2 then cast(trunc(height * (3 / 2)) as int) else width end crop_width, case when width / height > 3 / 2 then height else cast(trunc(width / (3 / 2)) as int) end crop_height from images)""")
def g2_center_crop(spark, d):
    return G.center_crop(images(spark, d), 3, 2).select("file", "crop_width", "crop_height", "left", "top")


@query("""select file, bucket, crop_width, crop_height, cast(floor((width - crop_width) / 2) as int) "left", cast(floor((height - crop_height) / 2) as int) top from
 (select *, concat(rw, 'x', rh) bucket, case when width / height > rw / rh then cast(trunc(height * (rw / rh)) as int) else width end crop_width, case when width / height > rw / rh then height else cast(trunc(width / (rw / rh)) as int) end crop_height from
 (select *, row_number() over (partition by file order by abs(width / height - rw / rh), i) r from images, (values (0,1,1),(1,2,3),(2,3,2),(3,16,9),(4,9,16)) v(i, rw, rh)) where r = 1)""")
def g3_auto_crop(spark, d):
    return G.auto_crop(images(spark, d)).select("file", "bucket", "crop_width", "crop_height", "left", "top")


def _boxes():
    box = F.struct((F.col("file") % 50).cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(20.0).alias("w"), F.lit(30.0).alias("h"), ((F.col("file") % 10) / 10).alias("score"))
    return F.when(F.col("file") % 3 == 0, F.array(box))


@query("""select file, skipped, scale, new_width, new_height, cast(trunc(greatest(0, least(x - 300, new_width - 600))) as int) "left", cast(trunc(greatest(0, least(y - 200, new_height - 400))) as int) top from
 (select *, case when file % 3 = 0 and (file % 10) / 10 >= 0.5 then (file % 50 + 10.0) * scale else new_width / 2 end x, case when file % 3 = 0 and (file % 10) / 10 >= 0.5 then 25.0 * scale else new_height / 2 end y from
 (select *, cast(round(width * scale) as int) new_width, cast(round(height * scale) as int) new_height from
 (select *, (width <= 600 and height <= 400) skipped, greatest(600 / width, 400 / height) scale from images)))""")
def g4_cover_resize(spark, d):
    return G.cover_resize(images(spark, d).withColumn("boxes", _boxes()), 600, 400, boxes="boxes").select("file", "skipped", "scale", "new_width", "new_height", "left", "top")


@query("""select file, scale, new_width, new_height, pad_x, pad_y, greatest(0.0, least((100 - pad_x) / scale, cast(width as double))) x1, greatest(0.0, least((600 - pad_y) / scale, cast(height as double))) y2 from
 (select *, cast(floor((640 - new_width) / 2) as int) pad_x, cast(floor((640 - new_height) / 2) as int) pad_y from
 (select *, cast(trunc(width * scale) as int) new_width, cast(trunc(height * scale) as int) new_height from (select *, least(640 / width, 640 / height) scale from images)))""")
def g5_letterbox(spark, d):
    box = F.array(F.struct(F.lit(100.0).alias("x1"), F.lit(50.0).alias("y1"), F.lit(500.0).alias("x2"), F.lit(600.0).alias("y2")))
    p = G.unletterbox(G.letterbox(images(spark, d), 640, 640).withColumn("boxes", box), "boxes")
    return p.select("file", "scale", "new_width", "new_height", "pad_x", "pad_y", F.col("boxes")[0]["x1"].alias("x1"), F.col("boxes")[0]["y2"].alias("y2"))


@query("""select file, side, pad_left, pad_top, side - width - pad_left pad_right, side - height - pad_top pad_bottom, case when side > 1024 then 'down' else 'none' end scaled from
 (select *, cast(floor((side - width) / 2) as int) pad_left, cast(floor((side - height) / 2) as int) pad_top from (select *, greatest(width, height, 1024) side from images))""")
def g6_square_pad(spark, d):
    return G.square_pad(images(spark, d), 1024).select("file", "side", "pad_left", "pad_top", "pad_right", "pad_bottom", "scaled")


@query("select file, greatest(1, cast(trunc(width * s) as int)) new_width, greatest(1, cast(trunc(height * s) as int)) new_height from (select *, least(1.0::double, 800 / greatest(width, height)) s from images)")
def g7_fit_within(spark, d):
    return G.fit_within(images(spark, d), 800).select("file", "new_width", "new_height")


@query("""select file, tx tile_x, ty tile_y, tx*256 x1, least(tx*256+256, width) x2, ty*256 y1, least(ty*256+256, height) y2, greatest(0, tx*256-16) pad_x1, least(width, least(tx*256+256, width)+16) pad_x2, greatest(0, ty*256-16) pad_y1, least(height, least(ty*256+256, height)+16) pad_y2,
 tx*512 out_x1, least(tx*256+256, width)*2 out_x2, ty*512 out_y1, least(ty*256+256, height)*2 out_y2, (tx*256-greatest(0, tx*256-16))*2 in_x, (ty*256-greatest(0, ty*256-16))*2 in_y
 from (select *, unnest(range(cast(greatest(1, ceil(height / 256)) as int))) ty from (select *, unnest(range(cast(greatest(1, ceil(width / 256)) as int))) tx from images))""")
def g8_tiles(spark, d):
    return G.tiles(images(spark, d)).select("file", "tile_x", "tile_y", *[f"{p}{a}{k}" for p in ("", "pad_", "out_") for a in "xy" for k in "12"], "in_x", "in_y")


@query("""select file, bpp bytes_per_pixel, round(38 * greatest(0, least(1, ln(1 + area) / ln(1 + 16777216.0::double))) + 30 * greatest(0, least(1, ln(1 + sharpness) / ln(1201.0::double))) + 12 * greatest(0, least(1, contrast / 80)) + 10 * greatest(0, least(1, bpp / 0.8))
 + 8 * (case format when 'png' then 1.0 when 'webp' then 0.94 when 'jpg' then 0.84 when 'bmp' then 0.8 else 0.76 end)::double + (case when has_alpha then 2.0 else 0.0 end)::double, 1) score from (select *, width::double * height area, file_size / (width::double * height) bpp from images)""")
def f6_quality_score(spark, d):
    return G.quality_score(images(spark, d)).select("file", "bytes_per_pixel", "score")


@query(r"""select file, concat(regexp_replace(regexp_replace(path, '^.*/', ''), '(.)\.[^.]*$', '\1'), case when path like '/in/%' then '_flip' else '' end, '.png') name from images""")
def n1_output_name(spark, d):
    return images(spark, d).select("file", N.output_name(F.col("path"), "flip", ".png", F.lit("/in")).alias("name"))


@query(r"""select file, case when n = 1 then name else concat(stem, '_', n - 1, ext) end unique_name from
 (select *, row_number() over (partition by name order by pos) n, regexp_replace(name, '(.)\.[^.]*$', '\1') stem, regexp_extract(name, '.(\.[^.]*)$', 1) ext from (select *, concat(replace(split_part(text, ',', 1), ' ', ''), '_', file % 90, '.png') name from images))""")
def n2_resolve_collisions(spark, d):
    named = images(spark, d).withColumn("name", F.concat(F.replace(F.split_part("text", F.lit(","), F.lit(1)), F.lit(" "), F.lit("")), F.lit("_"), (F.col("file") % 90).cast("string"), F.lit(".png")))
    return N.resolve_collisions(named).select("file", "unique_name")


@query(r"""select page_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), '\s+', ' ', 'g'), '^[. _]+|[. _]+$', '', 'g'), 40), ''), 'file') clean from pages""")
def n3_sanitize(spark, d):
    from .tables import table

    return table(spark, d, "pages").select("page_id", N.sanitize(F.col("url"), 40).alias("clean"))
