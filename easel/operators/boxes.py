"""Detections: selection, suppression and the crops of persons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Shared over joint area of two boxes (x1, y1, x2, y2); an empty union gives 0."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda c: (c["x2"] - c["x1"]) * (c["y2"] - c["y1"])
    return w * h / (area(a) + area(b) - w * h + F.lit(1e-6))


def nms(boxes: Column, limit: float) -> Column:
    """Boxes (x1, y1, x2, y2, score), best score first, without those that overlap a better kept one by more than
    limit; equal scores go by place."""
    ordered = F.transform(F.array_sort(F.transform(boxes, lambda b, i: F.struct((-b["score"]).alias("k"), i.alias("i"), b.alias("b")))), lambda s: s["b"])
    return F.aggregate(ordered, F.slice(boxes, 1, 0), lambda kept, b: F.when(F.exists(kept, lambda k: iou(k, b) > limit), kept).otherwise(F.concat(kept, F.array(b))))


def detections(df: DataFrame, conf: float, limit: float, boxes: str = "boxes") -> DataFrame:
    """Raw rows (cx, cy, w, h, scores) to kept corner boxes: the best class score must be above conf."""
    scored = F.transform(boxes, lambda b: F.struct((b["cx"] - b["w"] / 2).alias("x1"), (b["cy"] - b["h"] / 2).alias("y1"), (b["cx"] + b["w"] / 2).alias("x2"), (b["cy"] + b["h"] / 2).alias("y2"), F.array_max(b["scores"]).alias("score")))
    return df.withColumn(boxes, nms(F.filter(scored, lambda b: b["score"] > conf), limit))


def _inside(b: Column, w: Column, h: Column) -> Column:
    fit = lambda v, most: F.greatest(F.lit(0), F.least(F.floor(v).cast("int"), most))
    return F.struct(fit(b["x1"], w).alias("x1"), fit(b["y1"], h).alias("y1"), fit(b["x2"], w).alias("x2"), fit(b["y2"], h).alias("y2"))


def person_crops(persons: DataFrame, parts: DataFrame, head_scale: float = 1.5, file: str = "file") -> DataFrame:
    """(file, person, kind, box, number): for each person the full box, the best half-body and the best head.

    persons: (file, person, box, width, height); parts: (file, person, kind half or head, box with score). A head
    becomes a square of head_scale times its longer side around its centre. Boxes are clipped to the image; empty
    ones are left out. Numbers run over the batch in order of file, person and kind,
    with four digits or more.
    """
    best = parts.groupBy(file, "person", "kind").agg(F.max_by("box", F.struct(F.col("box.score"), -F.col("box.x1"))).alias("b"))
    best = best.join(persons.select(file, "person", "width", "height"), [file, "person"])
    side = head_scale * F.greatest(F.col("b.x2") - F.col("b.x1"), F.col("b.y2") - F.col("b.y1")) / 2
    cx, cy = (F.col("b.x1") + F.col("b.x2")) / 2, (F.col("b.y1") + F.col("b.y2")) / 2
    square = F.struct((cx - side).alias("x1"), (cy - side).alias("y1"), (cx + side).alias("x2"), (cy + side).alias("y2"))
    plain = lambda c: F.struct(*[F.col(f"{c}.{k}").alias(k) for k in ("x1", "y1", "x2", "y2")])
    got = best.withColumn("box", F.when(F.col("kind") == "head", square).otherwise(plain("b"))).select(file, "person", "kind", "box", "width", "height")
    full = persons.select(file, "person", F.lit("full").alias("kind"), plain("box").alias("box"), "width", "height")
    out = full.unionByName(got).withColumn("box", _inside(F.col("box"), F.col("width"), F.col("height"))).where("box.x2 > box.x1 and box.y2 > box.y1")
    from .tags import with_position

    rank = F.when(F.col("kind") == "full", 0).when(F.col("kind") == "half", 1).otherwise(2)
    keyed = out.withColumn("_k", F.struct(F.col(file).alias("a"), F.col("person").alias("b"), rank.alias("c")))
    return with_position(keyed, "_k", "_at").select(file, "person", "kind", "box", F.format_string("%04d", F.col("_at")).alias("number"))


