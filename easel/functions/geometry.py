"""Size rules and crop, resize, pad and tile plans from width and height columns; no pixels are read.

Functions take a DataFrame with columns width and height and add columns. Sizes of 0 or less are off.
Divisions floor; sizes truncate. Missing sizes give null plans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The crop ratios offered by default, width to height.
RATIOS = ((1, 1), (2, 3), (3, 2), (16, 9), (9, 16))


def resolution_filter(df: DataFrame, min_width: int = 0, max_width: int = 0, min_height: int = 0, max_height: int = 0, mode: str = "both") -> DataFrame:
    """Adds filtered: some bound is broken. Mode width or height turns the other side's minimum off."""
    if mode not in ("both", "width", "height"):
        raise ValueError(f"unknown mode {mode}")
    min_width, min_height = (0 if mode == "height" else min_width), (0 if mode == "width" else min_height)
    bad = F.lit(False)
    for bound, broken in ((min_width, F.col("width") < min_width), (max_width, F.col("width") > max_width), (min_height, F.col("height") < min_height), (max_height, F.col("height") > max_height)):
        bad = bad | broken if bound > 0 else bad
    return df.withColumn("filtered", bad)


def _half(x: Column) -> Column:
    return F.floor(x / 2).cast("int")


def center_crop(df: DataFrame, rw: Column | int, rh: Column | int) -> DataFrame:
    """Adds left, top, crop_width, crop_height of the largest centred box of ratio rw : rh."""
    ratio = (rw if isinstance(rw, Column) else F.lit(rw)) / (rh if isinstance(rh, Column) else F.lit(rh))
    wide = F.col("width") / F.col("height") > ratio
    df = df.withColumns({"crop_width": F.when(wide, (F.col("height") * ratio).cast("int")).otherwise(F.col("width")), "crop_height": F.when(wide, F.col("height")).otherwise((F.col("width") / ratio).cast("int"))})
    return df.withColumns({"left": _half(F.col("width") - F.col("crop_width")), "top": _half(F.col("height") - F.col("crop_height"))})


def auto_crop(df: DataFrame, ratios: Sequence[tuple[int, int]] = RATIOS) -> DataFrame:
    """center_crop() at the nearest ratio, the first of equally near ones, and its bucket name."""
    if not ratios:
        raise ValueError("at least one ratio")
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("width") / F.col("height") - F.lit(a) / F.lit(b)).alias("gap"), F.lit(i).alias("i"), F.lit(a).alias("rw"), F.lit(b).alias("rh")) for i, (a, b) in enumerate(ratios)]))
    df = df.withColumn("_r", near).withColumn("bucket", F.concat_ws("x", F.col("_r.rw").cast("string"), F.col("_r.rh").cast("string")))
    return center_crop(df, F.col("_r.rw"), F.col("_r.rh")).drop("_r")


def cover_resize(df: DataFrame, width: int, height: int, allow_upscale: bool = False, boxes: str | None = None, min_score: float = 0.5) -> DataFrame:
    """Adds skipped, scale, new_width, new_height, left, top of a resize that covers width x height.

    The crop is centred on the mean centre of the boxes (x, y, w, h, score) that score enough, else on the image.
    Images that would grow on both sides' account are skipped unless allow_upscale.
    """
    scale = F.greatest(F.lit(width) / F.col("width"), F.lit(height) / F.col("height"))
    df = df.withColumns({"skipped": (F.col("width") <= width) & (F.col("height") <= height) if not allow_upscale else F.lit(False), "scale": scale})
    df = df.withColumns({"new_width": F.round(F.col("width") * F.col("scale")).cast("int"), "new_height": F.round(F.col("height") * F.col("scale")).cast("int")})
    x, y = F.col("new_width") / 2, F.col("new_height") / 2
    if boxes is not None:
        good = F.filter(boxes, lambda b: b["score"] >= min_score)
        n = F.size(good)
        mean = lambda at, size: F.aggregate(good, F.lit(0.0), lambda s, b: s + b[at] + b[size] / 2) / n * F.col("scale")
        x, y = F.when(n > 0, mean("x", "w")).otherwise(x), F.when(n > 0, mean("y", "h")).otherwise(y)
    fit = lambda at, size, most: F.greatest(F.lit(0), F.least(at - size / 2, most - size)).cast("int")
    return df.withColumns({"left": fit(x, F.lit(width), F.col("new_width")), "top": fit(y, F.lit(height), F.col("new_height"))})


def letterbox(df: DataFrame, width: int, height: int) -> DataFrame:
    """Adds scale, new_width, new_height, pad_x, pad_y of a fit inside width x height."""
    df = df.withColumn("scale", F.least(F.lit(width) / F.col("width"), F.lit(height) / F.col("height")))
    df = df.withColumns({"new_width": (F.col("width") * F.col("scale")).cast("int"), "new_height": (F.col("height") * F.col("scale")).cast("int")})
    return df.withColumns({"pad_x": _half(width - F.col("new_width")), "pad_y": _half(height - F.col("new_height"))})


def unletterbox(df: DataFrame, boxes: str) -> DataFrame:
    """Maps boxes (x1, y1, x2, y2) from a letterbox back to the image, clipped to it."""
    back = lambda v, pad, most: F.greatest(F.lit(0.0), F.least((v - F.col(pad)) / F.col("scale"), most.cast("double")))
    return df.withColumn(boxes, F.transform(boxes, lambda b: F.struct(back(b["x1"], "pad_x", F.col("width")).alias("x1"), back(b["y1"], "pad_y", F.col("height")).alias("y1"), back(b["x2"], "pad_x", F.col("width")).alias("x2"), back(b["y2"], "pad_y", F.col("height")).alias("y2"))))


def square_pad(df: DataFrame, target: int) -> DataFrame:
    """Adds side, pads on the four sides and whether the square is then scaled down to target, or not."""
    df = df.withColumn("side", F.greatest(F.col("width"), F.col("height"), F.lit(target)))
    return df.withColumns({"pad_left": _half(F.col("side") - F.col("width")), "pad_top": _half(F.col("side") - F.col("height")), "scaled": F.when(F.col("side") > target, "down").otherwise("none")}).withColumns({"pad_right": F.col("side") - F.col("width") - F.col("pad_left"), "pad_bottom": F.col("side") - F.col("height") - F.col("pad_top")})


def fit_within(df: DataFrame, max_side: int) -> DataFrame:
    """Adds new_width and new_height: scaled down, and only down, to max_side, at least 1."""
    scale = F.least(F.lit(1.0), F.lit(max_side) / F.greatest(F.col("width"), F.col("height")))
    return df.withColumns({"new_width": F.greatest(F.lit(1), (F.col("width") * scale).cast("int")), "new_height": F.greatest(F.lit(1), (F.col("height") * scale).cast("int"))})


def tiles(df: DataFrame, tile: int = 256, pad: int = 16, scale: int = 2) -> DataFrame:
    """A row for each tile: its core box, the padded box clipped to the image, the output box, and where the core
    lies in the scaled padded box."""
    steps = lambda side: F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(side / tile).cast("int") - 1))
    df = df.withColumn("tile_y", F.explode(steps(F.col("height")))).withColumn("tile_x", F.explode(steps(F.col("width"))))
    new: dict[str, Column] = {}
    for a, side in (("x", F.col("width")), ("y", F.col("height"))):
        lo, hi = F.col(f"tile_{a}") * tile, F.least(F.col(f"tile_{a}") * tile + tile, side)
        new |= {f"{a}1": lo, f"{a}2": hi, f"pad_{a}1": F.greatest(F.lit(0), lo - pad), f"pad_{a}2": F.least(side, hi + pad), f"out_{a}1": lo * scale, f"out_{a}2": hi * scale, f"in_{a}": (lo - F.greatest(F.lit(0), lo - pad)) * scale}
    return df.withColumns(new)


def quality_score(df: DataFrame) -> DataFrame:
    """Adds bytes_per_pixel and score (one decimal) from width, height, sharpness, contrast, file_size, format and
    has_alpha. Unknown formats count 0.76; no pixels give no bytes per pixel."""
    area = (F.col("width") * F.col("height")).cast("double")
    part = lambda x, most: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / most))
    kind = F.lower("format")
    rank = F.when(kind == "png", 1.0).when(kind == "webp", 0.94).when(kind.isin("tif", "tiff"), 0.9).when(kind.isin("jpg", "jpeg"), 0.84).when(kind == "bmp", 0.8).otherwise(0.76)
    df = df.withColumn("bytes_per_pixel", F.when(area > 0, F.col("file_size") / area).otherwise(0.0))
    total = 38 * part(F.log1p(area), F.log1p(F.lit(4096.0 * 4096.0))) + 30 * part(F.log1p("sharpness"), F.log1p(F.lit(1200.0))) + 12 * part(F.col("contrast"), F.lit(80.0)) + 10 * part(F.col("bytes_per_pixel"), F.lit(0.8)) + 8 * rank + F.when(F.col("has_alpha"), 2.0).otherwise(0.0)
    return df.withColumn("score", F.round(total, 1))
