"""Jobs over decoded images (Spark's image source): features, variants and geometry on pixels.

A job runs a numpy kernel on each row in Arrow batches. A row that fails keeps its error and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from easel.functions import geometry as G
from easel.functions import pixels as P
from easel.plans.ship import ship

RASTER = "height int, width int, channels int, data binary"


def image_job(images: DataFrame, fn: Callable[..., dict | None], schema: str, seed_by: str = "file", op: str = "", using: tuple[str, ...] = ()) -> DataFrame:
    """(file, ok, error, the columns of schema): fn(raster, seed, *values of the columns using) of each row of
    read_images(), None where the image is skipped. The seed is a hash of the file and op, so reruns agree. Rasters are
    views of the Arrow batch; what fn gives for an array column may be a numpy array."""
    given = images.select("file", F.xxhash64(F.col(seed_by), F.lit(op)).alias("seed"), "ok", "error", "height", "width", "channels", "data", *using)
    return _rows_job(given, lambda x, seed, *more: [got] if (got := fn(x, seed, *more)) else [], schema, len(using))


def _rows_job(given: DataFrame, fn: Callable[..., list[dict]], schema: str, using: int) -> DataFrame:
    """The rows that fn gives for each image; one row with ok or error where it gives none."""
    ship(given.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]
    whole = f"file string, ok boolean, error string, {schema}"
    types = [f.type for f in to_arrow_schema(_parse_datatype_string(whole))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in types]
            data = b.column(7)
            plain = [b.column(i).to_pylist() for i in (*range(7), *range(8, 8 + using))]
            for i, (file, seed, ok, error, h, w, n, *more) in enumerate(zip(*plain)):
                got: list[dict] = [{}]
                if ok:
                    try:
                        raster = np.frombuffer(data[i].as_buffer(), np.uint8).reshape(h, w, n)
                        got = fn(raster, seed, *more) or [{}]
                        if not got[0]:
                            error = "skipped"
                    except Exception as e:
                        ok, error, got = False, str(e) or type(e).__name__, [{}]
                for g in got:
                    for o, x in zip(out, (file, ok, error, *[g.get(c) for c in names])):
                        o.append(x)
            yield pa.RecordBatch.from_arrays([_column(o, t) for o, t in zip(out, types)], ["file", "ok", "error", *names])

    return given.mapInArrow(run, whole)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow column; arrays of numbers are taken over as they are."""
    if not pa.types.is_list(kind) or not any(isinstance(v, np.ndarray) for v in values):
        return pa.array(values, kind)
    ends = np.zeros(len(values) + 1, np.int32)
    np.cumsum([0 if v is None else v.size for v in values], out=ends[1:])
    flat = np.concatenate([v.ravel() for v in values if v is not None])
    missing = pa.array([v is None for v in values])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind.value_type), mask=missing)


def _raster(x: np.ndarray) -> dict:
    x = x if x.ndim == 3 else x[..., None]
    return {"height": x.shape[0], "width": x.shape[1], "channels": x.shape[2], "data": np.ascontiguousarray(x).tobytes()}


def _opaque(x: np.ndarray) -> np.ndarray:
    """Colours alone: transparency on white, grey as three channels."""
    x = P.flatten_alpha(x) if x.shape[2] == 4 and x[..., 3].min() < 255 else x[..., :3]
    return np.repeat(x, 3, 2) if x.shape[2] == 1 else x


def signatures(images: DataFrame) -> DataFrame:
    """dhash, phash (4 longs each) and hue histogram of the image on white, without flat margins."""

    def fn(x: np.ndarray, _: int) -> dict:
        x = P.content(_opaque(x))
        return {"dhash": P.dhash(x), "phash": P.phash(x), "hist": P.hue_histogram(x)}

    return image_job(images, fn, "dhash array<bigint>, phash array<bigint>, hist array<double>")


def color_features(images: DataFrame) -> DataFrame:
    return image_job(images, lambda x, _: {"feature": P.hsv_feature(x)}, "feature array<double>")


def pixel_stats(images: DataFrame) -> DataFrame:
    """sharpness (variance of the Laplacian) and contrast (deviation of luma) without flat margins, and has_alpha."""

    def fn(x: np.ndarray, _: int) -> dict:
        g = P.gray(P.content(_opaque(x)))
        return {"sharpness": float(P.laplacian(g).var()), "contrast": float(g.std()), "has_alpha": x.shape[2] == 4}

    return image_job(images, fn, "sharpness double, contrast double, has_alpha boolean")


def activity(images: DataFrame) -> DataFrame:
    """What content_box() decides by: activity of strips of rows and columns, and of the whole image."""
    return image_job(images, lambda x, _: P.strip_activity(_opaque(x)), "rows array<double>, cols array<double>, mean double, height int, width int")


def content_box(df: DataFrame) -> DataFrame:
    """Adds left, top, right, bottom, trimmed to what activity() gives: strips go from the four sides up to the first
    that is above a quarter of the mean activity, and above 1.

    The box is the whole image where a side is under 64, under a tenth is trimmed, under a quarter is left, or a side
    falls under 32.
    """
    loudest = F.greatest(F.col("mean") / 4, F.lit(1.0))

    def ends(strips: str, side: str) -> tuple[Column, Column]:
        wide, n = F.greatest(F.floor(F.col(side) / 20), F.lit(4)), F.size(strips)
        loud = F.filter(F.transform(strips, lambda x, i: F.when(x > loudest, i)), lambda i: i.isNotNull())
        first, last = F.coalesce(F.array_min(loud), F.lit(0)), F.coalesce(F.array_max(loud) + 1, n)
        return (first * wide).cast("int"), F.least(last * wide, F.col(side)).cast("int")

    (top, bottom), (left, right) = ends("rows", "height"), ends("cols", "width")
    df = df.withColumns({"top": top, "bottom": bottom, "left": left, "right": right})
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    share = w * h / (F.col("width") * F.col("height"))
    large = (F.least("width", "height") >= 64) & (F.least(F.size("rows"), F.size("cols")) >= 3)
    df = df.withColumn("trimmed", large & (share <= 0.9) & (share >= 0.25) & (w >= 32) & (h >= 32))
    whole = {"left": F.lit(0), "top": F.lit(0), "right": F.col("width"), "bottom": F.col("height")}
    return df.withColumns({k: F.when(F.col("trimmed"), F.col(k)).otherwise(v) for k, v in whole.items()})


def flatten_alpha(images: DataFrame, background: str = "white") -> DataFrame:
    """Transparent images on a background; those without transparency are skipped."""
    if background not in ("white", "black"):
        raise ValueError(f"unknown background {background}")

    def fn(x: np.ndarray, _: int) -> dict | None:
        y = P.flatten_alpha(x, background)
        return None if y is None else _raster(y)

    return image_job(images, fn, RASTER)


def mirror(images: DataFrame) -> DataFrame:
    return image_job(images, lambda x, _: _raster(x[:, ::-1]), RASTER)


def cutout(images: DataFrame, count: int = 3, ratio: float = 0.2) -> DataFrame:
    return image_job(images, lambda x, s: _raster(P.cutout(x, count, ratio, s)), RASTER, op="cutout")


def perspective(images: DataFrame, intensity: float = 0.1) -> DataFrame:
    return image_job(images, lambda x, s: _raster(P.perspective(x, intensity, s)), RASTER, op="perspective")


def blur_noise(images: DataFrame, radius: float = 1.0, sigma: float = 5.0) -> DataFrame:
    return image_job(images, lambda x, s: _raster(P.blur_noise(x, radius, sigma, s)), RASTER, op="blur_noise")


def resize(images: DataFrame, width: int, height: int, kernel: str = "lanczos") -> DataFrame:
    """Images of a new size, by the kernel lanczos, bicubic, bilinear or area (linear where a side grows)."""
    if kernel not in (*P.SHARP, "area"):
        raise ValueError(f"unknown kernel {kernel}")

    def fn(x: np.ndarray, _: int) -> dict:
        return _raster(P.to_uint8(P.resize(x, width, height)) if kernel == "area" else P.resize_sharp(x, width, height, kernel))

    return image_job(images, fn, RASTER)


def cover(images: DataFrame, width: int, height: int, allow_upscale: bool = False, boxes: str | None = None, min_score: float = 0.5, kernel: str = "lanczos") -> DataFrame:
    """Images of width x height, as functions.geometry.cover_resize() plans them: scaled to cover it and cut around the
    boxes' mean centre, or the image's. Only the pixels of the cut are resampled. Smaller images are skipped."""
    planned = G.cover_resize(images, width, height, allow_upscale, boxes, min_score)

    def fn(x: np.ndarray, _: int, skipped: bool, new_width: int, new_height: int, left: int, top: int) -> dict | None:
        # a side may round to less than it should cover
        size = max(new_width, width), max(new_height, height)
        return None if skipped else _raster(P.resize_window(x, size, (left, top, left + width, top + height), kernel))

    return image_job(planned, fn, RASTER, using=("skipped", "new_width", "new_height", "left", "top"))


def letterbox(images: DataFrame, width: int, height: int, kernel: str = "bilinear", fill: int = 114) -> DataFrame:
    """Images fitted inside width x height on a plain field, as functions.geometry.letterbox() plans them."""
    planned = G.letterbox(images, width, height)

    def fn(x: np.ndarray, _: int, w: int, h: int, left: int, top: int) -> dict:
        return _raster(P.padded(P.resize_sharp(x, max(1, w), max(1, h), kernel), left, top, width, height, fill))

    return image_job(planned, fn, RASTER, using=("new_width", "new_height", "pad_x", "pad_y"))


def square_pad(images: DataFrame, target: int, kernel: str = "bicubic", fill: int = 255) -> DataFrame:
    """Images in the middle of a plain square, scaled down to target if it is larger, as functions.geometry.square_pad()
    plans them."""
    planned = G.square_pad(images, target)

    def fn(x: np.ndarray, _: int, side: int, left: int, top: int) -> dict:
        x = P.padded(x, left, top, side, side, fill)
        return _raster(P.resize_sharp(x, target, target, kernel) if side > target else x)

    return image_job(planned, fn, RASTER, using=("side", "pad_left", "pad_top"))


def center_crop(images: DataFrame, rw: int, rh: int) -> DataFrame:
    """Pixels of functions.geometry.center_crop()'s box."""
    return planned_crop(G.center_crop(images, rw, rh))


def auto_crop(images: DataFrame, ratios: Sequence[tuple[int, int]] = G.RATIOS) -> DataFrame:
    """Pixels of functions.geometry.auto_crop()'s box, with the name of its bucket."""
    return planned_crop(G.auto_crop(images, ratios), ("bucket string",))


def planned_crop(planned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Pixels of a box left, top, crop_width, crop_height that lies in each image; keep: further columns, with types."""
    names = [k.split()[0] for k in keep]

    def fn(x: np.ndarray, _: int, left: int, top: int, width: int, height: int, *more) -> dict:
        return _raster(x[top : top + height, left : left + width]) | dict(zip(names, more))

    return image_job(planned, fn, ", ".join([RASTER, *keep]), using=("left", "top", "crop_width", "crop_height", *names))


def crop_boxes(images: DataFrame, boxes: DataFrame, name: str = "name") -> DataFrame:
    """(file, ok, error, name, height, width, channels, data): a row for each of the boxes (file, name, x1, y1, x2, y2),
    clipped to their image. An image is read once for all its boxes; images without boxes give no row, empty boxes and
    images that can't be decoded one with an error. A file's boxes are one list, so they are few beside its pixels."""
    of = boxes.groupBy(F.col("file").alias("_f")).agg(F.sort_array(F.collect_list(F.struct(F.col(name).cast("string").alias("name"), "x1", "y1", "x2", "y2"))).alias("_boxes"))
    met = images.join(of, F.col("file") == F.col("_f"))

    def fn(x: np.ndarray, _: int, boxes: list[dict]) -> list[dict]:
        out = []
        for b in boxes:
            cut = x[max(0, b["y1"]) : max(0, b["y2"]), max(0, b["x1"]) : max(0, b["x2"])]
            out.append({"name": b["name"], "note": None if cut.size else "empty box"} | (_raster(cut) if cut.size else {}))
        return out

    given = met.select("file", F.lit(0).cast("long").alias("seed"), "ok", "error", "height", "width", "channels", "data", "_boxes")
    rows = _rows_job(given, fn, f"name string, note string, {RASTER}", 1)
    return rows.withColumns({"ok": F.col("ok") & F.col("note").isNull(), "error": F.coalesce("error", "note")}).drop("note")


_TILE = "tile_y int, tile_x int, y1 int, x1 int, y2 int, x2 int, pad_y int, pad_x int, full_height int, full_width int"


def split_tiles(images: DataFrame, tile: int = 256, pad: int = 16) -> DataFrame:
    """A row a tile, with its padded pixels, what of them is the tile's own and the whole image's size, as
    functions.geometry.tiles() plans them. Tiles are dealt out by file and place, so a huge image is many tasks' work."""

    def fn(x: np.ndarray, _: int) -> list[dict]:
        h, w = x.shape[:2]
        out = []
        for ty in range(-(-h // tile)):
            for tx in range(-(-w // tile)):
                y1, x1, y2, x2 = ty * tile, tx * tile, min(h, ty * tile + tile), min(w, tx * tile + tile)
                top, left = max(0, y1 - pad), max(0, x1 - pad)
                place = {"tile_y": ty, "tile_x": tx, "y1": y1, "x1": x1, "y2": y2, "x2": x2, "pad_y": y1 - top, "pad_x": x1 - left, "full_height": h, "full_width": w}
                out.append(place | _raster(x[top : min(h, y2 + pad), left : min(w, x2 + pad)]))
        return out

    given = images.select("file", F.lit(0).cast("long").alias("seed"), "ok", "error", "height", "width", "channels", "data")
    return _rows_job(given, fn, f"{_TILE}, {RASTER}", 0).repartition("file", "tile_y", "tile_x")


def map_tiles(tiles: DataFrame, model: Callable[[np.ndarray], np.ndarray], scale: int = 1) -> DataFrame:
    """Tiles after model(raster) -> raster of scale times the size; a tile that fails keeps its error."""
    names = [c.split()[0] for c in _TILE.split(", ")]

    def fn(x: np.ndarray, _: int, *place) -> dict:
        y = model(x)
        if y.shape[:2] != (x.shape[0] * scale, x.shape[1] * scale):
            raise ValueError(f"the model made {y.shape[1]} x {y.shape[0]} of {x.shape[1]} x {x.shape[0]}")
        return _raster(P.to_uint8(y) if y.dtype != np.uint8 else y) | dict(zip(names, place))

    return image_job(tiles, fn, f"{_TILE}, {RASTER}", using=tuple(names))


def join_tiles(tiles: DataFrame, scale: int = 1) -> DataFrame:
    """Whole images from the own parts of mapped tiles. One image is put together by one task, which holds it; an image
    with a failed tile fails, with the error of its first such tile."""
    ship(tiles.sparkSession)
    names = ["file", "ok", "error", *[c.split()[0] for c in RASTER.split(", ")]]

    def put(t: pa.Table) -> pa.Table:
        file, out, types = t["file"][0].as_py(), [None] * 4, [pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        rows = t.drop_columns(["data"]).to_pylist()
        bad = sorted((r["tile_y"] or 0, r["tile_x"] or 0, r["error"]) for r in rows if not r["ok"])
        if not bad:
            first = rows[0]
            whole = np.zeros((first["full_height"] * scale, first["full_width"] * scale, first["channels"]), np.uint8)
            for r, data in zip(rows, t["data"]):
                x = np.frombuffer(data.as_buffer(), np.uint8).reshape(r["height"], r["width"], r["channels"])
                (y1, y2, x1, x2), top, left = (r[k] * scale for k in ("y1", "y2", "x1", "x2")), r["pad_y"] * scale, r["pad_x"] * scale
                whole[y1:y2, x1:x2] = x[top : top + y2 - y1, left : left + x2 - x1]
            out = [*whole.shape, whole.tobytes()]
        return pa.table([pa.array([v], k) for v, k in zip((file, not bad, bad[0][2] if bad else None, *out), types)], names)

    return tiles.groupBy("file").applyInArrow(put, f"file string, ok boolean, error string, {RASTER}")


def upscale(images: DataFrame, model: Callable[[np.ndarray], np.ndarray], scale: int, tile: int = 256, pad: int = 16) -> DataFrame:
    """Images through a model of tiles: cut, mapped and put together again."""
    return join_tiles(map_tiles(split_tiles(images, tile, pad), model, scale), scale)


def model_input(images: DataFrame, size: int, norm: str = "clip", layout: str = "nchw") -> DataFrame:
    return image_job(images, lambda x, _: {"input": P.model_input(x, size, norm, layout)}, "input array<float>")


def geometric_verify(matches: DataFrame, min_inliers: int = 20, min_ratio: float = 0.3, pixels: float = 3.0, miss: float = 0.001, seed: int = 7) -> DataFrame:
    """(a, b, inliers, ratio, h): pairs whose matched points (xa, ya, xb, yb) a homography explains.

    A seeded search over samples of 4 points, as many as find a homography that just has min_ratio of the matches but
    for a share `miss` of the cases: 850 for 0.3 and 0.001. A pair is kept with min_inliers matches within `pixels`, a share of
    min_ratio of its matches, of a homography. One pair's matches are at most the descriptors of an image.
    """
    ship(matches.sparkSession)
    tries = int(np.ceil(np.log(miss) / np.log(1 - min_ratio**4)))

    def fit(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Homographies of stacked samples (.., points, 2): the last right singular vector of their equations."""
        x, y, u, v = p[..., 0], p[..., 1], q[..., 0], q[..., 1]
        z, one = np.zeros_like(x), np.ones_like(x)
        rows = np.concatenate([np.stack([-x, -y, -one, z, z, z, u * x, u * y, u], -1), np.stack([z, z, z, -x, -y, -one, v * x, v * y, v], -1)], -2)
        return np.linalg.svd(rows)[2][..., -1, :].reshape(*rows.shape[:-2], 3, 3)

    def errors(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        z = np.einsum("...ij,nj->...ni", h, np.c_[p, np.ones(len(p))])
        with np.errstate(all="ignore"):
            e = np.hypot(z[..., 0] / z[..., 2] - q[:, 0], z[..., 1] / z[..., 2] - q[:, 1])
        return np.where(np.isfinite(e), e, np.inf)

    def verify(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["xa", "ya", "xb", "yb"])
        p, q = f[["xa", "ya"]].to_numpy(float), f[["xb", "yb"]].to_numpy(float)
        best = np.zeros(len(p), bool)
        if len(p) >= max(4, min_inliers):
            rng = np.random.default_rng(seed)
            i = np.stack([rng.choice(len(p), 4, replace=False) for _ in range(tries)])
            good = errors(fit(p[i], q[i]), p, q) <= pixels
            best = good[good.sum(1).argmax()]
        n = int(best.sum())
        if n < min_inliers or n / len(p) < min_ratio:
            return pd.DataFrame(columns=["a", "b", "inliers", "ratio", "h"], dtype=object)
        h = fit(p[best], q[best])
        return pd.DataFrame({"a": [f["a"].iloc[0]], "b": [f["b"].iloc[0]], "inliers": [n], "ratio": [n / len(p)], "h": [(h / h[2, 2]).ravel().tolist()]})

    kind = matches.schema["a"].dataType.simpleString()
    return matches.select("a", "b", "xa", "ya", "xb", "yb").groupBy("a", "b").applyInPandas(verify, f"a {kind}, b {kind}, inliers int, ratio double, h array<double>")
