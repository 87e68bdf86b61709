"""Crops, tiles and resized windows of images against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from easel.functions import pixels as PX
from easel.operators import image_jobs as J

SCHEMA = "file string, ok boolean, error string, height int, width int, channels int, data binary"


def table(spark, images):
    return spark.createDataFrame([(n, x is not None, None if x is not None else "bad", *(x.shape if x is not None else (None, None, None)), x.tobytes() if x is not None else None) for n, x in images.items()], SCHEMA)


def rasters(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["channels"]) for r in df.collect() if r["ok"] and r["data"] is not None}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(3)
    return {n: rng.integers(0, 256, s, dtype=np.uint8) for n, s in {"a": (37, 50, 3), "b": (64, 20, 1), "c": (9, 9, 4), "tiny": (1, 1, 3)}.items()} | {"bad": None}


def test_tiles_give_the_image_back(spark, images):
    df = table(spark, images)
    for tile, pad in ((16, 4), (64, 8), (1, 0), (9, 30)):
        parts = J.split_tiles(df.where("file != 'b'"), tile, pad)
        whole = rasters(J.join_tiles(J.map_tiles(parts, lambda x: x)), "file")
        assert all((whole[n] == images[n]).all() for n in ("a", "c", "tiny")) and "bad" not in whole
    assert J.split_tiles(df, 16, 4).where("file = 'a'").count() == 3 * 4
    assert J.join_tiles(J.split_tiles(df.limit(0))).collect() == []


def test_tiles_are_mapped_with_what_lies_around_them(spark, images):
    """A 3 x 3 mean by tiles with a pixel around them is that of the whole image."""

    def mean(x):
        p = np.pad(x.astype(float), ((1, 1), (1, 1), (0, 0)), mode="edge")
        return PX.to_uint8(sum(p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(3) for j in range(3)) / 9)

    got = rasters(J.upscale(table(spark, images), mean, 1, 16, 1), "file")
    assert all((got[n] == mean(images[n])).all() for n in ("a", "b", "c", "tiny"))
    double = rasters(J.upscale(table(spark, images), lambda x: x.repeat(2, 0).repeat(2, 1), 2, 16, 3), "file")
    assert all((double[n] == images[n].repeat(2, 0).repeat(2, 1)).all() for n in ("a", "b"))


def test_an_image_with_a_failed_tile_fails(spark, images):
    def model(x):
        if x.shape[0] < 16:
            raise ValueError("too low")
        return x

    got = {r["file"]: (r["ok"], r["error"]) for r in J.upscale(table(spark, images), model, 1, 16, 0).collect()}
    assert got == {"a": (False, "too low"), "b": (True, None), "c": (False, "too low"), "tiny": (False, "too low"), "bad": (False, "bad")}
    wrong = J.upscale(table(spark, {"a": images["a"]}), lambda x: x, 2).collect()[0]
    assert not wrong["ok"] and "the model made" in wrong["error"]


def test_crop_boxes(spark, images):
    boxes = [("a", "in", 3, 4, 20, 30), ("a", "over", 40, -5, 99, 5), ("a", "none", 5, 5, 5, 9), ("c", "in", 0, 0, 9, 9), ("bad", "in", 0, 0, 1, 1), ("lost", "in", 0, 0, 1, 1)]
    rows = J.crop_boxes(table(spark, images), spark.createDataFrame(boxes, "file string, name string, x1 int, y1 int, x2 int, y2 int"))
    got = rasters(rows, "file", "name")
    assert (got["a", "in"] == images["a"][4:30, 3:20]).all() and (got["a", "over"] == images["a"][:5, 40:]).all() and (got["c", "in"] == images["c"]).all()
    assert sorted((r["file"], r["name"], r["error"]) for r in rows.where("not ok").collect() if r["file"] == "a") == [("a", "none", "empty box")]
    assert [r["error"] for r in rows.where("file = 'bad'").collect()] == ["bad"] and set(got) == {("a", "in"), ("a", "over"), ("c", "in")}


@pytest.mark.parametrize("kernel", ["lanczos", "bicubic", "bilinear"])
def test_windows_are_cuts_of_whole_resizes(images, kernel):
    for x, size in ((images["a"], (23, 61)), (images["b"], (7, 9)), (images["c"], (40, 40)), (images["tiny"], (3, 2))):
        whole = PX.resize_sharp(x, *size, kernel)
        for l, t, r, b in ((0, 0, *size), (size[0] // 3, size[1] // 4, size[0], size[1] // 2 + 1), (size[0] - 1, size[1] - 1, *size)):
            assert (PX.resize_window(x, size, (l, t, r, b), kernel) == whole[t:b, l:r]).all()


def _dense(x, width, height, support, curve):
    def pass_(x, m):
        n = x.shape[1]
        wide = max(n / m, 1)
        at = (np.arange(n) + 0.5 - (np.arange(m)[:, None] + 0.5) * n / m) / wide
        w = np.where(np.abs(at) < support, curve(at), 0)
        return PX.to_uint8(np.einsum("ik...,jk->ij...", x.astype(float), w / w.sum(1, keepdims=True)))

    return pass_(pass_(x, width).swapaxes(0, 1), height).swapaxes(0, 1)


def test_cover_letterbox_and_square(spark, images):
    df = table(spark, images).where("file != 'tiny'")
    triangle, lanczos, cubic = (1, lambda a: np.maximum(0, 1 - abs(a))), (3, lambda a: np.sinc(a) * np.sinc(a / 3)), (2, lambda a: PX.cubic(a, -0.5))
    face = F.array(F.struct(F.lit(2.0).alias("x"), F.lit(0.0).alias("y"), F.lit(4.0).alias("w"), F.lit(4.0).alias("h"), F.lit(0.9).alias("score")))
    got = rasters(J.cover(df.withColumn("faces", F.when(F.col("file") == "a", face)), 20, 30, boxes="faces"), "file")
    whole = _dense(images["a"], 41, 30, *lanczos)  # scale 30 / 37
    assert (got["a"] == whole[:, :20]).all() and got["b"].shape == (30, 20, 1) and "c" not in got
    assert {r["file"]: r["error"] for r in J.cover(df, 20, 30).where("error is not null").collect()} == {"c": "skipped", "bad": "bad"}
    assert rasters(J.cover(df, 20, 30, allow_upscale=True), "file")["c"].shape == (30, 20, 4)
    boxed = rasters(J.letterbox(df, 40, 40), "file")
    inner = _dense(images["a"], 40, 29, *triangle)
    assert (boxed["a"][5:34] == inner).all() and (boxed["a"][:5] == 114).all() and (boxed["a"][34:] == 114).all()
    square = rasters(J.square_pad(df, 30), "file")
    field = np.full((50, 50, 3), 255, np.uint8)
    field[6:43] = images["a"]
    assert (square["a"] == _dense(field, 30, 30, *cubic)).all()
    assert square["c"].shape == (30, 30, 4) and (square["c"][10:19, 10:19] == images["c"]).all() and (square["c"][:10] == 255).all()


def test_cutout_is_holes_at_seeded_places(images):
    x = np.maximum(images["a"], 1)
    got = PX.cutout(x, 3, 0.3, 99)
    rng, side, want = np.random.default_rng(99), int(37 * 0.3), x.copy()
    for _ in range(3):
        y, c = int(rng.integers(0, 37)), int(rng.integers(0, 50))
        for i in range(y - side // 2, y - side // 2 + side):
            for j in range(c - side // 2, c - side // 2 + side):
                if 0 <= i < 37 and 0 <= j < 50:
                    want[i, j] = 0
    assert (got == want).all() and (got == 0).any() and (x > 0).all()
    assert not np.array_equal(PX.cutout(x, 3, 0.3, 100), got)


def test_blur_is_a_gaussian_mean_and_noise_has_its_width(images):
    x = images["a"]
    got = PX.blur_noise(x, 1.2, 0, 5)
    n = 4
    k = np.exp(-0.5 * (np.arange(-n, n + 1) / 1.2) ** 2)
    k /= k.sum()
    p = np.pad(x.astype(float), ((n, n), (n, n), (0, 0)), mode="edge")
    want = np.array([[(p[i : i + 2 * n + 1, j : j + 2 * n + 1] * np.outer(k, k)[..., None]).sum((0, 1)) for j in range(50)] for i in range(37)])
    assert (got == PX.to_uint8(want)).all()
    flat = np.full((100, 100, 3), 128, np.uint8)
    noise = PX.blur_noise(flat, 0, 6.0, 5).astype(float) - 128
    assert abs(noise.mean()) < 0.2 and abs(noise.std() - 6) < 0.2 and (PX.blur_noise(flat, 0, 6.0, 5) == PX.blur_noise(flat, 0, 6.0, 5)).all()


def test_perspective_moves_corners(spark):
    from easel.plans import pixel_queries as Q

    d = "/root/testdata/sf0.001"
    given = {r["file"]: r["pixels"] for r in Q._hex(Q.rasters(spark, d)).collect()}
    got = {r["file"]: r["pixels"] for r in Q.f11_perspective(spark, d).collect()}
    assert given.keys() == got.keys() and sum(given[f] != got[f] for f in given) > 0.95 * len(given)


def test_colour_feature_by_hand(images):
    """Two plain halves: each channel's histogram has two bars."""
    x = np.zeros((128, 128, 3), np.uint8)
    x[:, :64], x[:, 64:] = (255, 0, 0), (0, 128, 255)  # blue; orange
    want = np.zeros(64)
    want[int(120 * 32 / 256)] += 8192  # hue of blue, of 180, in 32 bars of 256
    want[int((128 / 255 * 30) * 32 / 256)] += 8192
    want[32 + 15], want[48 + 15] = 16384, 16384
    assert np.allclose(PX.hsv_feature(x), want / np.sqrt((want * want).sum()))
    bars = PX.hue_histogram(x)
    assert np.isclose((bars**2).sum(), 1) and np.flatnonzero(bars).tolist() == [int(128 / 255 * 30 * 32 / 180), int(120 * 32 / 180)]


def test_grid_hashes_by_hand(images):
    """Bits of a region's differences and of its cosine coefficients, by loops over its own definition."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.integers(0, 256, (64, 72, 1), dtype=np.uint8), 3, 2)
    g = x[..., 0].astype(float)
    want_d, want_p = [], []
    for i in range(2):
        for j in range(2):
            cell = g[32 * i : 32 * i + 32, 36 * j : 36 * j + 36]
            small = cell.reshape(8, 4, 9, 4).mean((1, 3))
            want_d.append(sum(1 << (8 * y + k) for y in range(8) for k in range(8) if small[y, k + 1] > small[y, k]))
            square = PX.resize(cell, 32, 32)
            c = [[sum(square[a, b] * np.cos(np.pi * (2 * a + 1) * u / 64) * np.cos(np.pi * (2 * b + 1) * v / 64) for a in range(32) for b in range(32)) * (1 if u else 0.5**0.5) * (1 if v else 0.5**0.5) for v in range(8)] for u in range(8)]
            m = np.median(c)
            want_p.append(sum(1 << (8 * u + v) for u in range(8) for v in range(8) if c[u][v] > m))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    assert PX.dhash(x) == [signed(v) for v in want_d] and PX.phash(x) == [signed(v) for v in want_p]


def test_framed_images_are_drawn_by_batches(spark):
    """Pixels by hand; they are taken by an index of places in numpy, not by an expression a pixel."""
    from easel.plans import pixel_queries as Q

    sf = "/root/testdata/sf0.001"
    df = Q.framed(spark, sf)
    assert "MapInArrow" in df._jdf.queryExecution().toString()
    rows = {str(r["vec_id"]): r["embedding"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 5").collect()}
    for r in df.where("cast(file as long) < 5").collect():
        own = [max(0, min(255, int((float(v) + 0.5) * 255))) for v in rows[r["file"]]]
        frame, side = int(r["file"]) % 5 * 5, 96
        want = [own[(y * (7 + k) + x * (3 + 2 * k) + x * y // 16) % 64] if frame <= min(x, y) and max(x, y) < side - frame else 0xE0 for y in range(side) for x in range(side) for k in range(3)]
        assert list(r["data"]) == want
