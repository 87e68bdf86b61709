"""Image kernels in numpy on arrays of rows x columns x channels; small helpers of the image jobs."""

from __future__ import annotations

import numpy as np


def _weights(n: int, m: int, area: bool) -> np.ndarray:
    """An m x n matrix that resizes n samples to m: by shares of area, or linearly."""
    if area and m < n:
        lo, hi = np.arange(m) * n / m, np.arange(1, m + 1) * n / m
        w = np.clip(np.minimum(hi[:, None], np.arange(n) + 1) - np.maximum(lo[:, None], np.arange(n)), 0, None)
        return w / w.sum(1, keepdims=True)
    at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    i = np.minimum(at.astype(int), max(0, n - 2))
    w = np.zeros((m, n))
    w[np.arange(m), i] = 1 - (at - i)
    if n > 1:
        w[np.arange(m), i + 1] += at - i
    return w


def _taps(n: int, m: int, kernel: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """(samples, weights) of outputs lo .. hi when n samples become m: only those within the kernel's reach, which widens
    where it shrinks. Samples beyond an end weigh 0. Weights are added up from the first on, as pixels are."""
    support, curve = SHARP[kernel]
    wide = max(n / m, 1)
    centre = (np.arange(lo, hi) + 0.5) * n / m - 0.5
    at = np.ceil(centre - support * wide).astype(int)[:, None] + np.arange(int(2 * support * wide) + 2)
    x = (at - centre[:, None]) / wide
    w = np.where((np.abs(x) < support) & (at >= 0) & (at < n), curve(x), 0)
    return np.clip(at, 0, n - 1), w / w.cumsum(1)[:, -1:]


def cubic(x: np.ndarray, a: float) -> np.ndarray:
    """Keys' cubic convolution kernel."""
    x = np.abs(x)
    return np.where(x <= 1, ((a + 2) * x - (a + 3)) * x * x + 1, np.where(x < 2, a * (((x - 5) * x + 8) * x - 4), 0))


def lanczos(x: np.ndarray) -> np.ndarray:
    """The sinc kernel in a window of three lobes."""
    x = np.pi * np.where(x == 0, 1e-20, x)
    return np.sin(x) / x * np.sin(x / 3) / (x / 3)


#: Reach in samples and curve of the kernels.
SHARP = {"bilinear": (1, lambda x: np.maximum(0, 1 - np.abs(x))), "bicubic": (2, lambda x: cubic(x, -0.5)), "lanczos": (3, lanczos)}


def resize_window(image: np.ndarray, size: tuple[int, int], window: tuple[int, int, int, int], kernel: str = "lanczos") -> np.ndarray:
    """The window (left, top, right, bottom) of the image resized to size (width, height): columns, then rows, rounded to
    bytes after each. Nothing is made of the rest, and of the image only the rows that the window needs are read."""
    (width, height), (left, top, right, bottom) = size, window
    rows, by_row = _taps(image.shape[0], height, kernel, top, bottom)
    cols, by_col = _taps(image.shape[1], width, kernel, left, right)
    first, last = int(rows.min(initial=0)), int(rows.max(initial=-1)) + 1
    given = image[first:last].reshape(last - first, image.shape[1], -1)
    across = to_uint8(sum(given[:, cols[:, k]] * by_col[:, k, None] for k in range(cols.shape[1])))
    out = to_uint8(sum(across[rows[:, k] - first] * by_row[:, k, None, None] for k in range(rows.shape[1])))
    return out.reshape(bottom - top, right - left, *image.shape[2:])


def resize_sharp(image: np.ndarray, width: int, height: int, kernel: str = "lanczos") -> np.ndarray:
    """Bytes resized by a kernel of SHARP."""
    return resize_window(image, (width, height), (0, 0, width, height), kernel)


def padded(image: np.ndarray, left: int, top: int, width: int, height: int, fill: int) -> np.ndarray:
    """The image at a place of a plain field."""
    out = np.full((height, width, *image.shape[2:]), fill, np.uint8)
    out[top : top + image.shape[0], left : left + image.shape[1]] = image
    return out


def resize(image: np.ndarray, width: int, height: int, area: bool = True) -> np.ndarray:
    """Separable: area averages when it shrinks, else bilinear."""
    rows, cols = _weights(image.shape[0], height, area), _weights(image.shape[1], width, area)
    return np.einsum("ij,jk...,lk->il...", rows, image.astype(float), cols, optimize=True)


def to_uint8(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of BGR rasters."""
    return image.astype(float) if image.ndim == 2 else image[..., 0] * 0.114 + image[..., 1] * 0.587 + image[..., 2] * 0.299


def flatten_alpha(image: np.ndarray, background: str = "white") -> np.ndarray | None:
    """Composite BGRA on white or black; None where every pixel is opaque or there is no alpha."""
    if background not in ("white", "black"):
        raise ValueError(f"unknown background {background}")
    if image.ndim < 3 or image.shape[2] < 4 or image[..., 3].min() == 255:
        return None
    a = image[..., 3:4] / 255
    return to_uint8(image[..., :3] * a + (255 if background == "white" else 0) * (1 - a))


def laplacian(g: np.ndarray) -> np.ndarray:
    p = np.pad(g, 1, mode="reflect" if min(g.shape) > 1 else "edge")
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * g


def hsv(image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in 0..180, saturation and value in 0..255 of BGR."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    v, low = np.maximum(np.maximum(b, g), r), np.minimum(np.minimum(b, g), r)
    d = v - low
    safe = np.where(d == 0, 1, d)
    h = np.where(v == r, (g - b) / safe, np.where(v == g, 2 + (b - r) / safe, 4 + (r - g) / safe)) * 30
    return np.where(d == 0, 0, h % 180), np.where(v == 0, 0, d / np.where(v == 0, 1, v) * 255), v


def histogram(values: np.ndarray, bins: int, high: float) -> np.ndarray:
    return np.bincount(np.clip((values.ravel() * bins / high).astype(int), 0, bins - 1), minlength=bins).astype(float)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum())
    return x / n if n else x


def hue_histogram(image: np.ndarray, bins: int = 32) -> np.ndarray:
    return unit(histogram(hsv(resize(image[..., :3], 64, 64))[0], bins, 180))


def hsv_feature(image: np.ndarray, bins: tuple[int, int, int] = (32, 16, 16)) -> np.ndarray:
    parts = hsv(resize(image[..., :3], 128, 128))
    return unit(np.concatenate([histogram(p, n, 256) for p, n in zip(parts, bins)]))


def _cells(g: np.ndarray, grid: int):
    ys, xs = (np.linspace(0, n, grid + 1).astype(int) for n in g.shape)
    for i in range(grid):
        for j in range(grid):
            yield g[ys[i] : max(ys[i + 1], ys[i] + 1), xs[j] : max(xs[j + 1], xs[j] + 1)]


def _pack(bits: np.ndarray) -> int:
    return int(np.packbits(bits.ravel(), bitorder="little").view("<i8")[0])


def dhash(image: np.ndarray, grid: int = 2, size: int = 8) -> list[int]:
    """A long for each region: whether a pixel is brighter than the one to its left, on size x (size + 1)."""
    return [_pack(np.diff(resize(c, size + 1, size), axis=1) > 0) for c in _cells(gray(image), grid)]


def phash(image: np.ndarray, grid: int = 2, size: int = 32, low: int = 8) -> list[int]:
    """A long for each region: low cosine coefficients above their median, the first one included."""
    k, i = np.arange(low)[:, None], np.arange(size)
    basis = np.sqrt(np.where(k == 0, 1, 2) / size) * np.cos(np.pi * (2 * i + 1) * k / (2 * size))
    out = []
    for c in _cells(gray(image), grid):
        x = basis @ resize(c, size, size) @ basis.T
        out.append(_pack(x > np.median(x)))
    return out


def strip_side(n: int) -> int:
    """How wide a strip is: a twentieth of the side, 4 at least."""
    return max(n // 20, 4)


def strip_activity(image: np.ndarray) -> dict:
    """Mean absolute Laplacian (over the four diagonal neighbours, doubled) of each whole strip of rows, and of columns,
    and of the image."""
    p = np.pad(np.rint(gray(image)), 1, mode="reflect" if min(image.shape[:2]) > 1 else "edge")
    a = np.abs(2 * (p[:-2, :-2] + p[:-2, 2:] + p[2:, :-2] + p[2:, 2:]) - 8 * p[1:-1, 1:-1])
    h, w = image.shape[:2]
    by = lambda x, n, k: x[: n // k * k].reshape(n // k, k).mean(1).tolist()
    return {"rows": by(a.mean(1), h, strip_side(h)), "cols": by(a.mean(0), w, strip_side(w)), "mean": float(a.mean()), "height": h, "width": w}


def content(image: np.ndarray) -> np.ndarray:
    """The image without flat margins, by the rule of operators.image_jobs.content_box()."""
    h, w = image.shape[:2]
    seen = strip_activity(image)
    if min(h, w) < 64 or min(len(seen["rows"]), len(seen["cols"])) < 3:
        return image
    box = []
    for strips, side in ((seen["rows"], h), (seen["cols"], w)):
        loud = [i for i, x in enumerate(strips) if x > max(seen["mean"] / 4, 1.0)] or [0, len(strips) - 1]
        box += [loud[0] * strip_side(side), min((loud[-1] + 1) * strip_side(side), side)]
    top, bottom, left, right = box
    share = (bottom - top) * (right - left) / (h * w)
    return image[top:bottom, left:right] if 0.25 <= share <= 0.9 and min(bottom - top, right - left) >= 32 else image


def cutout(image: np.ndarray, count: int, ratio: float, seed: int) -> np.ndarray:
    """count square holes of side int(min(height, width) * ratio), clipped to the image, filled with 0."""
    out, (h, w) = image.copy(), image.shape[:2]
    side = int(min(h, w) * ratio)
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    for _ in range(count):
        y, x = int(rng.integers(0, h)), int(rng.integers(0, w))
        out[max(0, y - side // 2) : y - side // 2 + side, max(0, x - side // 2) : x - side // 2 + side] = 0
    return out


def perspective(image: np.ndarray, intensity: float, seed: int) -> np.ndarray:
    """The image drawn into a quadrangle whose corners lie up to int(intensity times the size) inside its own, 0 outside.
    Sampled by cubic convolution with edges repeated, and cut to whole numbers. 0 leaves the image."""
    h, w = image.shape[:2]
    rng = np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF)
    own = np.array([(0, 0), (w, 0), (w, h), (0, h)], float)
    inset = rng.integers(0, [int(w * intensity) + 1, int(h * intensity) + 1], (4, 2))
    drawn = own + inset * [(1, 1), (-1, 1), (-1, -1), (1, -1)]
    # from where a pixel is drawn to where it comes from
    x, y, (u, v) = drawn[:, 0], drawn[:, 1], own.T
    one, z = np.ones(4), np.zeros(4)
    rows = np.concatenate([np.stack([x, y, one, z, z, z, -u * x, -u * y], 1), np.stack([z, z, z, x, y, one, -v * x, -v * y], 1)])
    m = np.append(np.linalg.solve(rows, np.concatenate([u, v])), 1).reshape(3, 3)
    y, x = np.mgrid[:h, :w] + 0.5
    p = m @ np.stack([x.ravel(), y.ravel(), np.ones(h * w)])
    u, v = p[0] / p[2], p[1] / p[2]
    seen = (u >= 0) & (u < w) & (v >= 0) & (v < h)
    u, v = u[seen] - 0.5, v[seen] - 0.5
    i, j = np.floor(v).astype(int), np.floor(u).astype(int)
    flat = image.reshape(h, w, -1)
    out, got = np.zeros((h * w, flat.shape[2])), 0.0
    for di in range(-1, 3):
        for dj in range(-1, 3):
            weight = cubic(v - i - di, -1.0) * cubic(u - j - dj, -1.0)
            got = got + flat[np.clip(i + di, 0, h - 1), np.clip(j + dj, 0, w - 1)] * weight[:, None]
    out[seen] = np.floor(np.clip(got + 1e-9, 0, 255))
    return out.reshape(image.shape).astype(np.uint8)


def blur_noise(image: np.ndarray, radius: float, sigma: float, seed: int) -> np.ndarray:
    """Gaussian blur, then Gaussian noise; 0 and 0 leave the image."""
    out = image.astype(float)
    if radius > 0:
        n = max(1, int(np.ceil(3 * radius)))
        k = np.exp(-0.5 * (np.arange(-n, n + 1) / radius) ** 2)
        k /= k.sum()
        for axis in (0, 1):
            p = np.pad(out, [(n, n) if a == axis else (0, 0) for a in range(out.ndim)], mode="edge")
            out = sum(k[i] * np.take(p, range(i, i + image.shape[axis]), axis) for i in range(2 * n + 1))
    if sigma > 0:
        out = out + np.random.default_rng(seed & 0xFFFFFFFFFFFFFFFF).normal(0, sigma, image.shape)
    return to_uint8(out)


# Channel means and deviations of the usual model inputs, RGB.
NORMS = {"unit": ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0)), "symmetric": ((0.5, 0.5, 0.5), (0.5, 0.5, 0.5)), "clip": ((0.48145466, 0.4578275, 0.40821073), (0.26862954, 0.26130258, 0.27577711))}


def model_input(image: np.ndarray, size: int, norm: str = "clip", layout: str = "nchw") -> np.ndarray:
    """RGB floats of size x size, scaled to 0..1 and normalised, in nhwc or nchw order."""
    mean, std = NORMS[norm]
    x = (resize(image[..., :3][..., ::-1], size, size) / 255 - mean) / std
    return (x.transpose(2, 0, 1) if layout == "nchw" else x).astype(np.float32)
