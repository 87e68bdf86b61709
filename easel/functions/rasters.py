"""Small rasters as array<array<double>> columns: signatures, histograms and pixel rules in Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, fn) -> Column:
    """fn of a value that is computed once, not at each place where fn uses it."""
    return F.transform(F.array(value), fn)[0]


def to_rows(flat: Column, width: int) -> Column:
    """A flat array as rows of `width`."""
    n = F.size(flat)
    return F.transform(F.sequence(F.lit(0), (n / width).cast("int") - 1), lambda r: F.slice(flat, r * width + 1, F.lit(width)))


def pack_bits(bits: Column) -> Column:
    """Booleans, first lowest, as one long; 64 at most."""
    return F.aggregate(F.transform(bits, lambda b, i: F.when(b, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))


def sign_bits(values: Column) -> Column:
    return pack_bits(F.transform(values, lambda x: x > 0))


def row_differences(rows: Column) -> Column:
    """The difference hash: per row, whether a pixel is brighter than the one to its left."""
    per_row = F.transform(rows, lambda r: F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: b > a))
    return pack_bits(F.flatten(per_row))


def dct_basis(n: int, low: int) -> list[list[float]]:
    """The first rows of the orthonormal cosine basis."""
    return [[math.sqrt((1 if k == 0 else 2) / n) * math.cos(math.pi * (2 * i + 1) * k / (2 * n)) for i in range(n)] for k in range(low)]


def _matrix(m: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(x) for x in r]) for r in m])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def median(values: Column) -> Column:
    n = F.size(values)
    return let(F.array_sort(values), lambda s: (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor(n / 2 + 1).cast("int"))) / 2)


def dct_low(rows: Column, size: int = 8, low: int = 8) -> Column:
    """The low coefficients of the 2-D cosine transform of a size x size raster, row by row."""
    basis = _matrix(dct_basis(size, low))
    half = lambda m: F.transform(basis, lambda k: F.transform(F.sequence(F.lit(1), F.lit(size)), lambda c: F.aggregate(F.zip_with(k, m, lambda w, r: w * F.element_at(r, c).cast("double")), F.lit(0.0), lambda s, x: s + x)))
    return let(rows, lambda m: F.flatten(F.transform(half(m), lambda r: F.transform(basis, lambda k: dot(r, k)))))


def cosine_hash(coefficients: Column) -> Column:
    """Bits of coefficients above their median, the first one included."""
    return let(coefficients, lambda c: let(median(c), lambda m: pack_bits(F.transform(c, lambda x: x > m))))


def histogram(values: Column, low: float, high: float, bins: int) -> Column:
    """L2-normalised counts; values outside [low, high) are left out; no values give zeros."""
    at = F.filter(F.transform(values, lambda x: F.floor((x - low) / ((high - low) / bins)).cast("int")), lambda i: (i >= 0) & (i < bins))
    return let(let(at, lambda a: F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(a, lambda i: i == b)).cast("double"))), l2_normalize)


def mirror(rows: Column) -> Column:
    return F.transform(rows, lambda r: F.reverse(r))


def crop(rows: Column, left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.transform(F.slice(rows, top + 1, height), lambda r: F.slice(r, left + 1, width))


def round_scaled(x: Column, digits: int) -> Column:
    """Rounded to digits as SQL engines with binary floats do: the value times a power of ten, half away from zero, divided
    again. F.round() takes the shortest decimal that prints as x instead, so the two part where the next digits are 5 and zeros."""
    scale = F.lit(10.0**digits)
    return F.round(x * scale, 0) / scale


def psnr(a: Column, b: Column) -> Column:
    """10 log10 of 1 over the mean squared error (plus 1e-6) of values clamped to 0..1, in dB."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double")))
    mse = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(clamp(x) - clamp(y), 2)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return 10 * F.log10(1 / (mse + F.lit(1e-6)))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(0.29891) * r + F.lit(0.58661) * g + F.lit(0.11448) * b


def jaccard(a: Column, b: Column, threshold: float = 0.5) -> Column:
    """Shared over all places at or above the threshold; 1 where there are none."""
    both = F.zip_with(a, b, lambda x, y: ((x >= threshold) & (y >= threshold)).cast("int"))
    any_ = F.zip_with(a, b, lambda x, y: ((x >= threshold) | (y >= threshold)).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    return F.when(total(any_) == 0, F.lit(1.0)).otherwise(total(both) / total(any_))


def squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def fused_squares(values: Column) -> Column:
    """The sum of squares where a square isn't rounded before it is added, as by fused multiply-add: what it loses as a
    double (Dekker's product) goes in with what the sum loses. For doubles below 1e150."""
    high = lambda x: x * F.lit(134217729.0) - (x * F.lit(134217729.0) - x)
    parts = F.transform(values, lambda x: F.struct(x.alias("x"), high(x).alias("h"), (x * x).alias("p")))
    parts = F.transform(parts, lambda v: F.struct(v["p"].alias("p"), (v["h"] * v["h"] - v["p"] + 2 * v["h"] * (v["x"] - v["h"]) + (v["x"] - v["h"]) * (v["x"] - v["h"])).alias("lost")))

    def add(s: Column, v: Column) -> Column:
        whole = s + v["p"]
        other = whole - s
        return whole + ((s - (whole - other)) + (v["p"] - other) + v["lost"])

    return F.aggregate(parts, F.lit(0.0), add)


def l2_normalize(values: Column) -> Column:
    """Divided by the L2 norm, or by 1 where that is 0."""
    return _over_root(values, squares(values))


def fused_l2_normalize(values: Column) -> Column:
    """l2_normalize() by fused_squares()."""
    return _over_root(values, fused_squares(values))


def _over_root(values: Column, total: Column) -> Column:
    norm = F.sqrt(total)
    return let(F.when(norm == 0, F.lit(1.0)).otherwise(norm), lambda n: F.transform(values, lambda x: x.cast("double") / n))


def unit_centered(values: Column) -> Column:
    """Centred and scaled to length 1; all zeros where the values are equal. The dot product of two is Pearson's r."""
    mean = F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(values)
    return let(let(mean, lambda m: F.transform(values, lambda x: x.cast("double") - m)), l2_normalize)
