"""Pixel kernels on arrays of 8-bit values, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# BT.601 full-range colour conversion.
CR_R, CB_G, CR_G, CB_B = 1.402, 0.34414, 0.71414, 1.772


def byte(value: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), value.cast("int")))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """struct<r, g, b>: single precision, clamped and cut, not rounded."""
    y, cb, cr = y.cast("float"), cb.cast("float") - F.lit(128.0).cast("float"), cr.cast("float") - F.lit(128.0).cast("float")
    k = lambda v: F.lit(v).cast("float")
    return F.struct(byte(y + k(CR_R) * cr).alias("r"), byte(y - k(CB_G) * cb - k(CR_G) * cr).alias("g"), byte(y + k(CB_B) * cb).alias("b"))


def chroma_upsampled(plane: Column, cw: int, ch: int, w: int, h: int) -> Column:
    """A plane of cw x ch as w x h, by the nearest lower sample."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(w * h - 1)),
        lambda i: F.get(plane, (F.least(F.floor(F.floor(i / w) * ch / h), F.lit(ch - 1)) * cw + F.least(F.floor(i % w * cw / w), F.lit(cw - 1))).cast("int")),
    )


def _triangle(x: float) -> float:
    return max(0.0, 1 - abs(x))


def _cubic(x: float, b: float, c: float) -> float:
    """The Mitchell-Netravali family of cubic filters."""
    x = abs(x)
    if x < 1:
        return ((12 - 9 * b - 6 * c) * x**3 + (12 * b + 6 * c - 18) * x**2 + 6 - 2 * b) / 6
    return ((-b - 6 * c) * x**3 + (6 * b + 30 * c) * x**2 - (12 * b + 48 * c) * x + 8 * b + 24 * c) / 6 if x < 2 else 0.0


def _lanczos3(x: float) -> float:
    sinc = lambda v: math.sin(math.pi * v) / (math.pi * v) if v else 1.0
    return sinc(x) * sinc(x / 3) if abs(x) < 3 else 0.0


KERNELS = {"triangle": (_triangle, 1), "catmullrom": (lambda x: _cubic(x, 0, 0.5), 2), "lanczos3": (_lanczos3, 3), "gaussian": (_lanczos3, 3)}
ALIASES = {"bilinear": "triangle", "bicubic": "catmullrom", "lanczos": "lanczos3"}


def kernel_weights(name: str, size: int, out: int) -> list[list[tuple[int, float]]]:
    """For each output sample the (source sample, weight) pairs, of sum 1; a kernel widens as the image shrinks."""
    name = ALIASES.get(name.lower(), name.lower())
    scale = size / out
    if name == "nearest":
        return [[(min(size - 1, int((i + 0.5) * scale)), 1.0)] for i in range(out)]
    f, support = KERNELS[name]
    wide = max(1.0, scale)
    rows = []
    for i in range(out):
        centre = (i + 0.5) * scale
        near = [(k, f((k + 0.5 - centre) / wide)) for k in range(max(0, math.floor(centre - support * wide)), min(size, math.ceil(centre + support * wide)))]
        total = sum(w for _, w in near)
        rows.append([(k, w / total) for k, w in near if w])
    return rows


def resized(pixels: Column, size: int, out: int, name: str) -> Column:
    """A size x size array as out x out: one weight row for each sample, both axes at once, rounded and clamped. The
    weights are constants of the plan; for tiles of hundreds of pixels use the pandas form in tile_resize."""
    rows = kernel_weights(name, size, out)
    cells = []
    for y in range(out):
        for x in range(out):
            total = F.lit(0.0)
            for ky, wy in rows[y]:
                for kx, wx in rows[x]:
                    total = total + F.get(pixels, F.lit(ky * size + kx)) * F.lit(wy * wx)
            cells.append(byte(F.floor(total + 0.5)))
    return F.array(*cells)


def quad_canvas(quad: Column, size: int) -> Column:
    """Four tiles of size x size on a canvas of twice that; a missing one is black."""
    side = 2 * size

    def pixel(i: Column) -> Column:
        y, x = F.floor(i / side), i % side
        tile = F.get(quad, (F.floor(y / size) * 2 + F.floor(x / size)).cast("int"))
        return F.coalesce(F.get(tile, (y % size * size + x % size).cast("int")), F.lit(0))

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), pixel)


def box_halved(pixels: Column, side: int) -> Column:
    """Means of 2 x 2 boxes, rounded half up."""
    half = side // 2

    def mean(i: Column) -> Column:
        at = F.floor(i / half) * 2 * side + i % half * 2
        total = sum((F.get(pixels, (at + d).cast("int")) for d in (1, side, side + 1)), F.get(pixels, at.cast("int")))
        return F.floor((total + 2) / 4).cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), mean)


def matrix_bake(r: Column, g: Column, b: Column, matrix: list[list[float]], gamma: float) -> Column:
    """struct<r, g, b> in sRGB of a matrix profile: a power curve to linear light, 3 x 3 to sRGB primaries, sRGB curve."""
    linear = [F.pow(c / 255.0, F.lit(gamma)) for c in (r, g, b)]

    def encoded(row: list[float]) -> Column:
        v = F.least(F.greatest(linear[0] * row[0] + linear[1] * row[1] + linear[2] * row[2], F.lit(0.0)), F.lit(1.0))
        return byte(F.floor(F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055) * 255 + 0.5))

    return F.struct(*(encoded(row).alias(c) for row, c in zip(matrix, "rgb")))


def painted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The last of the placements over each pixel: for rows (keys, px, py, seq, value)."""
    return cells.groupBy(*keys, "px", "py").agg(F.max_by("value", "seq").alias("value"))
