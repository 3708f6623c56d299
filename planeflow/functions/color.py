"""Colour functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BAYER_2, BAYER_4

#: Linear sRGB to cone response, and its cube root to Oklab; then the way back.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def _apply(matrix, values: list[Column]) -> list[Column]:
    return [sum((v * k for v, k in zip(values[1:], row[1:], strict=True)), values[0] * row[0]) for row in matrix]


def linear(c: Column) -> Column:
    x = c / 255.0
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> Column:
    lms = [F.cbrt(x) for x in _apply(TO_LMS, [linear(c) for c in (r, g, b)])]
    return F.struct(*(x.alias(n) for x, n in zip(_apply(TO_LAB, lms), "Lab", strict=True)))


def srgb(lab: Column) -> Column:
    lms = [x * x * x for x in _apply(FROM_LAB, [lab[n] for n in "Lab"])]

    def gamma(c: Column) -> Column:
        x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
        return F.floor(F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055) * 255 + 0.5).cast("int")

    return F.struct(*(gamma(x).alias(n) for x, n in zip(_apply(FROM_LMS, lms), "rgb", strict=True)))


def dist2(p: Column, q: Column) -> Column:
    return sum(((p[n] - q[n]) * (p[n] - q[n]) for n in "ab"), (p["L"] - q["L"]) * (p["L"] - q["L"]))


def rgb444(r: Column, g: Column, b: Column) -> Column:
    """0x0RGB: each channel is rounded to a nibble."""
    nibble = lambda c: F.floor((c * 15 + 127) / 255).cast("int")
    return F.shiftleft(nibble(r), 8).bitwiseOR(F.shiftleft(nibble(g), 4)).bitwiseOR(nibble(b))


def rgb_of(c: Column) -> Column:
    return F.struct(*((F.shiftright(c, s).bitwiseAND(15) * 17).alias(n) for s, n in ((8, "r"), (4, "g"), (0, "b"))))


def half_bright(c: Column) -> Column:
    """Extra half-brite: every nibble halved."""
    return F.shiftright(c, 1).bitwiseAND(0x777)


def dither(x: Column, y: Column, size: int = 4) -> Column:
    """The ordered threshold at a pixel, as a rank."""
    table = F.array(*map(F.lit, BAYER_4 if size == 4 else BAYER_2))
    return F.get(table, F.pmod(y, F.lit(size)) * size + F.pmod(x, F.lit(size)))
