"""Column expressions for pixel values. All compute in doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RGB = ("r", "g", "b")

# Matrices (row-major) between working spaces, luma weights, and the PQ curve's constants.
D50_TO_D65 = (0.9555766, -0.0230393, 0.0631636, -0.0282895, 1.0099416, 0.0210077, 0.0122982, -0.0204830, 1.3299098)
XYZ_D65_TO_REC2020 = (1.7166512, -0.3556708, -0.2533663, -0.6666844, 1.6164812, 0.0157685, 0.0176399, -0.0427706, 0.9421031)
REC2020_TO_REC709 = (1.660491, -0.587641, -0.072850, -0.124550, 1.132900, -0.008349, -0.018151, -0.100579, 1.118730)
LUMA_709 = (0.2126, 0.7152, 0.0722)
LUMA_2020 = (0.2627, 0.6780, 0.0593)
PQ_M1, PQ_M2, PQ_C1, PQ_C2, PQ_C3 = 0.1593017578125, 78.84375, 0.8359375, 18.8515625, 18.6875


def matmul(a: tuple[float, ...], b: tuple[float, ...]) -> tuple[float, ...]:
    return tuple(sum(a[3 * i + k] * b[3 * k + j] for k in range(3)) for i in range(3) for j in range(3))


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def f16(v: Column) -> Column:
    """The nearest half-precision value, ties to even; from 65520 on infinite, as is what was, and NaN stays."""
    ulp = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(v))), F.lit(-14)) - 10)
    return F.when(v == 0, F.lit(0.0)).when(F.isnan(v), v).when(F.abs(v) >= 65520, F.signum(v) * F.lit(float("inf"))).otherwise(F.rint(v / ulp) * ulp)


def cfa_site(pattern: Column, y: Column, x: Column) -> Column:
    """Colour (0 red, 1 green, 2 blue) of a 2x2 filter array at a place; negative places too."""
    return F.get(pattern, (F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2))).cast("int"))


def transform(m: tuple[float, ...], r: Column, g: Column, b: Column) -> list[Column]:
    return [r * m[3 * i] + g * m[3 * i + 1] + b * m[3 * i + 2] for i in range(3)]


def luma(weights: tuple[float, float, float], r: Column, g: Column, b: Column) -> Column:
    return r * weights[0] + g * weights[1] + b * weights[2]


def srgb_encode(v: Column) -> Column:
    """Linear to the sRGB curve with the derivative-matched linear part."""
    knee = 0.055 / (2.4 - 1)
    slope = (0.055 / 1.4) ** -1 * (0.055 * 2.4 / (1.4 * 1.055)) ** 2.4
    return F.when(v <= knee / slope, v * slope).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def pq_encode(v: Column) -> Column:
    """Light in units of 100 nits to the PQ signal."""
    p = F.pow(F.greatest(v, F.lit(0.0)) / 100, F.lit(PQ_M1))
    return F.pow((p * PQ_C2 + PQ_C1) / (p * PQ_C3 + 1), F.lit(PQ_M2))


def pq_decode(v: Column) -> Column:
    """The PQ signal to nits."""
    p = F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / PQ_M2))
    return F.pow(F.greatest(p - PQ_C1, F.lit(0.0)) / (F.lit(PQ_C2) - p * PQ_C3), F.lit(1 / PQ_M1)) * 10000


def quantise(v: Column, top: int) -> Column:
    """[0, 1] to an integer up to ``top``, halves away from zero."""
    return F.floor(clamp(v) * top + 0.5).cast("int")


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def mean(values: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, values) / len(values)
