"""Nodes that need one pixel at a time: projections over ``mosaic(image_id, y, x, v)`` or ``rgba(image_id, y, x, r, g, b, a)``."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions import pixel as P

KEYS = ("image_id", "y", "x")


class NodeError(ValueError):
    """A node can't run on its input; ``code`` names why."""

    def __init__(self, code: str, said: str) -> None:
        super().__init__(f"{code}: {said}")
        self.code = code


def each(rgba: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return rgba.withColumns({c: f(F.col(c)) for c in P.RGB})


def passthrough(rgba: DataFrame) -> DataFrame:
    return rgba.select("*")


def linearize(mosaic: DataFrame, table: list[int]) -> DataFrame:
    """Codes through a table; codes past its end take the last entry."""
    if not table:
        raise NodeError("NEED_METADATA", "empty linearization table")
    entries = F.array(*[F.lit(float(t)) for t in table])
    return mosaic.withColumn("v", F.get(entries, F.least(F.col("v").cast("int"), F.lit(len(table) - 1))))


def black_white(mosaic: DataFrame, black: list[float], white: float, cfa: list[int]) -> DataFrame:
    """Scales each site from its colour's black level to white, clamped to [0, 1]. Levels go by colour, not by site."""
    used = {black[min(c, 3)] for c in cfa}
    if len(cfa) != 4 or any(white - b <= 0 for b in used):
        raise NodeError("NEED_METADATA", "levels or filter array")
    levels = F.array(*[F.lit(float(black[min(c, 3)])) for c in cfa])
    own = P.cfa_site(levels, F.col("y"), F.col("x"))
    return mosaic.withColumn("v", P.clamp((F.col("v") - own) / (F.lit(float(white)) - own)))


def gain_map(mosaic: DataFrame, maps: dict[int, dict], repeat: int = 2) -> DataFrame:
    """Multiplies by a bilinearly sampled gain. One map serves all sites; of four, the site's place in the array selects.

    A map has ``points`` (rows, columns), ``spacing``, ``origin`` and row-major ``gain``, in pixel units.
    """
    if len(maps) not in (1, 4):
        raise NodeError("BAD_INDEX", "one or four maps")
    y, x = F.col("y"), F.col("x")

    def axis(at: Column, n: int, spacing: float, origin: float) -> tuple[Column, Column, Column]:
        g = F.least(F.greatest((at - F.lit(float(origin))) / F.lit(float(spacing)), F.lit(0.0)), F.lit(float(n - 1)))
        low = F.floor(g).cast("int")
        return low, F.least(low + 1, F.lit(n - 1)), g - low

    def gain(m: dict) -> Column:
        rows, columns = m["points"]
        values = F.array(*[F.lit(float(v)) for v in m["gain"]])
        y0, y1, ty = axis(y, rows, m["spacing"][0], m["origin"][0])
        x0, x1, tx = axis(x, columns, m["spacing"][1], m["origin"][1])
        pick = lambda a, b: F.get(values, a * columns + b)
        return P.lerp(P.lerp(pick(y0, x0), pick(y0, x1), tx), P.lerp(pick(y1, x0), pick(y1, x1), tx), ty)

    if len(maps) == 1:
        return mosaic.withColumn("v", F.col("v") * gain(next(iter(maps.values()))))
    if repeat == 4:
        plane = F.floor(F.pmod(y, F.lit(4)) / 2) * 2 + F.floor(F.pmod(x, F.lit(4)) / 2)
    else:
        plane = F.pmod(y, F.lit(2)) * 2 + F.pmod(x, F.lit(2))
    out = F.lit(None).cast("double")
    for k, m in sorted(maps.items()):
        out = F.when(plane == k, gain(m)).otherwise(out)
    return mosaic.withColumn("v", F.col("v") * out)


def white_balance(rgba: DataFrame, neutral: tuple[float, float, float]) -> DataFrame:
    if not all(math.isfinite(n) and n > 0 for n in neutral):
        raise NodeError("NEED_METADATA", "neutral")
    return rgba.withColumns({c: F.col(c) / F.lit(float(n)) for c, n in zip(P.RGB, neutral, strict=True)})


def white_balance_by_image(rgba: DataFrame, neutrals: DataFrame) -> DataFrame:
    """Divides by each image's own ``neutrals(image_id, nr, ng, nb)``."""
    out = rgba.join(neutrals, "image_id")
    return out.withColumns({c: F.col(c) / F.col(f"n{c}") for c in P.RGB}).select(*rgba.columns)


def color_matrix(rgba: DataFrame, camera_to_xyz_d50: tuple[float, ...]) -> DataFrame:
    m = P.matmul(P.XYZ_D65_TO_REC2020, P.matmul(P.D50_TO_D65, camera_to_xyz_d50))
    return rgba.withColumns(dict(zip(P.RGB, P.transform(m, *map(F.col, P.RGB)), strict=True)))


def reinhard(rgba: DataFrame, white_point: float | None = None) -> DataFrame:
    w = 1e6 if white_point is None or white_point < 0 else min(10.0, max(0.1, white_point))

    def f(v: Column) -> Column:
        v = F.greatest(v, F.lit(0.0))
        return P.clamp(v * (v / F.lit(w * w) + 1) / (v + 1))

    return each(rgba, f)


def aces_filmic(rgba: DataFrame, toggle: bool = True) -> DataFrame:
    if not toggle:
        return rgba
    return each(rgba, lambda v: P.clamp(v * (v * 2.51 + 0.03) / (v * (v * 2.43 + 0.59) + 0.14)))


def filmic_rgb(rgba: DataFrame, ev: float = 0.0, contrast: float = 1.0, saturation: float = 1.0, highlights: float = 1.0, shadows: float = 1.0) -> DataFrame:
    """A fixed logarithmic curve, then contrast, highlights and shadows, then saturation about Rec.709 luma."""

    def tone(v: Column) -> Column:
        c = P.clamp(F.log(F.greatest(v * 2.0**ev, F.lit(0.0)) * 6 + 1) / math.log(1 + 6 * 18))
        c = F.pow(c, F.lit(1.0 / contrast))
        return P.clamp(c + (1 - c) * (1 - c) * ((shadows - 1) * 0.08) + c * c * ((highlights - 1) * 0.08))

    toned = each(rgba, tone)
    y = P.luma(P.LUMA_709, *map(F.col, P.RGB))
    return toned.withColumn("_y", y).withColumns({c: P.clamp(F.col("_y") + (F.col(c) - F.col("_y")) * float(saturation)) for c in P.RGB}).drop("_y")


def mertens(under: DataFrame, normal: DataFrame, over: DataFrame, weight_contrast: float = 0.0, weight_saturation: float = 1.0, weight_exposedness: float = 1.0) -> DataFrame:
    """Exposure fusion of three images of the same size, pixel by pixel."""

    def weight(p: str) -> Column:
        r, g, b = (F.col(f"{p}_{c}") for c in P.RGB)
        m = (r + g + b) / 3
        spread = F.sqrt(((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3 + 1e-4)
        well = F.lit(1.0)
        for v in (r, g, b):
            well = well * F.exp(-(v - 0.5) * (v - 0.5) / 0.08)
        contrast = F.lit(1.0) if weight_contrast == 0 else F.pow(F.abs(m - 0.5) + 0.01, F.lit(float(weight_contrast)))
        exposed = well if weight_exposedness == 1 else F.pow(well + 1e-4, F.lit(float(weight_exposedness)))
        return contrast * F.pow(spread + 0.01, F.lit(float(weight_saturation))) * exposed

    parts = {"u": under, "n": normal, "o": over}
    sides = [d.select(*KEYS, *[F.col(c).alias(f"{p}_{c}") for c in (*P.RGB, "a")]) for p, d in parts.items()]
    out = sides[0].join(sides[1], list(KEYS)).join(sides[2], list(KEYS))
    out = out.withColumns({f"w_{p}": weight(p) for p in parts})
    total = F.greatest(F.col("w_u") + F.col("w_n") + F.col("w_o"), F.lit(1e-6))
    blend = [P.clamp(sum(F.col(f"w_{p}") * F.col(f"{p}_{c}") for p in parts) / total).alias(c) for c in P.RGB]
    return out.select(*KEYS, *blend, F.col("n_a").alias("a"))


def fuse_reference(ref: DataFrame, frame: DataFrame) -> DataFrame:
    """The burst stage as it stands: the reference frame."""
    return ref.select("*")


def lut3d(rgba: DataFrame, size: int, values: list[float] | Callable[[Column, Column, Column], list[Column]], interpolation: str = "tetrahedral") -> DataFrame:
    """A 3D table with red slowest and blue fastest, as an array or as a function of the grid indices.

    An array goes to the tasks once, as a broadcast of at most 256**3 rows, and is looked up there by batch.
    """
    if interpolation not in ("tetrahedral", "trilinear"):
        raise NodeError("BAD_INDEX", interpolation)
    if not callable(values):
        shared = rgba.sparkSession.sparkContext.broadcast(np.asarray(values, float).reshape(size, size, size, 3))

        def looked_up(r: pd.Series, g: pd.Series, b: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(table_lookup(shared.value, np.stack([r, g, b]).astype(float), interpolation).T, columns=list(P.RGB))

        found = F.pandas_udf(looked_up, "r double, g double, b double")
        out = rgba.withColumn("_lut", found(*P.RGB))
        return out.withColumns({c: F.col("_lut")[c] for c in P.RGB}).select(*rgba.columns)
    at = values
    scaled = rgba.withColumns({f"_{c}": P.clamp(F.col(c)) * (size - 1) for c in P.RGB})
    scaled = scaled.withColumns({f"_{c}0": F.least(F.floor(F.col(f"_{c}")), F.lit(size - 2)) for c in P.RGB})
    scaled = scaled.withColumns({f"_d{c}": F.col(f"_{c}") - F.col(f"_{c}0") for c in P.RGB})
    base, d = [F.col(f"_{c}0") for c in P.RGB], dict(zip(P.RGB, [F.col(f"_d{c}") for c in P.RGB], strict=True))
    corner = {(i, j, k): at(base[0] + i, base[1] + j, base[2] + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)}
    out = {}
    for n, c in enumerate(P.RGB):
        if interpolation == "trilinear":
            plane = {(j, k): P.lerp(corner[0, j, k][n], corner[1, j, k][n], d["r"]) for j in (0, 1) for k in (0, 1)}
            line = {k: P.lerp(plane[0, k], plane[1, k], d["g"]) for k in (0, 1)}
            out[c] = P.clamp(P.lerp(line[0], line[1], d["b"]))
            continue
        # From corner to corner along the axes, the one with the largest remainder first.
        value = None
        for order in ("bgr", "gbr", "grb", "brg", "rbg", "rgb"):
            at_, path = [0, 0, 0], corner[0, 0, 0][n]
            for axis in order:
                before = tuple(at_)
                at_["rgb".index(axis)] = 1
                path = path + (corner[tuple(at_)][n] - corner[before][n]) * d[axis]
            value = path if value is None else F.when((d[order[0]] >= d[order[1]]) & (d[order[1]] >= d[order[2]]), path).otherwise(value)
        out[c] = P.clamp(value)
    return scaled.withColumns(out).select(*rgba.columns)


def table_lookup(table: np.ndarray, v: np.ndarray, interpolation: str) -> np.ndarray:
    """Values (3, ...) in [0, 1] through a table (size, size, size, 3)."""
    size = len(table)
    at = np.clip(v, 0, 1) * (size - 1)
    low = np.minimum(np.floor(at).astype(int), size - 2)
    d = at - low
    corner = lambda i, j, k: np.moveaxis(table[low[0] + i, low[1] + j, low[2] + k], -1, 0)
    if interpolation == "trilinear":
        mix = lambda a, b, t: a + (b - a) * t
        plane = {(j, k): mix(corner(0, j, k), corner(1, j, k), d[0]) for j in (0, 1) for k in (0, 1)}
        return np.clip(mix(*(mix(plane[0, k], plane[1, k], d[1]) for k in (0, 1)), d[2]), 0, 1)
    # From corner to corner along the axes, the one with the largest remainder first.
    order = np.argsort(-d, axis=0, kind="stable")
    on = np.zeros(d.shape, int)
    out = before = corner(0, 0, 0)
    for step in range(3):
        np.put_along_axis(on, order[step][None], 1, 0)
        after = corner(*on)
        out = out + (after - before) * np.take_along_axis(d, order[step][None], 0)
        before = after
    return np.clip(out, 0, 1)


def to_display(rgba: DataFrame, target: str = "sRGB") -> DataFrame:
    """Scene-linear Rec.2020 to 8-bit sRGB, or to 10-bit PQ in the high bits of 16."""
    if target in ("DisplayP3", "BT2020-HLG"):
        raise NodeError("UNSUPPORTED", target)
    if target == "sRGB":
        rgb = [P.quantise(P.srgb_encode(P.clamp(v)), 255) for v in P.transform(P.REC2020_TO_REC709, *map(F.col, P.RGB))]
        alpha = P.quantise(F.col("a"), 255)
    elif target == "BT2020-PQ":
        rgb = [P.quantise(P.pq_encode(P.clamp(F.col(c))), 1023) * 64 for c in P.RGB]
        alpha = P.quantise(F.col("a"), 1023) * 64
    else:
        raise NodeError("BAD_INDEX", target)
    return rgba.withColumns({**dict(zip(P.RGB, rgb, strict=True)), "a": alpha})


def precision_convert(df: DataFrame, target: str) -> DataFrame:
    if target == "R32_SFLOAT":
        return df.withColumn("v", F.col("v").cast("double"))
    if target == "R16G16B16A16_SFLOAT":
        return df.select(*KEYS, *[P.f16(F.col("v")).alias(c) for c in P.RGB], F.lit(1.0).alias("a"))
    top = {"R8G8B8A8_UNORM": 255, "R16G16B16A16_UNORM": 65535}.get(target)
    if top is None:
        raise NodeError("BAD_PRECISION", target)
    return df.withColumns({c: P.quantise(F.col(c), top) for c in (*P.RGB, "a")})


def store_f16(rgba: DataFrame) -> DataFrame:
    return rgba.withColumns({c: P.f16(F.col(c)) for c in (*P.RGB, "a")})


# Lens opcodes that need no neighbours.


def vignette(rgba: DataFrame, k: list[float], height: int, width: int, cx: float = 0.5, cy: float = 0.5) -> DataFrame:
    x0, y0 = cx * (width - 1), cy * (height - 1)
    m2 = max((x - x0) ** 2 + (y - y0) ** 2 for x in (0, width - 1) for y in (0, height - 1))
    r2 = ((F.col("x") - x0) * (F.col("x") - x0) + (F.col("y") - y0) * (F.col("y") - y0)) / m2
    gain, power = F.lit(1.0), r2
    for c in k:
        gain, power = gain + power * float(c), power * r2
    return each(rgba, lambda v: v * gain)


def trim_bounds(rgba: DataFrame, top: int, left: int, bottom: int, right: int) -> DataFrame:
    inside = (F.col("y") >= top) & (F.col("y") < bottom) & (F.col("x") >= left) & (F.col("x") < right)
    return rgba.withColumns({c: F.when(inside, F.col(c)).otherwise(F.lit(0.0)) for c in (*P.RGB, "a")})
