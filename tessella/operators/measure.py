"""Aggregates over images: white balance, chroma planes, light levels and quality."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import pixel as P
from tessella.operators.pointwise import NodeError

# Correlated colour temperature of the illuminant codes of raw files.
ILLUMINANT_CCT = {17: 2850.0, 20: 5500.0, 21: 6500.0, 22: 7500.0, 23: 5000.0, 24: 3200.0}


def greyworld(rgba: DataFrame, strict: bool = True) -> DataFrame:
    """``image_id, nr, ng, nb``: each image's neutral from its channel sums.

    An image with a channel that has no light or no finite sum is an error (NEED_METADATA); with ``strict=False`` it has
    no row, which drops its pixels where they are balanced by image.
    """
    return neutral_of(rgba.groupBy("image_id").agg(*[F.sum(c).alias(f"s{c}") for c in P.RGB]), strict)


def neutral_of(sums: DataFrame, strict: bool = True) -> DataFrame:
    """The neutrals of ``sums(image_id, sr, sg, sb)``."""
    usable = F.lit(True)
    for c in P.RGB:  # not a number is larger than all numbers here
        usable = usable & (F.col(f"s{c}") > 0) & (F.col(f"s{c}") < float("inf"))
    usable = F.coalesce(usable, F.lit(False))
    if not strict:
        sums = sums.where(usable)
    checked = lambda v: F.when(usable, v).otherwise(F.raise_error(F.concat(F.lit("NEED_METADATA: no light in a channel of image "), F.col("image_id").cast("string"))).cast("double"))
    return sums.select("image_id", checked(F.col("sr") / F.col("sg")).alias("nr"), F.lit(1.0).alias("ng"), checked(F.col("sb") / F.col("sg")).alias("nb"))


def _locus(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chromaticity of a black body; fixed polynomial values."""
    u = 1000.0 / t
    x = np.where(t < 4000, np.polyval((-0.2661239, -0.2343580, 0.8776956, 0.179910), u), np.polyval((-3.0258469, 2.1070379, 0.2226347, 0.240390), u))
    low, mid, high = (-1.1063814, -1.34811020, 2.18555832, -0.20219683), (-0.9549476, -1.37418593, 2.09137015, -0.16748867), (3.0817580, -5.87338670, 3.75112997, -0.37001483)
    return x, np.where(t < 2222, np.polyval(low, x), np.where(t < 4000, np.polyval(mid, x), np.polyval(high, x)))


def cct_weight(t: np.ndarray, t1: float, t2: float) -> np.ndarray:
    """Share of the first illuminant at a temperature, in reciprocal temperature."""
    return np.clip((1 / t - 1 / t2) / (1 / t1 - 1 / t2), 0, 1) if t1 != t2 else np.ones_like(t)


def scene_cct(neutral: np.ndarray, cm1: np.ndarray, cm2: np.ndarray, t1: float, t2: float) -> float:
    """The temperature between 1500 and 10000 K whose black body lies nearest to the neutral.

    The neutral's chromaticity itself depends on the temperature, by the blend of both colour matrices.
    A grid even in reciprocal temperature is narrowed around its best place until it is finer than 1e-3 K.
    """
    low, high = 1e6 / 10000, 1e6 / 1500
    while True:
        t = 1e6 / np.linspace(low, high, 201)
        w = cct_weight(t, t1, t2)[:, None, None]
        with np.errstate(all="ignore"):
            try:
                xyz = np.linalg.solve(cm1 * w + cm2 * (1 - w), np.broadcast_to(neutral[:, None], (len(t), 3, 1)))[:, :, 0]
            except np.linalg.LinAlgError:
                return float("nan")
            total = xyz.sum(1)
            x, y = _locus(t)
            error = np.where(total > 0, (xyz[:, 0] / total - x) ** 2 + (xyz[:, 1] / total - y) ** 2, np.inf)
        k = int(error.argmin())
        step = (high - low) / 200
        if step * t[k] ** 2 / 1e6 < 1e-3:
            return float(t[k])
        low, high = max(low, 1e6 / t[k] - 2 * step), min(high, 1e6 / t[k] + 2 * step)


def dual_illuminant(image: dict) -> dict:
    """What the white balance tells of an image: ``scene_cct, dual_illuminant_weight, camera_diag, camera_to_xyz_d50``.

    The matrix blends both forward matrices by the weight, or else is the inverse of the blended colour matrices.
    """
    matrices = {k: np.array(image.get(k) or [], float) for k in ("color_matrix1", "color_matrix2", "forward_matrix1", "forward_matrix2")}
    neutral = np.array((image.get("neutral") or [])[:3], float)
    if any(matrices[f"color_matrix{k}"].size != 9 for k in "12"):
        raise NodeError("NEED_METADATA", "colour matrices")
    if any(image.get(f"illuminant{k}") not in ILLUMINANT_CCT for k in "12"):
        raise NodeError("NEED_METADATA", "calibration illuminants")
    if len(neutral) != 3 or not (np.isfinite(neutral) & (neutral > 0)).all():
        raise NodeError("NEED_METADATA", "neutral")
    t1, t2 = (ILLUMINANT_CCT[image[f"illuminant{k}"]] for k in "12")
    cm1, cm2 = (matrices[f"color_matrix{k}"].reshape(3, 3) for k in "12")
    cct = scene_cct(neutral, cm1, cm2, t1, t2)
    if not math.isfinite(cct):
        raise NodeError("NEED_METADATA", "singular colour matrix")
    weight = float(cct_weight(np.array(cct), t1, t2))
    if all(matrices[f"forward_matrix{k}"].size == 9 for k in "12"):
        to_xyz = weight * matrices["forward_matrix1"] + (1 - weight) * matrices["forward_matrix2"]
    else:
        blend = weight * cm1 + (1 - weight) * cm2
        if abs(np.linalg.det(blend)) <= np.finfo(np.float32).eps:
            raise NodeError("NEED_METADATA", "singular colour matrix")
        to_xyz = np.linalg.inv(blend).ravel()
    return {"scene_cct": cct, "dual_illuminant_weight": weight, "camera_diag": (1 / neutral).tolist(), "camera_to_xyz_d50": to_xyz.tolist()}


def white_balance_metadata(images: DataFrame) -> DataFrame:
    """``images`` (with the fields of a raw file) and the columns of ``dual_illuminant``: a search per image, never per pixel."""
    fields = ["neutral", "color_matrix1", "color_matrix2", "forward_matrix1", "forward_matrix2", "illuminant1", "illuminant2"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = [dual_illuminant({k: v if v is None or np.isscalar(v) else list(v) for k, v in r.items()}) for r in rows.to_dict("records")]
        return pd.DataFrame(own, columns=["scene_cct", "dual_illuminant_weight", "camera_diag", "camera_to_xyz_d50"])

    kind = "scene_cct double, dual_illuminant_weight double, camera_diag array<double>, camera_to_xyz_d50 array<double>"
    found = F.pandas_udf(run, kind)
    return images.withColumn("found", found(F.struct(*fields))).select(*images.columns, "found.*")


def scene_temperature(neutrals: DataFrame, cm1: list[float], cm2: list[float], illuminants: tuple[int, int]) -> DataFrame:
    """``neutrals`` with ``cct`` and ``weight``: one small search per image, never per pixel."""
    a, b = np.array(cm1).reshape(3, 3), np.array(cm2).reshape(3, 3)
    t1, t2 = (ILLUMINANT_CCT[k] for k in illuminants)

    def run(parts):
        for pdf in parts:
            cct = np.array([scene_cct(np.array(n, float), a, b, t1, t2) for n in zip(pdf["nr"], pdf["ng"], pdf["nb"], strict=True)])
            yield pdf.assign(cct=cct, weight=cct_weight(cct, t1, t2) if len(cct) else cct)

    return neutrals.mapInPandas(run, "image_id long, nr double, ng double, nb double, cct double, weight double")


def ycbcr420(display: DataFrame, hdr: bool = False) -> tuple[DataFrame, DataFrame]:
    """Full-range luma plane ``image_id, y, x, luma`` and chroma plane ``image_id, cy, cx, cb, cr``, averaged over 2x2.

    At odd edges the mean is over the pixels that exist.
    """
    top, shift, w = (1023, 6, P.LUMA_2020) if hdr else (255, 0, P.LUMA_709)
    r, g, b = (F.shiftright(F.col(c), shift) / top for c in P.RGB)
    luma = P.luma(w, r, g, b)
    px = display.select("image_id", "y", "x", luma.alias("l"), r.alias("r"), b.alias("b"))
    px = px.withColumns({"cb": (F.col("b") - F.col("l")) / (2 * (1 - w[2])), "cr": (F.col("r") - F.col("l")) / (2 * (1 - w[0]))})
    block = [F.floor(F.col(c) / 2).cast("int").alias(f"c{c}") for c in "yx"]
    mid = (top + 1) // 2
    # The places of a block are added in order, whatever the order of rows: a mean between two codes may fall either way.
    place = F.col("y") % 2 * 2 + F.col("x") % 2
    mean = lambda c: sum(F.coalesce(F.sum(F.when(F.col("place") == k, F.col(c))), F.lit(0.0)) for k in range(4)) / F.count(c)
    chroma = px.select("image_id", *block, place.alias("place"), "cb", "cr").groupBy("image_id", "cy", "cx").agg(mean("cb").alias("cb"), mean("cr").alias("cr"))
    code = lambda c: F.greatest(F.lit(0), F.least(F.lit(top), F.floor(F.col(c) * top + mid + 0.5))).cast("int").alias(c)
    return px.select("image_id", "y", "x", P.quantise(F.col("l"), top).alias("luma")), chroma.select("image_id", "cy", "cx", code("cb"), code("cr"))


def light_levels(display: DataFrame) -> DataFrame:
    """``image_id, max_cll, max_fall`` of 10-bit PQ pixels, in whole nits from 1 to 65535."""
    nits = [P.pq_decode(F.shiftright(F.col(c), 6) / 1023) for c in P.RGB]
    px = display.select("image_id", F.greatest(*nits).alias("m"), P.luma(P.LUMA_2020, *nits).alias("l"))
    whole = lambda c: F.least(F.lit(65535), F.greatest(F.lit(1), F.floor(c + 0.5))).cast("int")
    return px.groupBy("image_id").agg(whole(F.max("m")).alias("max_cll"), whole(F.avg("l")).alias("max_fall"))


def psnr(a: DataFrame, b: DataFrame, peak: float = 1.0) -> DataFrame:
    """``image_id, psnr`` of two images; null where they are identical."""
    other = b.select("image_id", "y", "x", *[F.col(c).alias(f"o{c}") for c in P.RGB])
    error = sum((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in P.RGB) / 3
    mse = a.join(other, ["image_id", "y", "x"]).groupBy("image_id").agg(F.avg(error).alias("mse"))
    return mse.select("image_id", F.when(F.col("mse") > 0, F.log10(F.lit(peak * peak) / F.col("mse")) * 10).alias("psnr"))


def thumbnail(rgba: DataFrame, factor: int) -> DataFrame:
    """Means over ``factor`` x ``factor`` blocks."""
    block = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in "yx"]
    return rgba.select("image_id", *block, *P.RGB, "a").groupBy("image_id", "y", "x").agg(*[F.avg(c).alias(c) for c in (*P.RGB, "a")])
