"""Graph nodes over tiles: what each node type does to a ``Frame``, with the calibration that its images carry."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import pixel as P
from tessella.operators import measure as M
from tessella.operators import stencil as S
from tessella.operators.pointwise import NodeError, table_lookup
from tessella.sources import dng, rasters

#: Rows and columns of a tile. Images up to this size are one tile, and need no exchange of halos.
TILE = 256

# The filter arrays that can be demosaiced, and the one that is remosaiced.
BAYER = ([0, 1, 1, 2], [2, 1, 1, 0], [1, 0, 2, 1], [1, 2, 0, 1])
QUAD_BAYER = [0, 0, 1, 1, 0, 0, 1, 1, 1, 1, 2, 2, 1, 1, 2, 2]


def is_bayer(repeat: Column, pattern: Column) -> Column:
    """Whether an image's filter array is one that can be demosaiced."""
    known = F.array(*[F.array(*[F.lit(v) for v in b]) for b in BAYER])
    return (repeat == F.array(F.lit(2), F.lit(2))) & F.array_contains(known, F.slice(pattern, 1, 4))


def is_quad_bayer(repeat: Column, pattern: Column) -> Column:
    return (repeat == F.array(F.lit(4), F.lit(4))) & (pattern == F.array(*[F.lit(v) for v in QUAD_BAYER]))


@dataclass(frozen=True)
class Frame:
    """Images on their way through a graph: their ``tiles``, and the table ``images(image_id, height, width, meta)``.

    ``meta`` is JSON with the image's calibration and capture fields, as in ``dng.SCHEMA``; tiles have it too. ``split``
    is the size of the tiles where some image has more than one, else 0. Kernels that need no exchange wait in ``steps``,
    to be run in one pass by one worker a task, whatever the length of the graph.
    """

    source: DataFrame
    images: DataFrame
    split: int = 0
    steps: S.Steps = ()

    @property
    def tiles(self) -> DataFrame:
        return S.chain(self.source, self.steps) if self.steps else self.source

    def each(self, kernel: S.Kernel, radius: int = 0) -> Frame:
        if radius and self.split:
            return self.of(S.stencil(self.source, kernel, radius, self.split, self.steps))
        return replace(self, steps=(*self.steps, (kernel, radius)))

    def of(self, tiles: DataFrame) -> Frame:
        """The same images with other tiles."""
        return replace(self, source=tiles, steps=())


def raw_frame(images: DataFrame, planes: Column, height: int, width: int) -> Frame:
    """A frame of ``images``, each a row with its samples in ``planes`` and ``meta`` as JSON."""
    table = images.select(F.col("image_id").cast("long"), F.lit(height).alias("height"), F.lit(width).alias("width"), "meta")
    return Frame(S.image_tiles(images, [planes], height, width, F.col("meta")), table)


def dng_frame(files: DataFrame, size: int = TILE) -> Frame:
    """A frame of DNG files (``path, content``), cut into tiles where each file is read."""
    images = dng.headers(files)
    images = images.select("image_id", "height", "width", meta_json(images).alias("meta"))
    several = images.where((F.col("height") > size) | (F.col("width") > size)).limit(1).count()
    tiles = dng.tiles(files, size)
    return Frame(tiles.select(*[c for c in S.COLUMNS if c != "meta"], meta_json(tiles).alias("meta")), images, size if several else 0)


def dng_input(source: object, params: dict) -> Frame:
    """The source node: the files at ``path``, whatever the graph was given."""
    if not params.get("path"):
        raise NodeError("NOT_FOUND", "path")
    return dng_frame(dng.read_dng(SparkSession.active(), params["path"]))


def meta_json(images: DataFrame) -> Column:
    """The columns of ``dng.META`` that ``images`` has, as JSON."""
    return F.to_json(F.struct(*[c for c in images.columns if c in dng.META]))


@lru_cache(256)
def _meta(said: str | None) -> dict:
    out = json.loads(said) if said else {}
    return out | {k: base64.b64decode(out[k]) for k in ("opcode2", "opcode3") if out.get(k)}


def _said(meta: dict) -> str:
    return json.dumps({k: base64.b64encode(v).decode() if isinstance(v, bytes) else v for k, v in meta.items()})


def f16(p: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return p.astype(np.float16).astype(float)


def _stored(kernel: S.Kernel) -> S.Kernel:
    """The kernel with its planes rounded to half floats."""

    def run(*a):
        out = kernel(*a)
        return (f16(out[0]), out[1]) if isinstance(out, tuple) else f16(out)

    return run


def _rgb(f: Callable[[np.ndarray], np.ndarray]) -> S.Kernel:
    return _stored(lambda p, *_: np.concatenate((f(p[:3]), p[3:])))


def _matrix(m: tuple[float, ...], p: np.ndarray) -> np.ndarray:
    return np.tensordot(np.asarray(m).reshape(3, 3), p, 1)


# Raw stages.


def linearize(frame: Frame, params: dict) -> Frame:
    def run(p, y, x, height, width, meta):
        table = _meta(meta).get("linearization") or []
        if not table:
            raise NodeError("NEED_METADATA", "empty linearization table")
        return np.asarray(table, float)[np.clip(p.astype(int), 0, len(table) - 1)]

    return frame.each(run)


def _sites(meta: dict, shape: tuple[int, ...], y: int, x: int) -> np.ndarray:
    """Colour of each place by the image's filter array."""
    rows, columns = meta["cfa_repeat"]
    own = np.asarray(meta["cfa_pattern"][: rows * columns]).reshape(rows, columns)
    return own[(np.arange(shape[-2]) + y)[:, None] % rows, (np.arange(shape[-1]) + x)[None, :] % columns]


def black_level(frame: Frame, params: dict) -> Frame:
    def run(p, y, x, height, width, meta):
        m = _meta(meta)
        if m.get("cfa_repeat") != [2, 2] or not m.get("white"):
            raise NodeError("NEED_METADATA", "levels or filter array")
        levels = np.zeros(4)
        levels[: len(m.get("black", [])[:4])] = m.get("black", [])[:4]
        black = levels[np.minimum(_sites(m, p.shape, y, x), 3)]
        if (m["white"] - levels[np.minimum(m["cfa_pattern"][:4], 3)] <= 0).any():
            raise NodeError("NEED_METADATA", "levels")
        return np.clip((p - black) / (m["white"] - black), 0, 1)

    return frame.each(run)


def shading_gain(frame: Frame, params: dict) -> Frame:
    """Gains of opcode list 2: one map for all sites, or four by the site's place in the array; without maps a copy."""

    def sampled(g: dict, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
        rows, columns = g["points"]
        values = np.asarray(g["gain"], float).reshape(rows, columns)
        parts = []
        for at, n, spacing, origin in ((ys, rows, g["spacing"][0], g["origin"][0]), (xs, columns, g["spacing"][1], g["origin"][1])):
            place = np.clip((at - origin) / spacing, 0, n - 1)
            low = np.floor(place).astype(int)
            parts.append((low, np.minimum(low + 1, n - 1), place - low))
        (y0, y1, ty), (x0, x1, tx) = parts
        top = values[y0][:, x0] + (values[y0][:, x1] - values[y0][:, x0]) * tx
        bottom = values[y1][:, x0] + (values[y1][:, x1] - values[y1][:, x0]) * tx
        return top + (bottom - top) * ty[:, None]

    def run(p, y, x, height, width, meta):
        m = _meta(meta)
        if not m.get("cfa_pattern"):
            raise NodeError("NEED_METADATA", "filter array")
        maps = dng.gain_maps(m.get("opcode2") or b"")
        if not maps:
            return p
        ys, xs = np.arange(p.shape[-2]) + y, np.arange(p.shape[-1]) + x
        if len(maps) == 1 and maps[0]["planes"] == 1:
            return p * sampled(maps[0], ys, xs)
        if sorted(g["plane"] for g in maps) != [0, 1, 2, 3] or any(g["planes"] != 4 for g in maps):
            raise NodeError("UNSUPPORTED", "gain map planes")
        wide = m["cfa_repeat"][0] // 2
        plane = (ys // wide % 2)[:, None] * 2 + (xs // wide % 2)[None, :]
        return p * np.choose(plane, [sampled(g, ys, xs) for g in sorted(maps, key=lambda g: g["plane"])])

    return frame.each(run)


def remosaic(frame: Frame, params: dict) -> Frame:
    """Quad-Bayer codes to a 2x2 array; images that have one already pass through."""

    def run(p, y, x, height, width, meta):
        m = _meta(meta)
        if m.get("cfa_repeat") == [2, 2]:
            return p[..., 3:-3, 3:-3]
        if m.get("cfa_repeat") != [4, 4] or m.get("cfa_pattern") != QUAD_BAYER:
            raise NodeError("UNSUPPORTED", "filter array")
        return S.remosaic(p, y, x, height, width), _said(m | {"cfa_repeat": [2, 2], "cfa_pattern": [0, 1, 1, 2]})

    return frame.each(run, 3)


def demosaic(kernel: Callable[[list[int]], S.Kernel], radius: int) -> Callable[[Frame, dict], Frame]:
    def node(frame: Frame, params: dict) -> Frame:
        def run(p, y, x, height, width, meta):
            m = _meta(meta)
            if m.get("cfa_repeat") != [2, 2] or m.get("cfa_pattern", [])[:4] not in BAYER:
                raise NodeError("UNSUPPORTED", "filter array")
            return f16(kernel(m["cfa_pattern"][:4])(p, y, x, height, width))

        return frame.each(run, radius)

    return node


# Lens opcodes.


def lens_opcodes(frame: Frame, params: dict) -> Frame:
    """The opcodes of list 3 in their order, each on what the one before it made; images without a list pass through.

    Which opcodes there are at each place of the lists is asked of the image table, a few rows; so only steps in which
    some image warps or patches pixels exchange tiles.
    """

    def kinds(batches):
        for batch in batches:
            rows = {(k, op["id"]) for said in batch.column(0).to_pylist() for k, op in enumerate(_ops(said))}
            yield pa.record_batch([pa.array([k for k, _ in rows], pa.int32()), pa.array([i for _, i in rows], pa.int32())], names=["k", "id"])

    found: dict[int, set[int]] = {}
    for r in frame.images.select("meta").mapInArrow(kinds, "k int, id int").distinct().collect():  # list places times six at most
        found.setdefault(r.k, set()).add(r.id)
    for k in sorted(found):
        frame = _opcode(frame, k, found[k])
    return frame


@lru_cache(256)
def _ops(said: str | None) -> list[dict]:
    return dng.lens_opcodes(_meta(said).get("opcode3") or b"")


def _opcode(frame: Frame, k: int, kinds: set[int]) -> Frame:
    def own(meta: str | None) -> dict:
        ops = _ops(meta)
        return ops[k] if k < len(ops) else {"id": 0}

    split = frame.split
    if 1 in kinds and split:

        def reach(row):
            op = own(row.meta)
            return S.Warp(op["coefficients"], op["cx"], op["cy"]).reach(row) if op["id"] == 1 else (row.y0, row.x0, row.y0 + row.h, row.x0 + row.w)

        def warp(row, canvas, y, x):
            op, ys, xs = own(row.meta), np.arange(row.y0, row.y0 + row.h), np.arange(row.x0, row.x0 + row.w)
            if op["id"] != 1:
                return canvas[..., ys - y, :][..., xs - x]
            return f16(S.Warp(op["coefficients"], op["cx"], op["cy"]).sampled(canvas, y, x, ys, xs, row.height, row.width))

        frame = frame.of(S.gather(frame.source, split, reach, warp, frame.steps))
        kinds = kinds - {1}

    halo = 1 if kinds & {4, 5} else 0

    def run(p, y, x, height, width, meta):
        op = own(meta)
        inner = p[..., halo : p.shape[-2] - halo, halo : p.shape[-1] - halo]
        ys, xs = np.arange(inner.shape[-2]) + y + halo, np.arange(inner.shape[-1]) + x + halo
        if op["id"] == 1 and not split:
            return f16(S.Warp(op["coefficients"], op["cx"], op["cy"]).sampled(inner, 0, 0, ys, xs, height, width))
        if op["id"] == 3:
            x0, y0 = op["cx"] * (width - 1), op["cy"] * (height - 1)
            m2 = max((a - x0) ** 2 + (b - y0) ** 2 for a in (0, width - 1) for b in (0, height - 1))
            r2 = ((ys - y0) ** 2)[:, None] + ((xs - x0) ** 2)[None, :]
            r2 = r2 / m2 if m2 else np.zeros_like(r2)
            gain = 1 + r2 * np.polynomial.polynomial.polyval(r2, op["k"])
            return f16(np.concatenate((inner[:3] * gain, inner[3:])))
        if op["id"] == 4:
            return f16(S.bad_pixels(constant=float(op["constant"]))(p, y, x, height, width))
        if op["id"] == 5:
            return f16(S.bad_pixels(op["points"], op["rects"])(p, y, x, height, width))
        if op["id"] == 6:
            inside = ((ys >= op["top"]) & (ys < op["bottom"]))[:, None] & ((xs >= op["left"]) & (xs < op["right"]))[None, :]
            return np.where(inside, inner, 0.0)
        return inner

    return frame.each(run, halo) if kinds else frame


# White balance and colour.


@lru_cache(256)
def _balanced(said: str | None) -> tuple[list[float], str]:
    """An image's neutral, and its ``meta`` with what the white balance tells of it."""
    m = _meta(said)
    return m.get("neutral") or [], _said(m | M.dual_illuminant(m))


def white_balance(frame: Frame, params: dict) -> Frame:
    def run(p, y, x, height, width, meta):
        neutral, new = _balanced(meta)
        return f16(np.concatenate((p[:3] / np.asarray(neutral[:3])[:, None, None, None], p[3:]))), new

    return frame.each(run)


def grey_world(frame: Frame, params: dict) -> Frame:
    """Each image's neutral from the sums of its channels over all its tiles."""

    def sums(batches):
        for batch in batches:
            for ids, _, planes in S.stacks(batch):
                yield pa.record_batch([pa.array(ids), *[pa.array(planes[k].sum((1, 2))) for k in range(3)]], names=["image_id", "sr", "sg", "sb"])

    total = frame.tiles.mapInArrow(sums, "image_id long, sr double, sg double, sb double").groupBy("image_id").agg(*[F.sum(f"s{c}").alias(f"s{c}") for c in P.RGB])
    neutral = M.neutral_of(total)

    def said(meta: pd.Series, nr: pd.Series, ng: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series([_said(_meta(m) | {"neutral": [r, g, b]}) for m, r, g, b in zip(meta, nr, ng, nb, strict=True)], dtype=object)

    new = F.pandas_udf(said, "string")
    tiles = frame.tiles.join(neutral, "image_id").withColumn("meta", new("meta", "nr", "ng", "nb")).select(*frame.tiles.columns)
    return white_balance(frame.of(tiles), params)


def color_matrix(frame: Frame, params: dict) -> Frame:
    def run(p, y, x, height, width, meta):
        own = _meta(meta).get("camera_to_xyz_d50")
        if not own:
            raise NodeError("NEED_METADATA", "no white balance before the colour matrix")
        m = P.matmul(P.XYZ_D65_TO_REC2020, P.matmul(P.D50_TO_D65, tuple(own)))
        return f16(np.concatenate((_matrix(m, p[:3]), p[3:])))

    return frame.each(run)


# Denoise and sharpen.


def _same(kernel: S.Kernel, radius: int) -> Callable[[Frame], Frame]:
    return lambda frame: frame.each(_stored(kernel), radius)


def block_denoise(frame: Frame, params: dict) -> Frame:
    def run(p, y, x, height, width, meta):
        profile = [tuple(v) for v in _meta(meta).get("noise_profile") or []]
        return f16(S.block_denoise(S.noise_sigma(profile, params.get("sigma"), params.get("sigma_override")))(p, y, x, height, width))

    return frame.each(run, 1)


# Tone.


def _reinhard(params: dict) -> S.Kernel:
    w = params.get("white_point")
    w = 1e6 if w is None or w < 0 else min(10.0, max(0.1, w))
    return _rgb(lambda v: np.clip(np.maximum(v, 0) * (np.maximum(v, 0) / (w * w) + 1) / (np.maximum(v, 0) + 1), 0, 1))


def _aces(params: dict) -> S.Kernel:
    if not params.get("toggle", True):
        return lambda p, *_: p
    return _rgb(lambda v: np.clip(v * (v * 2.51 + 0.03) / (v * (v * 2.43 + 0.59) + 0.14), 0, 1))


def _filmic(params: dict) -> S.Kernel:
    ev, contrast, saturation, highlights, shadows = (params.get(k, d) for k, d in (("ev", 0.0), ("contrast", 1.0), ("saturation", 1.0), ("highlights", 1.0), ("shadows", 1.0)))

    def run(v):
        c = np.clip(np.log(np.maximum(v * 2.0**ev, 0) * 6 + 1) / np.log(109.0), 0, 1) ** (1.0 / contrast)
        c = np.clip(c + (1 - c) * (1 - c) * ((shadows - 1) * 0.08) + c * c * ((highlights - 1) * 0.08), 0, 1)
        luma = np.tensordot(P.LUMA_709, c, 1)
        return np.clip(luma + (c - luma) * saturation, 0, 1)

    return _rgb(run)


def _paired(frames: list[Frame], kernel: Callable[[list[np.ndarray]], np.ndarray]) -> Frame:
    """Tiles of several frames at the same place, together; they must have the same images and tiles."""
    first = frames[0].tiles
    keys = [c for c in first.columns if c not in ("planes", "meta")]
    joined = first.select(*keys, "meta", F.col("planes").alias("p0"))
    for k, f in enumerate(frames[1:], 1):
        joined = joined.join(f.tiles.select(*keys, F.col("planes").alias(f"p{k}")), keys)
    # One list of all planes, so that a tile of the pair is a tile again.
    tiles = joined.select(*keys, F.concat(*[f"p{k}" for k in range(len(frames))]).alias("planes"), "meta").select(*first.columns)

    count = len(frames)
    return frames[0].of(tiles).each(lambda p, *_: kernel(list(np.split(p, count))))


def mertens(under: Frame, normal: Frame, over: Frame, params: dict) -> Frame:
    wc, ws, we = (params.get(k, d) for k, d in (("weight_contrast", 0.0), ("weight_saturation", 1.0), ("weight_well_exposedness", 1.0)))

    def weight(p: np.ndarray) -> np.ndarray:
        m = p[:3].mean(0)
        spread = np.sqrt(((p[:3] - m) ** 2).mean(0) + 1e-4)
        well = np.exp(-((p[:3] - 0.5) ** 2) / 0.08).prod(0)
        contrast = 1.0 if wc == 0 else (abs(m - 0.5) + 0.01) ** wc
        return contrast * (spread + 0.01) ** ws * (well if we == 1 else (well + 1e-4) ** we)

    def run(parts: list[np.ndarray]) -> np.ndarray:
        w = [weight(p) for p in parts]
        total = np.maximum(sum(w), 1e-6)
        return f16(np.concatenate((np.clip(sum(a * p[:3] for a, p in zip(w, parts, strict=True)) / total, 0, 1), parts[1][3:])))

    return _paired([under, normal, over], run)


def lut3d(frame: Frame, params: dict) -> Frame:
    """The table of the file ``lut_path``: read once, sent to the tasks once; 256**3 rows at most."""
    if not params.get("lut_path"):
        raise NodeError("NOT_FOUND", "lut_path")
    size, values = rasters.read_lut(frame.source.sparkSession, params["lut_path"])
    shared = frame.source.sparkSession.sparkContext.broadcast(np.asarray(values, float).reshape(size, size, size, 3))
    how = params.get("interpolation", "tetrahedral")
    return frame.each(lambda p, *_: f16(np.concatenate((table_lookup(shared.value, p[:3], how), p[3:]))))


# Display and precision.


def _quantised(v: np.ndarray, top: int) -> np.ndarray:
    return np.floor(np.clip(v, 0, 1) * top + 0.5)


def to_display(frame: Frame, params: dict) -> Frame:
    target = params.get("target", "sRGB")
    if target in ("DisplayP3", "BT2020-HLG"):
        raise NodeError("UNSUPPORTED", target)

    def srgb(p, *_):
        v = np.clip(_matrix(P.REC2020_TO_REC709, p[:3]), 0, 1)
        knee, slope = 0.055 / 1.4, (0.055 / 1.4) ** -1 * (0.055 * 2.4 / (1.4 * 1.055)) ** 2.4
        return _quantised(np.concatenate((np.where(v <= knee / slope, v * slope, v ** (1 / 2.4) * 1.055 - 0.055), p[3:])), 255)

    def pq(p, *_):
        v = (np.clip(p[:3], 0, 1) / 100) ** P.PQ_M1
        return _quantised(np.concatenate((((v * P.PQ_C2 + P.PQ_C1) / (v * P.PQ_C3 + 1)) ** P.PQ_M2, p[3:])), 1023) * 64

    return frame.each(srgb if target == "sRGB" else pq)


def convert(frame: Frame, target: str) -> Frame:
    """The conversions that a graph puts in between two nodes."""
    kernels = {
        "r.f32": lambda p, *_: p.astype(np.float32).astype(float),
        "rgba.f16": lambda p, *_: f16(np.concatenate((p, p, p, np.ones_like(p)))),
        "rgba.u8": lambda p, *_: _quantised(p, 255),
        "rgba.u16": lambda p, *_: _quantised(p, 65535),
    }
    if target not in kernels:
        raise NodeError("BAD_PRECISION", target)
    return frame.each(kernels[target])


def sink(frame: Frame, params: dict) -> Frame:
    """The planes that a file would hold; writing them is the caller's ``write``."""
    return frame


#: How each node type runs on frames: inputs in the order of its ports, then its parameters.
RUN: dict[str, Callable[..., Frame]] = {
    "builtin.dng_input": dng_input,
    "builtin.passthrough": lambda f, p: f,
    "linearize.dng_lut": linearize,
    "blacklevel.dng_levels": black_level,
    "lens.shading_gainmap": shading_gain,
    "demosaic.quad_bayer_remosaic": remosaic,
    "demosaic.bilinear": demosaic(S.demosaic_bilinear, 1),
    "demosaic.rcd": demosaic(S.demosaic_rcd, 3),
    "demosaic.amaze": demosaic(S.demosaic_amaze, 3),
    "lens.dng_opcode_list_3": lens_opcodes,
    "wb.dual_illuminant": white_balance,
    "wb.greyworld_auto": grey_world,
    "colormatrix.dng_to_working": color_matrix,
    "denoise.bm3d": block_denoise,
    "denoise.guided_filter": lambda f, p: _same(*S.guided_filter(p.get("radius", 1), p.get("eps", 0.015)))(f),
    "denoise.wavelet_bayes_shrink": lambda f, p: _same(S.wavelet_shrink(p.get("chroma_strength", 1.0)), 1)(f),
    "tone.reinhard": lambda f, p: f.each(_reinhard(p)),
    "tone.aces_filmic": lambda f, p: f.each(_aces(p)),
    "tone.filmic_rgb": lambda f, p: f.each(_filmic(p)),
    "tone.mertens_local": mertens,
    "color.3d_lut": lut3d,
    "sharpen.edge_aware_usm": lambda f, p: _same(*S.edge_aware_usm(p.get("strength", 0.75), p.get("radius", 1), p.get("threshold", 0.0)))(f),
    "color.scene_linear_to_display": to_display,
    "fusion.hdr_plus_derivative": lambda ref, frame, p: ref,
    "output.heif_sdr": sink,
    "output.heif_hdr_pq": sink,
}
