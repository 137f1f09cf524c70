"""The raster engine's queries over the driver's tables, and the SQL that says the same.

Each vector of ``embeddings`` is an 8x8 mosaic of 14-bit codes with the filter array red, green, green,
blue; ``events`` drive the event operators. Results are rounded to six places on both sides.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import pixel as P
from tessella.functions import blobs as B
from tessella.operators import measure as M
from tessella.operators import nodes as D
from tessella.operators import pointwise as N
from tessella.operators import stencil as S
from tessella.plans import graph as G
from tessella.sources import dng, rasters
from tessella.streaming import events as E

CFA = [0, 1, 1, 2]
SIDE, TOP = rasters.SIDE, rasters.TOP
#: What graphs run on: codes of 8 bits, a table that makes them 14, and the calibration of the images.
LINEAR = [k * 64 + (k * k) % 61 for k in range(256)]
TABLE = [k * 1024 + (k * k) % 97 for k in range(17)]
BLACK, WHITE = [512.0, 600.0, 700.0], 15000.0
CAMERA = (0.5, 0.1, 0.05, 0.2, 0.7, 0.1, 0.02, 0.1, 0.9)
NEUTRAL = (0.5, 1.0, 0.25)
MAPS4 = {k: {"points": (2, 2), "spacing": (7.0, 7.0), "origin": (0.0, 0.0), "gain": [1 + 0.1 * k, 1.2, 1.4 + 0.05 * k, 1.8]} for k in range(4)}
FILMIC = {"ev": 0.5, "contrast": 1.2, "saturation": 1.1, "highlights": 1.3, "shadows": 0.8}
WARP = [(1.0, 0.02, -0.01, 0.003, 0.001, -0.002), (0.99, 0.03, 0.0, 0.0, 0.0, 0.001), (1.01, -0.02, 0.01, 0.0, 0.002, 0.0)]
MATRIX1, MATRIX2 = [1.2, 0, 0, 0, 1, 0, 0, 0, 0.8], [0.9, 0, 0, 0, 1, 0, 0, 0, 1.1]
CALIBRATION = {"cfa_repeat": [2, 2], "cfa_pattern": CFA, "black": [*BLACK, 0.0], "white": WHITE, "linearization": LINEAR, "neutral": list(NEUTRAL), "illuminant1": 17, "illuminant2": 21}
CALIBRATION |= {"color_matrix1": [float(v) for v in MATRIX1], "color_matrix2": [float(v) for v in MATRIX2], "forward_matrix1": list(CAMERA), "forward_matrix2": list(CAMERA)}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = sql
        return f

    return add


# Inputs on the Spark side.


def codes(spark: SparkSession, d: str) -> DataFrame:
    return rasters.embedding_codes(spark, d)


def mosaic(spark: SparkSession, d: str, scale: float = 1.0) -> DataFrame:
    return rasters.mosaic_of(codes(spark, d)).withColumn("v", F.col("v") * scale)


def rgba(spark: SparkSession, d: str, gain: float = 1.0) -> DataFrame:
    v = F.col("v") / TOP
    return mosaic(spark, d).select("image_id", "y", "x", (v * gain).alias("r"), ((v * 0.5 + 0.25) * gain).alias("g"), ((1 - v) * gain).alias("b"), F.lit(1.0).alias("a"))


def mosaic_tiles(spark: SparkSession, d: str) -> DataFrame:
    return S.image_tiles(codes(spark, d), [F.transform("codes", lambda v: v / TOP)], SIDE, SIDE)


def rgba_tiles(spark: SparkSession, d: str) -> DataFrame:
    make: list[Callable[[Column], Column]] = [lambda v: v / TOP, lambda v: v / TOP * 0.5 + 0.25, lambda v: 1 - v / TOP, lambda v: F.lit(1.0)]
    return S.image_tiles(codes(spark, d), [F.transform("codes", f) for f in make], SIDE, SIDE)


def out(df: DataFrame, *columns: str) -> DataFrame:
    """Keys and rounded values, in fixed types."""
    values = [(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in columns]
    return df.select(F.col("image_id").cast("long"), F.col("y").cast("int"), F.col("x").cast("int"), *values)


# The same inputs in SQL. ``c`` is the list of codes; S() is a sample with the edge repeated, in [0, 1].

_PX = """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS image_id, list_transform(embedding, lambda v: floor((CAST(v AS DOUBLE) + 0.6e0) * (16383e0 / 1.2e0))) AS c FROM embeddings),
px AS (SELECT image_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, c, c[i + 1] AS v FROM e, range(64) t(i))"""


def _n(v: float) -> str:
    return f"({v!r}::DOUBLE)"


def _s(dy: int, dx: int) -> str:
    return f"(c[least(greatest(y + ({dy}), 0), 7) * 8 + least(greatest(x + ({dx}), 0), 7) + 1] / 16383e0)"


def _channel(k: int, v: str) -> str:
    return (v, f"({v} * 0.5e0 + 0.25e0)", f"(1e0 - {v})")[k]


def _rgba(gain: float = 1.0) -> str:
    v = "(v / 16383e0)"
    return f"{_PX}, rgba AS (SELECT image_id, y, x, {', '.join(f'{_channel(k, v)} * {_n(gain)} AS {c}' for k, c in enumerate('rgb'))}, 1e0 AS a FROM px)"


def _clamp(v: str) -> str:
    return f"greatest(0e0, least(1e0, {v}))"


def _out(columns: dict[str, str], table: str) -> str:
    return f" SELECT image_id, y, x, {', '.join(f'round(CAST({v} AS DOUBLE), 6) + 0e0 AS {c}' for c, v in columns.items())} FROM {table}"


def _each(f: Callable[[str], str], gain: float = 1.0, alpha: str = "a") -> str:
    return _rgba(gain) + _out({c: f(c) for c in "rgb"} | {"a": alpha}, "rgba")


def _add(*terms: str) -> str:
    return "(" + " + ".join(terms) + ")"


def _site(dy: int, dx: int) -> str:
    return f"(CASE ((y + ({dy}) + 4) % 2) * 2 + ((x + ({dx}) + 4) % 2) WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)"


# Scans and raw stages.


@query(f"{_PX} SELECT image_id, y, x, CAST(v AS DOUBLE) AS v FROM px")
def raster_scan(spark, d):
    return out(mosaic(spark, d), "v")


@query(f"{_PX}{_out({'v': f'CAST({TABLE} AS DOUBLE[])[CAST(least(floor(v / 1000), 16) AS INTEGER) + 1]'}, 'px')}")
def linearize(spark, d):
    return out(N.linearize(mosaic(spark, d).withColumn("v", F.floor(F.col("v") / 1000)), TABLE), "v")


_BLACK = f"(CASE {_site(0, 0)} WHEN 0 THEN {BLACK[0]}::DOUBLE WHEN 1 THEN {BLACK[1]}::DOUBLE ELSE {BLACK[2]}::DOUBLE END)"


@query(f"{_PX}{_out({'v': _clamp(f'(v - {_BLACK}) / ({WHITE}::DOUBLE - {_BLACK})')}, 'px')}")
def blacklevel(spark, d):
    return out(N.black_white(mosaic(spark, d), BLACK, WHITE, CFA), "v")


def _gain(m: dict) -> str:
    g = [_n(v) for v in m["gain"]]
    return f"(({g[0]} + ({g[1]} - {g[0]}) * (x / 7e0)) * (1 - y / 7e0) + ({g[2]} + ({g[3]} - {g[2]}) * (x / 7e0)) * (y / 7e0))"


@query(f"{_PX}{_out({'v': f'v / 16383e0 * {_gain(MAPS4[0])}'}, 'px')}")
def gainmap_1plane(spark, d):
    return out(N.gain_map(mosaic(spark, d, 1 / TOP), {0: MAPS4[0]}), "v")


@query(f"{_PX}{_out({'v': 'v / 16383e0 * (CASE (y % 2) * 2 + x % 2 ' + ' '.join(f'WHEN {k} THEN {_gain(m)}' for k, m in MAPS4.items()) + ' END)'}, 'px')}")
def gainmap_4plane(spark, d):
    return out(N.gain_map(mosaic(spark, d, 1 / TOP), MAPS4), "v")


def _remosaic() -> str:
    at = lambda y, x: f"CAST(c[least(greatest({y}, 0), 7) * 8 + least(greatest({x}, 0), 7) + 1] AS BIGINT)"
    sy, sx = "least(greatest(y + dy, 0), 7)", "least(greatest(x + dx, 0), 7)"
    return f"""{_PX}, t AS (SELECT image_id, y, x, c, dy, dx, {sy} AS sy, {sx} AS sx FROM px, range(-2, 3) a(dy), range(-2, 3) b(dx)),
w AS (SELECT image_id, y, x, {at('sy', 'sx')} AS s, CASE WHEN (CASE WHEN sy % 4 < 2 AND sx % 4 < 2 THEN 0 WHEN sy % 4 >= 2 AND sx % 4 >= 2 THEN 2 ELSE 1 END) = {_site(0, 0)}
  THEN greatest(1, 65536 // (64 + abs({at('sy', 'sx - 1')} - {at('sy', 'sx + 1')}) + abs({at('sy - 1', 'sx')} - {at('sy + 1', 'sx')}) + 16 * (abs(dy) + abs(dx)))) ELSE 0 END AS w FROM t)
SELECT image_id, y, x, CAST(CASE WHEN sum(w) = 0 THEN 0 ELSE (sum(w * s) + sum(w) // 2) // sum(w) END AS DOUBLE) AS v FROM w GROUP BY image_id, y, x"""


@query(_remosaic())
def quad_remosaic(spark, d):
    return out(S.pixels(S.stencil(S.image_tiles(codes(spark, d), [F.col("codes")], SIDE, SIDE), S.remosaic, 3), ("v",)), "v")


def _spread(h: str, v: str, diag: str, green: str) -> str:
    own, left, c = _site(0, 0), _site(0, -1), _s(0, 0)
    r = f"CASE WHEN {own} = 0 THEN {c} WHEN {own} = 2 THEN {diag} WHEN {left} = 0 THEN {h} ELSE {v} END"
    b = f"CASE WHEN {own} = 2 THEN {c} WHEN {own} = 0 THEN {diag} WHEN {left} = 2 THEN {h} ELSE {v} END"
    return r, green, b


def _demosaic(kind: str) -> str:
    if kind == "bilinear":
        h, v = f"({_s(0, -1)} + {_s(0, 1)}) / 2", f"({_s(-1, 0)} + {_s(1, 0)}) / 2"
        diag = f"({_s(-1, -1)} + {_s(-1, 1)} + {_s(1, -1)} + {_s(1, 1)}) / 4"
        rgb = _spread(h, v, diag, f"CASE WHEN {_site(0, 0)} = 1 THEN {_s(0, 0)} ELSE ({h} + {v}) / 2 END")
        return _PX + _out(dict(zip("rgb", rgb, strict=True)), "px")
    cols = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            s = lambda a, b: _s(i + a, j + b)  # noqa: B023, E731
            c, h, v = s(0, 0), f"({s(0, -1)} + {s(0, 1)}) / 2", f"({s(-1, 0)} + {s(1, 0)}) / 2"
            dh, dv = f"abs({s(0, -2)} - {s(0, 2)})", f"abs({s(-2, 0)} - {s(2, 0)})"
            if kind == "amaze":
                h, v = f"({h} + (2 * {c} - {s(0, -2)} - {s(0, 2)}) / 4)", f"({v} + (2 * {c} - {s(-2, 0)} - {s(2, 0)}) / 4)"
                dh = f"(abs({s(0, -1)} - {s(0, 1)}) + abs({s(0, -2)} - {c}) + abs({s(0, 2)} - {c}))"
                dv = f"(abs({s(-1, 0)} - {s(1, 0)}) + abs({s(-2, 0)} - {c}) + abs({s(2, 0)} - {c}))"
            g = f"CASE WHEN {_site(i, j)} = 1 THEN {c} WHEN {dh} < {dv} THEN {h} WHEN {dv} < {dh} THEN {v} ELSE ({h} + {v}) / 2 END"
            cols.append(f"{g} AS g{i + 1}{j + 1}")
    t = {(i, j): (f"({_s(i, j)} / greatest(g{i + 1}{j + 1}, 1e-6))" if kind == "rcd" else f"({_s(i, j)} - g{i + 1}{j + 1})") for i in (-1, 0, 1) for j in (-1, 0, 1)}
    op = "*" if kind == "rcd" else "+"
    h, v = (f"g11 {op} ({t[a]} + {t[b]}) / 2" for a, b in (((0, -1), (0, 1)), ((-1, 0), (1, 0))))
    diag = f"g11 {op} ({t[-1, -1]} + {t[-1, 1]} + {t[1, -1]} + {t[1, 1]}) / 4"
    rgb = [f"greatest(0e0, {x})" for x in _spread(h, v, diag, "g11")]
    return f"{_PX}, gr AS (SELECT image_id, y, x, c, {', '.join(cols)} FROM px)" + _out(dict(zip("rgb", rgb, strict=True)), "gr")


for _kind, _kernel, _radius in (("bilinear", S.demosaic_bilinear, 1), ("rcd", S.demosaic_rcd, 3), ("amaze", S.demosaic_amaze, 3)):

    @query(_demosaic(_kind), f"demosaic_{_kind}")
    def _run(spark, d, kernel=_kernel, radius=_radius):
        return out(S.pixels(S.stencil(mosaic_tiles(spark, d), kernel(CFA), radius), (*P.RGB, "a")), *P.RGB)


@query(_demosaic("rcd"))
def demosaic_rcd_tiled(spark, d):
    """The same image in tiles of 4x4 that exchange halos."""
    tiles = S.cut_tiles(mosaic(spark, d).withColumn("v", F.col("v") / TOP), ("v",), SIDE, SIDE, 4)
    return out(S.pixels(S.stencil(tiles, S.demosaic_rcd(CFA), 3, split=4), (*P.RGB, "a")), *P.RGB)


# Lens opcodes.

_R2 = "(((x - 3.5e0) * (x - 3.5e0) + (y - 3.5e0) * (y - 3.5e0)) / 24.5e0)"


@query(_each(lambda c: f"{c} * (1 + {_R2} * 0.5e0 + {_R2} * {_R2} * 0.1e0)"))
def vignette(spark, d):
    return out(N.vignette(rgba(spark, d), [0.5, 0.1, 0, 0, 0], SIDE, SIDE), *P.RGB, "a")


_IN = "y >= 1 AND y < 6 AND x >= 2 AND x < 7"


@query(_each(lambda c: f"CASE WHEN {_IN} THEN {c} ELSE 0 END", alpha=f"CASE WHEN {_IN} THEN a ELSE 0 END"))
def trim_bounds(spark, d):
    return out(N.trim_bounds(rgba(spark, d), 1, 2, 6, 7), *P.RGB, "a")


def _bad(where: str) -> str:
    near = [(-1, 0, "y > 0"), (1, 0, "y < 7"), (0, -1, "x > 0"), (0, 1, "x < 7")]
    count = _add(*[f"CASE WHEN {w} THEN 1 ELSE 0 END" for *_, w in near])

    def mean(k: int) -> str:
        return _add(*[f"CASE WHEN {w} THEN {_channel(k, _s(a, b))} ELSE 0e0 END" for a, b, w in near]) + f" / {count}"

    return _PX + _out({c: f"CASE WHEN {where} THEN {mean(k)} ELSE {_channel(k, _s(0, 0))} END" for k, c in enumerate("rgb")}, "px")


@query(_bad("(y = 0 AND x = 0) OR (y = 3 AND x = 4) OR (y >= 5 AND y < 7 AND x >= 1 AND x < 3)"))
def bad_pixels_list(spark, d):
    kernel = S.bad_pixels([(0, 0), (3, 4)], [(5, 1, 7, 3)])
    return out(S.pixels(S.stencil(rgba_tiles(spark, d), kernel, 1), (*P.RGB, "a")), *P.RGB)


@query(_bad(" OR ".join(f"abs({_channel(k, _s(0, 0))} - 0.5e0) <= 1e-4" for k in range(3))))
def bad_pixels_const(spark, d):
    return out(S.pixels(S.stencil(rgba_tiles(spark, d), S.bad_pixels(constant=0.5), 1), (*P.RGB, "a")), *P.RGB)


def _warp() -> str:
    m, parts = _n(24.5**0.5), []
    for k, (k0, k1, k2, k3, t0, t1) in enumerate([[_n(v) for v in w] for w in WARP]):
        f = f"({k0} + {k1} * r2 + {k2} * r2 * r2 + {k3} * r2 * r2 * r2)"
        sx = f"3.5e0 + {m} * ({f} * dx + 2 * {t0} * dx * dy + {t1} * (r2 + 2 * dx * dx))"
        sy = f"3.5e0 + {m} * ({f} * dy + {t0} * (r2 + 2 * dy * dy) + 2 * {t1} * dx * dy)"
        parts.append(f"SELECT image_id, y, x, c, {k} AS k, least(greatest({sx}, 0e0), 7e0) AS sx, least(greatest({sy}, 0e0), 7e0) AS sy FROM rad")
    cubic = lambda p, t: f"({p[1]} + {t} * (({p[2]} - {p[0]}) / 2 + {t} * ({p[0]} - 2.5e0 * {p[1]} + 2 * {p[2]} - {p[3]} / 2 + {t} * (1.5e0 * ({p[1]} - {p[2]}) + ({p[3]} - {p[0]}) / 2))))"

    def tap(a: int, b: int) -> str:
        v = f"(c[least(greatest(iy + ({a}), 0), 7) * 8 + least(greatest(ix + ({b}), 0), 7) + 1] / 16383e0)"
        return f"(CASE k WHEN 0 THEN {_channel(0, v)} WHEN 1 THEN {_channel(1, v)} ELSE {_channel(2, v)} END)"

    rows = ", ".join(f"{cubic([tap(a, b) for b in range(-1, 3)], 'tx')} AS q{a + 1}" for a in range(-1, 3))
    return f"""{_PX}, rad0 AS (SELECT *, (x - 3.5e0) / {m} AS dx, (y - 3.5e0) / {m} AS dy FROM px), rad AS (SELECT *, dx * dx + dy * dy AS r2 FROM rad0),
src AS ({' UNION ALL '.join(parts)}), i AS (SELECT *, CAST(floor(sx) AS INTEGER) AS ix, CAST(floor(sy) AS INTEGER) AS iy, sx - floor(sx) AS tx, sy - floor(sy) AS ty FROM src),
rw AS (SELECT image_id, y, x, k, ty, {rows} FROM i), val AS (SELECT image_id, y, x, k, {cubic(['q0', 'q1', 'q2', 'q3'], 'ty')} AS v FROM rw)
SELECT image_id, y, x, {', '.join(f'round(max(CASE WHEN k = {k} THEN v END), 6) + 0e0 AS {c}' for k, c in enumerate('rgb'))} FROM val GROUP BY image_id, y, x"""


@query(_warp())
def warp_rectilinear(spark, d):
    return out(S.pixels(S.stencil(rgba_tiles(spark, d), S.warp_rectilinear(WARP), 0), (*P.RGB, "a")), *P.RGB)


@query(_warp())
def warp_rectilinear_tiled(spark, d):
    """The same image in tiles of 4x4, each of which gathers the part that it samples."""
    return out(S.pixels(S.warp_tiles(S.split_tiles(rgba_tiles(spark, d), 4), 4, WARP), (*P.RGB, "a")), *P.RGB)


def _table(spark: SparkSession) -> list[float]:
    return [v for r in range(17) for g in range(17) for b in range(17) for v in (r / 16 * (r / 16) * 0.8 + g / 16 * 0.2, g / 16 * (g / 16) * 0.7 + b / 16 * 0.3, b / 16 * (b / 16) * 0.9 + r / 16 * (g / 16) * 0.1)]


# White balance and colour.


@query(_rgba() + _out({c: f"{c} / {_n(n)}" for c, n in zip("rgb", NEUTRAL, strict=True)}, "rgba"))
def wb_apply(spark, d):
    return out(N.white_balance(rgba(spark, d), NEUTRAL), *P.RGB)


_SUMS = ", s AS (SELECT image_id, sum(r) AS sr, sum(g) AS sg, sum(b) AS sb FROM rgba GROUP BY image_id), j AS (SELECT rgba.*, sr, sg, sb FROM rgba JOIN s USING (image_id) WHERE sr > 0 AND sg > 0 AND sb > 0)"


@query(_rgba() + _SUMS + _out({"r": "r / (sr / sg)", "g": "g", "b": "b / (sb / sg)"}, "j"))
def wb_greyworld(spark, d):
    px = rgba(spark, d)
    return out(N.white_balance_by_image(px, M.greyworld(px)), *P.RGB)


@query()
def wb_cct(spark, d):
    found = M.scene_temperature(M.greyworld(rgba(spark, d)), MATRIX1, MATRIX2, (17, 21))
    return found.select("image_id", F.round("cct", 1).alias("cct"), F.round("weight", 4).alias("weight"))


_M = P.matmul(P.XYZ_D65_TO_REC2020, P.matmul(P.D50_TO_D65, CAMERA))


def _matrix(m: tuple[float, ...], v: tuple[str, str, str] = ("r", "g", "b")) -> list[str]:
    return [_add(*[f"{v[k]} * {_n(m[3 * i + k])}" for k in range(3)]) for i in range(3)]


@query(_rgba() + _out(dict(zip("rgb", _matrix(_M), strict=True)), "rgba"))
def colormatrix(spark, d):
    return out(N.color_matrix(rgba(spark, d), CAMERA), *P.RGB)


# Denoise and sharpen.


def _mean9(k: int, i: int, j: int, square: bool = False) -> str:
    terms = [_channel(k, _s(i + a, j + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    return _add(*[f"{t} * {t}" if square else t for t in terms]) + " / 9"


def _guided(eps: float) -> str:
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    name = lambda p, k, i, j: f"{p}{k}{i + 1}{j + 1}"
    means = [f"{_mean9(k, i, j)} AS {name('m', k, i, j)}, {_mean9(k, i, j, True)} AS {name('q', k, i, j)}" for k in range(3) for i, j in near]
    var = lambda k, i, j: f"greatest(0e0, {name('q', k, i, j)} - {name('m', k, i, j)} * {name('m', k, i, j)})"
    ab = [f"{var(k, i, j)} / ({var(k, i, j)} + {_n(eps)}) AS {name('a', k, i, j)}" for k in range(3) for i, j in near]
    value = {}
    for k, c in enumerate("rgb"):
        a = _add(*[name("a", k, i, j) for i, j in near]) + " / 9"
        b = _add(*[f"({name('m', k, i, j)} - {name('a', k, i, j)} * {name('m', k, i, j)})" for i, j in near]) + " / 9"
        value[c] = f"greatest(0e0, {a} * {_channel(k, _s(0, 0))} + {b})"
    return f"{_PX}, mm AS (SELECT *, {', '.join(means)} FROM px), aa AS (SELECT *, {', '.join(ab)} FROM mm)" + _out(value, "aa")


@query(_guided(0.015))
def denoise_guided(spark, d):
    kernel, radius = S.guided_filter(1, 0.015)
    return out(S.pixels(S.stencil(rgba_tiles(spark, d), kernel, radius), (*P.RGB, "a")), *P.RGB)


def _usm(strength: float, threshold: float) -> str:
    value = {}
    for k, c in enumerate("rgb"):
        own = _channel(k, _s(0, 0))
        detail = f"({own} - {_mean9(k, 0, 0)})"
        value[c] = f"greatest(0e0, CASE WHEN abs({detail}) >= {_n(threshold)} THEN {own} + {_n(strength)} * {detail} ELSE {own} END)"
    return _PX + _out(value, "px")


@query(_usm(0.75, 0.02))
def sharpen_usm(spark, d):
    kernel, radius = S.edge_aware_usm(0.75, 1, 0.02)
    return out(S.pixels(S.stencil(rgba_tiles(spark, d), kernel, radius), (*P.RGB, "a")), *P.RGB)


def _b(k: int, dy: int, dx: int) -> str:
    return _channel(k, f"(c[(y - y % 2 + {dy}) * 8 + (x - x % 2 + {dx}) + 1] / 16383e0)")


def _blockmean(strength: float) -> str:
    mean = lambda k: _add(*[_b(k, a, b) for a in (0, 1) for b in (0, 1)]) + " / 4"
    return _PX + _out({c: f"greatest(0e0, {_channel(k, _s(0, 0))} + ({mean(k)} - {_channel(k, _s(0, 0))}) * {_n(strength)})" for k, c in enumerate("rgb")}, "px")


@query(_blockmean(0.5))
def denoise_bm3d(spark, d):
    return out(S.pixels(S.stencil(rgba_tiles(spark, d), S.block_denoise(S.noise_sigma(sigma=0.015)), 1), (*P.RGB, "a")), *P.RGB)


def _wavelet() -> str:
    co = lambda a, b: f"({_b(0, a, b)} - {_b(2, a, b)})"
    cg = lambda a, b: f"({_b(1, a, b)} - ({_b(0, a, b)} + {_b(2, a, b)}) / 2)"
    soft = lambda v: f"(CASE WHEN {v} > 0.035e0 THEN {v} - 0.035e0 WHEN {v} < -0.035e0 THEN {v} + 0.035e0 ELSE 0 END)"
    cols = []
    for n, f in (("o", co), ("g", cg)):
        p = [f(0, 0), f(0, 1), f(1, 0), f(1, 1)]
        for name, signs in (("l", "++++"), ("h", "+-+-"), ("v", "++--"), ("d", "+--+")):
            cols.append(f"(0e0 {' '.join(s + x for s, x in zip(signs, p, strict=True))}) / 4 AS {n}{name}")
    sx, sy = "(1 - 2 * (x % 2))", "(1 - 2 * (y % 2))"
    back = {n: f"({n}l + {sx} * {soft(n + 'h')} + {sy} * {soft(n + 'v')} + {sx} * {sy} * {soft(n + 'd')})" for n in "og"}
    own = [_channel(k, _s(0, 0)) for k in range(3)]
    t = f"(({own[0]} + 2 * {own[1]} + {own[2]}) / 4 - vg / 2)"
    rgb = {"r": f"greatest(0e0, {t} + vo / 2)", "g": f"greatest(0e0, {t} + vg)", "b": f"greatest(0e0, {t} - vo / 2)"}
    return f"{_PX}, hb AS (SELECT *, {', '.join(cols)} FROM px), bk AS (SELECT *, {back['o']} AS vo, {back['g']} AS vg FROM hb)" + _out(rgb, "bk")


@query(_wavelet())
def denoise_wavelet(spark, d):
    return out(S.pixels(S.stencil(rgba_tiles(spark, d), S.wavelet_shrink(1.0), 1), (*P.RGB, "a")), *P.RGB)


# Tone and tables.


@query(_each(lambda c: _clamp(f"greatest({c}, 0e0) * (1 + greatest({c}, 0e0) / 16e0) / (1 + greatest({c}, 0e0))"), 4))
def tone_reinhard(spark, d):
    return out(N.reinhard(rgba(spark, d, 4.0), 4.0), *P.RGB, "a")


@query(_each(lambda c: _clamp(f"{c} * (2.51e0 * {c} + 0.03e0) / ({c} * (2.43e0 * {c} + 0.59e0) + 0.14e0)"), 4))
def tone_aces(spark, d):
    return out(N.aces_filmic(rgba(spark, d, 4.0)), *P.RGB, "a")


def _filmic() -> str:
    curve = lambda c: f"pow({_clamp(f'ln(1 + 6 * greatest({c} * pow(2e0, 0.5e0), 0e0)) / ln(109e0)')}, 1 / 1.2e0)"
    tone = {c: _clamp(f"t{c} + (0.8e0 - 1) * 0.08e0 * (1 - t{c}) * (1 - t{c}) + (1.3e0 - 1) * 0.08e0 * t{c} * t{c}") for c in "rgb"}
    cols = ", ".join(f"{curve(c)} AS t{c}" for c in "rgb")
    done = ", ".join(f"{v} AS u{c}" for c, v in tone.items())
    y = "(ur * 0.2126e0 + ug * 0.7152e0 + ub * 0.0722e0)"
    return f"{_rgba(4)}, tt AS (SELECT *, {cols} FROM rgba), uu AS (SELECT *, {done} FROM tt)" + _out({c: _clamp(f"{y} + (u{c} - {y}) * 1.1e0") for c in "rgb"}, "uu")


@query(_filmic())
def tone_filmic(spark, d):
    return out(N.filmic_rgb(rgba(spark, d, 4.0), **FILMIC), *P.RGB)


def _mertens() -> str:
    gains, cols, sums = {"u": "0.25e0", "n": "1e0", "o": "4e0"}, [], []
    for p, g in gains.items():
        r, gg, b = (f"({c} * {g})" for c in "rgb")
        m = f"(({r} + {gg} + {b}) / 3)"
        var = " + ".join(f"({v} - {m}) * ({v} - {m})" for v in (r, gg, b))
        well = " * ".join(f"exp(-({v} - 0.5e0) * ({v} - 0.5e0) / 0.08e0)" for v in (r, gg, b))
        cols.append(f"(sqrt(({var}) / 3 + 1e-4) + 0.01e0) * {well} AS w{p}")
    value = {c: _clamp(f"(wu * {c} * 0.25e0 + wn * {c} + wo * {c} * 4) / greatest(wu + wn + wo, 1e-6)") for c in "rgb"}
    return f"{_rgba()}, ww AS (SELECT *, {', '.join(cols)} FROM rgba)" + _out(value, "ww")


@query(_mertens())
def tone_mertens(spark, d):
    return out(N.mertens(rgba(spark, d, 0.25), rgba(spark, d), rgba(spark, d, 4.0)), *P.RGB)


def _grid(r: Column, g: Column, b: Column) -> list[Column]:
    """A 17-point table in closed form."""
    r, g, b = (v / 16 for v in (r, g, b))
    return [r * r * 0.8 + g * 0.2, g * g * 0.7 + b * 0.3, b * b * 0.9 + r * g * 0.1]


def _lut_steps(kind: str) -> tuple[str, dict[str, str]]:
    base = ", ".join(f"{_clamp(c)} * 16 AS s{c}" for c in "rgb")
    low = ", ".join(f"least(floor(s{c}), 15) AS f{c}" for c in "rgb")
    delta = ", ".join(f"s{c} - f{c} AS d{c}" for c in "rgb")

    def at(i: int, j: int, k: int, n: int) -> str:
        r, g, b = (f"((f{c} + {o}) / 16e0)" for c, o in zip("rgb", (i, j, k), strict=True))
        return (f"({r} * {r} * 0.8e0 + {g} * 0.2e0)", f"({g} * {g} * 0.7e0 + {b} * 0.3e0)", f"({b} * {b} * 0.9e0 + {r} * {g} * 0.1e0)")[n]

    value = {}
    for n, c in enumerate("rgb"):
        if kind == "trilinear":
            terms = [f"{'dr' if i else '(1 - dr)'} * {'dg' if j else '(1 - dg)'} * {'db' if k else '(1 - db)'} * {at(i, j, k, n)}" for i in (0, 1) for j in (0, 1) for k in (0, 1)]
            value[c] = _clamp(_add(*terms))
            continue
        cases = []
        for order in ("rgb", "rbg", "brg", "grb", "gbr", "bgr"):
            on, path = [0, 0, 0], [at(0, 0, 0, n)]
            for axis in order:
                before = at(*on, n)
                on["rgb".index(axis)] = 1
                path.append(f"({at(*on, n)} - {before}) * d{axis}")
            cases.append(f"WHEN d{order[0]} >= d{order[1]} AND d{order[1]} >= d{order[2]} THEN {_add(*path)}")
        value[c] = _clamp(f"CASE {' '.join(cases)} END")
    return f", l0 AS (SELECT *, {base} FROM rgba), l1 AS (SELECT *, {low} FROM l0), l2 AS (SELECT *, {delta} FROM l1)", value


def _lut(kind: str) -> str:
    ctes, value = _lut_steps(kind)
    return _rgba(1.3) + ctes + _out(value, "l2")


@query(_lut("tetrahedral"))
def lut3d_tetra(spark, d):
    return out(N.lut3d(rgba(spark, d, 1.3), 17, _grid), *P.RGB)


@query(_lut("tetrahedral"))
def lut3d_table(spark, d):
    """The same table as values, broadcast and looked up by batch."""
    return out(N.lut3d(rgba(spark, d, 1.3), 17, _table(spark)), *P.RGB)


@query(_lut("trilinear"))
def lut3d_tri(spark, d):
    return out(N.lut3d(rgba(spark, d, 1.3), 17, _grid, "trilinear"), *P.RGB)


# Display, precision, encoding.

_KNEE = 0.055 / 1.4
_SLOPE = (0.055 / 1.4) ** -1 * (0.055 * 2.4 / (1.4 * 1.055)) ** 2.4


def _q(v: str, top: int) -> str:
    return f"floor({_clamp(v)} * {top} + 0.5e0)"


def _srgb(v: str) -> str:
    return f"(CASE WHEN {v} <= {_n(_KNEE / _SLOPE)} THEN {v} * {_n(_SLOPE)} ELSE pow({v}, {_n(1 / 2.4)}) * 1.055e0 - 0.055e0 END)"


def _pq(v: str) -> str:
    p = f"pow(greatest({v}, 0e0) / 100, {_n(P.PQ_M1)})"
    return f"pow(({p} * {_n(P.PQ_C2)} + {_n(P.PQ_C1)}) / ({p} * {_n(P.PQ_C3)} + 1), {_n(P.PQ_M2)})"


_SRGB = {c: _q(_srgb(_clamp(v)), 255) for c, v in zip("rgb", _matrix(P.REC2020_TO_REC709), strict=True)}
_PQ = {c: f"{_q(_pq(_clamp(c)), 1023)} * 64" for c in "rgb"}


@query(_rgba() + _out(_SRGB | {"a": "255"}, "rgba"))
def display_srgb(spark, d):
    return out(N.to_display(rgba(spark, d)), *P.RGB, "a")


@query(_rgba() + _out(_PQ | {"a": "65472"}, "rgba"))
def display_pq(spark, d):
    return out(N.to_display(rgba(spark, d), "BT2020-PQ"), *P.RGB, "a")


def _f16(v: str) -> str:
    ulp = f"pow(2e0, greatest(floor(log2(abs({v}))), -14) - 10)"
    return f"(CASE WHEN {v} = 0 THEN 0 ELSE round_even({v} / {ulp}, 0) * {ulp} END)"


@query(f"{_PX}{_out({'v': 'v'}, 'px')}")
def precision_f32(spark, d):
    return out(N.precision_convert(mosaic(spark, d), "R32_SFLOAT"), "v")


@query(f"{_PX}{_out({c: _f16('(v / 16383e0)') for c in 'rgb'} | {'a': '1'}, 'px')}")
def precision_f16(spark, d):
    return out(N.precision_convert(mosaic(spark, d).withColumn("v", F.col("v") / TOP), "R16G16B16A16_SFLOAT"), *P.RGB, "a")


@query(_rgba() + _out({c: _q(c, 255) for c in "rgba"}, "rgba"))
def precision_u8(spark, d):
    return out(N.precision_convert(rgba(spark, d), "R8G8B8A8_UNORM"), *P.RGB, "a")


@query(_rgba() + _out({c: _q(c, 65535) for c in "rgba"}, "rgba"))
def precision_u16(spark, d):
    return out(N.precision_convert(rgba(spark, d), "R16G16B16A16_UNORM"), *P.RGB, "a")


@query(_rgba() + _out({c: c for c in "rgba"}, "rgba"))
def passthrough(spark, d):
    return out(N.passthrough(rgba(spark, d)), *P.RGB, "a")


@query(f"{_PX}{_out({'v': 'v'}, 'px')}")
def fusion_reference(spark, d):
    return out(N.fuse_reference(mosaic(spark, d), mosaic(spark, d)), "v")


def _chroma(hdr: bool) -> tuple[str, str]:
    top, shift, w, src = (1023, 64, P.LUMA_2020, _PQ) if hdr else (255, 1, P.LUMA_709, _SRGB)
    head = f"{_rgba()}, dd AS (SELECT image_id, y, x, {', '.join(f'{v} AS {c}' for c, v in src.items())} FROM rgba), ee AS (SELECT image_id, y, x, {', '.join(f'floor({c} / {shift}) / {_n(top)} AS {c}' for c in 'rgb')} FROM dd), ll AS (SELECT *, r * {_n(w[0])} + g * {_n(w[1])} + b * {_n(w[2])} AS l FROM ee)"
    code = lambda v, k: f"CAST(greatest(0, least({top}, floor(avg(({v} - l) / {_n(2 * (1 - w[k]))}) * {top} + {(top + 1) // 2} + 0.5e0))) AS INTEGER)"
    return f"{head} SELECT image_id, y, x, CAST({_q('l', top)} AS INTEGER) AS luma FROM ll", f"{head} SELECT image_id, CAST(y // 2 AS INTEGER) AS cy, CAST(x // 2 AS INTEGER) AS cx, {code('b', 2)} AS cb, {code('r', 0)} AS cr FROM ll GROUP BY ALL"


for _name, _target in (("sdr", "sRGB"), ("hdr", "BT2020-PQ")):
    for _plane, _part in enumerate(("luma", "chroma")):

        @query(_chroma(_name == "hdr")[_plane], f"ycbcr420_{_name}_{_part}")
        def _run(spark, d, target=_target, plane=_plane):
            return M.ycbcr420(N.to_display(rgba(spark, d), target), target != "sRGB")[plane]


def _nits(c: str) -> str:
    p = f"pow(floor({c} / 64) / 1023e0, {_n(1 / P.PQ_M2)})"
    return f"pow(greatest({p} - {_n(P.PQ_C1)}, 0e0) / ({_n(P.PQ_C2)} - {p} * {_n(P.PQ_C3)}), {_n(1 / P.PQ_M1)}) * 10000"


@query(f"""{_rgba()}, dd AS (SELECT image_id, {', '.join(f'{v} AS {c}' for c, v in _PQ.items())} FROM rgba), nn AS (SELECT image_id, {', '.join(f'{_nits(c)} AS {c}' for c in 'rgb')} FROM dd)
SELECT image_id, CAST(least(65535, greatest(1, floor(max(greatest(r, g, b)) + 0.5e0))) AS INTEGER) AS max_cll,
  CAST(least(65535, greatest(1, floor(avg(r * 0.2627e0 + g * 0.678e0 + b * 0.0593e0) + 0.5e0))) AS INTEGER) AS max_fall FROM nn GROUP BY image_id""")
def light_levels(spark, d):
    return M.light_levels(N.to_display(rgba(spark, d), "BT2020-PQ")).select(F.col("image_id").cast("long"), "max_cll", "max_fall")


@query(f"""{_rgba()}, err AS (SELECT image_id, avg(({' + '.join(f'pow({_f16(c)} - {c}, 2)' for c in 'rgb')}) / 3) AS mse FROM rgba GROUP BY image_id)
SELECT image_id, CASE WHEN mse > 0 THEN round(10 * log10(1 / mse), 4) END AS psnr FROM err""")
def psnr(spark, d):
    px = rgba(spark, d)
    return M.psnr(px, N.store_f16(px)).select(F.col("image_id").cast("long"), F.round("psnr", 4).alias("psnr"))


@query(_rgba() + " SELECT image_id, CAST(y // 4 AS INTEGER) AS y, CAST(x // 4 AS INTEGER) AS x, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in "rgba") + " FROM rgba GROUP BY ALL")
def thumbnail(spark, d):
    return out(M.thumbnail(rgba(spark, d), 4), *P.RGB, "a")


# Graphs.

STAGES = ["linearize.dng_lut", "blacklevel.dng_levels", "demosaic.bilinear", "wb.dual_illuminant", "colormatrix.dng_to_working", "denoise.wavelet_bayes_shrink", "tone.reinhard", "color.3d_lut", "sharpen.edge_aware_usm", "color.scene_linear_to_display"]
MINIMUM = [*STAGES[:5], STAGES[-1]]


def chain(kinds: list[str], params: dict[str, dict] | None = None) -> str:
    """A graph that runs the nodes one after the other."""
    nodes = [{"id": f"n{k:02d}", "type": t, "params": (params or {}).get(t, {})} for k, t in enumerate(kinds)]
    edges = [{"from": "inputs.raw", "to": "n00.raw"}] + [{"from": f"{a['id']}.out", "to": f"{b['id']}.in"} for a, b in zip(nodes[:-1], nodes[1:], strict=True)]
    return json.dumps({"version": "0.4", "inputs": [{"port": "raw", "kind": "Image2D", "width": SIDE, "height": SIDE}], "nodes": nodes, "edges": edges})


def raw8(codes: Column) -> Column:
    return F.transform(codes, lambda v: F.floor(v / 64).cast("double"))


def raw_frame(spark: SparkSession, d: str) -> D.Frame:
    images = codes(spark, d).select("image_id", raw8(F.col("codes")).alias("raw"), F.lit(json.dumps(CALIBRATION)).alias("meta"))
    return D.raw_frame(images, F.col("raw"), SIDE, SIDE)


def dng_files(spark: SparkSession, d: str) -> DataFrame:
    """Each mosaic as the bytes of a DNG file."""
    fields = {k: bytes(v) if k == "cfa_pattern" else int(v) if k == "white" else v for k, v in CALIBRATION.items()}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                content = [dng.encode(c, **fields) for c in part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, SIDE, SIDE)]
                yield pa.record_batch([part.column(0), pa.array(content, pa.binary())], names=["path", "content"])

    return codes(spark, d).select(_path().alias("path"), raw8(F.col("codes")).alias("raw")).mapInArrow(run, "path string, content binary")


def _path() -> Column:
    return F.concat(F.col("image_id").cast("string"), F.lit(".dng"))


def graph_tiles(frame: D.Frame, text: str) -> DataFrame:
    return G.fold(G.load(text), frame, D.RUN, D.convert).tiles


def run_graph(frame: D.Frame, text: str) -> DataFrame:
    return S.pixels(graph_tiles(frame, text), (*P.RGB, "a"))


def by_path(tiles: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """Tiles of ``dng_files``, with the number in the file's name as id. The names are made again, not the files."""
    names = codes(spark, d).select(F.xxhash64(_path()).alias("image_id"), F.col("image_id").cast("long").alias("number"))
    return tiles.join(names, "image_id").select(F.col("number").alias("image_id"), *S.COLUMNS[1:])


@query(f"{_PX}{_out({'v': 'floor(v / 64)'}, 'px')}")
def dng_scan(spark, d):
    """Samples of DNG files, cut into tiles of 4x4 where they are read."""
    files = dng_files(spark, d)
    return out(S.pixels(by_path(D.dng_frame(files, 4).tiles, spark, d), ("v",)), "v")


@query(f"""SELECT CAST(vec_id AS BIGINT) AS image_id, 8 AS height, 8 AS width, 2 AS cfa_rows, {len(LINEAR)} AS table_size, CAST(15000 AS DOUBLE) AS white, 17 AS illuminant1, round(0.25, 6) AS blue FROM embeddings""")
def dng_headers(spark, d):
    files = dng_files(spark, d)
    h = dng.headers(files)
    number = F.substring_index("path", ".", 1).cast("long").alias("image_id")
    return h.select(number, "height", "width", F.get("cfa_repeat", F.lit(0)).alias("cfa_rows"), F.size("linearization").alias("table_size"), "white", "illuminant1", F.round(F.get("neutral", F.lit(2)), 6).alias("blue"))


_LIN = f"CAST({LINEAR} AS DOUBLE[])"


def _scene() -> str:
    """The smallest graph in SQL, up to the scene in half floats: ``a6(image_id, y, x, r, g, b)``."""
    s = lambda a, b: f"n{a + 1}{b + 1}"
    level = f"CASE ((y + dy + 4) % 2) * 2 + (x + dx + 4) % 2 WHEN 0 THEN {BLACK[0]}::DOUBLE WHEN 3 THEN {BLACK[2]}::DOUBLE ELSE {BLACK[1]}::DOUBLE END"
    cols = []
    for i in (-1, 0, 1):
        for j in (-1, 0, 1):
            yy, xx = f"least(greatest(y + ({i}), 0), 7)", f"least(greatest(x + ({j}), 0), 7)"
            lv = level.replace("y + dy", yy).replace("x + dx", xx)
            code = f"{_LIN}[CAST(floor(c[{yy} * 8 + {xx} + 1] / 64) AS INTEGER) + 1]"
            cols.append(f"{_clamp(f'({code} - ({lv})) / ({WHITE}::DOUBLE - ({lv}))')} AS {s(i, j)}")
    h, v = f"({s(0, -1)} + {s(0, 1)}) / 2", f"({s(-1, 0)} + {s(1, 0)}) / 2"
    diag = f"({s(-1, -1)} + {s(-1, 1)} + {s(1, -1)} + {s(1, 1)}) / 4"
    r, g, b = (x.replace(_s(0, 0), s(0, 0)) for x in _spread(h, v, diag, f"CASE WHEN {_site(0, 0)} = 1 THEN {s(0, 0)} ELSE ({h} + {v}) / 2 END"))
    steps = [("a1", "nb", {"r": r, "g": g, "b": b}), ("a2", "a1", {c: _f16(c) for c in "rgb"}), ("a3", "a2", {c: f"{c} / {_n(n)}" for c, n in zip("rgb", NEUTRAL, strict=True)})]
    steps += [("a4", "a3", {c: _f16(c) for c in "rgb"}), ("a5", "a4", dict(zip("rgb", _matrix(_M), strict=True))), ("a6", "a5", {c: _f16(c) for c in "rgb"})]
    return f"{_PX}, nb AS (SELECT image_id, y, x, {', '.join(cols)} FROM px)" + "".join(f", {n} AS (SELECT image_id, y, x, {', '.join(f'{e} AS {c}' for c, e in m.items())} FROM {f})" for n, f, m in steps)


def _classic() -> str:
    """The long graph on top of it: chroma shrink, tone, table and sharpening; ``z(image_id, y, x, r, g, b)``."""
    lists = lambda name, f: f", {name}l AS (SELECT image_id, {', '.join(f'list({c} ORDER BY y, x) AS l{c}' for c in 'rgb')} FROM {f} GROUP BY image_id), {name} AS (SELECT p.*, lr, lg, lb FROM {f} p JOIN {name}l USING (image_id))"
    at = lambda c, dy, dx: f"l{c}[(y - y % 2 + {dy}) * 8 + (x - x % 2 + {dx}) + 1]"
    co, cg = (lambda a, b: f"({at('r', a, b)} - {at('b', a, b)})"), (lambda a, b: f"({at('g', a, b)} - ({at('r', a, b)} + {at('b', a, b)}) / 2)")
    soft = lambda v: f"(CASE WHEN {v} > 0.035e0 THEN {v} - 0.035e0 WHEN {v} < -0.035e0 THEN {v} + 0.035e0 ELSE 0 END)"
    cols = []
    for n, f in (("o", co), ("g", cg)):
        p = [f(0, 0), f(0, 1), f(1, 0), f(1, 1)]
        for name, signs in (("l", "++++"), ("h", "+-+-"), ("v", "++--"), ("d", "+--+")):
            cols.append(f"({' '.join((s if k else '') + x for k, (s, x) in enumerate(zip(signs, p, strict=True)))}) / 4 AS {n}{name}")
    sx, sy = "(1 - 2 * (x % 2))", "(1 - 2 * (y % 2))"
    back = {n: f"({n}l + {sx} * {soft(n + 'h')} + {sy} * {soft(n + 'v')} + {sx} * {sy} * {soft(n + 'd')})" for n in "og"}
    t = "((r + 2 * g + b) / 4 - vg / 2)"
    shrunk = {"r": f"greatest(0e0, {t} + vo / 2)", "g": f"greatest(0e0, {t} + vg)", "b": f"greatest(0e0, {t} - vo / 2)"}
    each = lambda name, f, m: f", {name} AS (SELECT image_id, y, x, {', '.join(f'{_f16(v)} AS {c}' for c, v in m.items())} FROM {f})"
    sql = _scene() + lists("w", "a6") + f", w1 AS (SELECT *, {', '.join(cols)} FROM w), w2 AS (SELECT *, {back['o']} AS vo, {back['g']} AS vg FROM w1), w3 AS (SELECT image_id, y, x, {', '.join(f'{v} AS {c}' for c, v in shrunk.items())} FROM w2)"
    sql += each("w4", "w3", {c: c for c in "rgb"})
    tone = {c: _clamp(f"greatest({c}, 0e0) * (greatest({c}, 0e0) / 1e12 + 1) / (greatest({c}, 0e0) + 1)") for c in "rgb"}
    sql += f", t0 AS (SELECT image_id, y, x, {', '.join(f'{v} AS {c}' for c, v in tone.items())} FROM w4)" + each("rgba", "t0", {c: c for c in "rgb"})
    ctes, value = _lut_steps("tetrahedral")
    sql += f"{ctes}, t2 AS (SELECT image_id, y, x, {', '.join(f'{v} AS {c}' for c, v in value.items())} FROM l2)" + each("t3", "t2", {c: c for c in "rgb"}) + lists("u", "t3")
    mean = lambda c: _add(*[_add(*[f"l{c}[least(greatest(y + ({a}), 0), 7) * 8 + least(greatest(x + ({b}), 0), 7) + 1]" for a in (-1, 0, 1)]) for b in (-1, 0, 1)]) + " / 9"
    sql += f", u1 AS (SELECT image_id, y, x, {', '.join(f'greatest(0e0, {c} + 0.75e0 * ({c} - {mean(c)})) AS {c}' for c in 'rgb')} FROM u)"
    return sql + each("z", "u1", {c: c for c in "rgb"})


@query(_scene() + _out(_SRGB | {"a": "255"}, "a6"))
def min_pipeline(spark, d):
    """The smallest whole graph: mosaic codes to 8-bit sRGB."""
    return out(run_graph(raw_frame(spark, d), chain(MINIMUM)), *P.RGB, "a")


@query(_scene() + _out(_SRGB | {"a": "255"}, "a6"))
def dng_min_pipeline(spark, d):
    """The same from the bytes of DNG files, in tiles of 4x4 that exchange halos."""
    files = dng_files(spark, d)
    return out(S.pixels(by_path(graph_tiles(D.dng_frame(files, 4), chain(MINIMUM)), spark, d), (*P.RGB, "a")), *P.RGB, "a")


@query(_scene() + _out({c: _q(c, 255) for c in "rgb"} | {"a": "255"}, "a6"))
def graph_conversion(spark, d):
    """A graph whose last node takes 8 bits: the conversion is put in."""
    return out(run_graph(raw_frame(spark, d), chain([*MINIMUM[:-1], "builtin.passthrough"])), *P.RGB, "a")


def _look(spark: SparkSession) -> str:
    """A table file in the shared folder, made in closed form."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    path = f"{folder.rstrip('/')}/tessella-look-17.cube"
    rasters.write_cube(spark, path, 17, _grid)
    return path


@query(_classic() + _out(_SRGB | {"a": "255"}, "z"))
def full_classic_sdr(spark, d):
    return out(run_graph(raw_frame(spark, d), chain(STAGES, {"color.3d_lut": {"lut_path": _look(spark)}})), *P.RGB, "a")


@query(_classic() + _out(_PQ | {"a": "65472"}, "z"))
def full_classic_hdr(spark, d):
    return out(run_graph(raw_frame(spark, d), chain(STAGES, {STAGES[-1]: {"target": "BT2020-PQ"}, "color.3d_lut": {"lut_path": _look(spark)}})), *P.RGB, "a")


def _lens() -> str:
    gain = f"(1 + {_R2} * (0.5e0 + {_R2} * 0.1e0))"
    px = {c: f"CASE WHEN {_IN} THEN {_f16(f'{c} * {gain}')} ELSE 0 END" for c in "rgb"}
    return _rgba() + ", h AS (SELECT image_id, y, x, " + ", ".join(f"{_f16(c)} AS {c}" for c in "rgb") + " FROM rgba)" + _out(px | {"a": f"CASE WHEN {_IN} THEN 1 ELSE 0 END"}, "h")


@query(_lens())
def lens_opcodes(spark, d):
    """A list of opcodes in their order: an optional unknown one, a vignette fix and a trim."""
    import base64
    import struct

    ops = dng.opcode_list((99, 1, b""), (3, 0, struct.pack(">7d", 0.5, 0.1, 0, 0, 0, 0.5, 0.5)), (6, 0, struct.pack(">4I", 1, 2, 6, 7)))
    meta = json.dumps({"opcode3": base64.b64encode(ops).decode()})
    tiles = rgba_tiles(spark, d).withColumn("meta", F.lit(meta))
    frame = D.Frame(tiles, spark.createDataFrame([(meta,)], "meta string"))
    frame = frame.each(lambda p, *_: D.f16(p))
    return out(S.pixels(D.lens_opcodes(frame, {}).tiles, (*P.RGB, "a")), *P.RGB, "a")


@query("""WITH i AS (SELECT CAST(vec_id AS BIGINT) AS image_id, label % 6 AS k FROM embeddings)
SELECT image_id, k IN (0, 1, 2, 3) AS bayer, k = 4 AS quad FROM i""")
def cfa_predicates(spark, d):
    patterns = [*D.BAYER, D.QUAD_BAYER, [0, 1, 2, 1]]
    k = F.col("label") % 6
    pattern = F.get(F.array(*[F.array(*[F.lit(v) for v in p]) for p in patterns]), k)
    side = F.when(k == 4, F.lit(4)).otherwise(F.lit(2))
    images = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("image_id"), F.array(side, side).alias("repeat"), pattern.alias("pattern"))
    return images.select("image_id", D.is_bayer(F.col("repeat"), F.col("pattern")).alias("bayer"), D.is_quad_bayer(F.col("repeat"), F.col("pattern")).alias("quad"))


@query("""WITH e AS (SELECT event_id, event_type, props FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'opcode_list_2,props' ELSE 'opcode_list_2,props,' || event_type END AS keys, CASE WHEN event_type = 'error' THEN NULL ELSE props END AS own FROM e""")
def ext_blobs(spark, d):
    """Named blobs of an image: set, read, erase and list."""
    rows = events(spark, d).withColumn("blobs", B.blobs())
    rows = rows.withColumn("blobs", B.put(B.put(B.put(F.col("blobs"), F.lit("props"), F.col("props").cast("binary")), F.col("event_type"), F.col("props").cast("binary")), F.lit("opcode_list_2"), F.lit("x").cast("binary")))
    rows = rows.withColumn("blobs", F.when(F.col("event_type") == "error", B.erase(F.col("blobs"), F.lit("error"))).otherwise(F.col("blobs")))
    # The keys come in order; the event's own name is put last.
    keys = F.array_sort(F.array_remove(B.keys(F.col("blobs")), F.col("event_type")))
    named = F.when(F.array_contains(B.keys(F.col("blobs")), F.col("event_type")), F.concat(keys, F.array("event_type"))).otherwise(keys)
    return rows.select("event_id", F.array_join(named, ",").alias("keys"), B.get(F.col("blobs"), F.col("event_type")).cast("string").alias("own"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a graph of its lines: each feeds the next, and the one after it too if its part has an even key."""
    order = Window.partitionBy("l_orderkey")
    place = F.row_number().over(order.orderBy("l_linenumber", "l_partkey"))  # numbers of lines repeat
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("graph"), place.alias("id"), (F.col("l_partkey") % 2 == 0).alias("even"), F.count(F.lit(1)).over(order).alias("top"))
    nodes = lines.select("graph", "id")
    far = lines.select("graph", "id", "top", F.explode(F.when(F.col("even"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("step"))
    edges = far.where(F.col("id") + F.col("step") <= F.col("top")).select("graph", F.col("id").alias("a"), (F.col("id") + F.col("step")).alias("b"))
    return G.plans(nodes, edges)


_PLANS = """WITH n AS (SELECT l_orderkey AS graph, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS id, l_partkey % 2 = 0 AS even, count(*) OVER (PARTITION BY l_orderkey) AS top FROM lineitem),
p AS (SELECT graph, CAST(id AS INTEGER) AS id, CAST(id - 1 AS INTEGER) AS place, CAST(id - 1 + CASE WHEN even AND id + 2 <= top THEN 3 WHEN id + 1 <= top THEN 2 ELSE 1 END AS INTEGER) AS stop FROM n)"""


@query(f"{_PLANS} SELECT graph, id, place, stop FROM p")
def plan_toposort(spark, d):
    return _orders(spark, d).select("graph", "id", "place", "stop")


@query(f"{_PLANS} SELECT a.graph, a.id AS one, b.id AS other FROM p a JOIN p b ON a.graph = b.graph AND a.place < b.place AND b.place < a.stop")
def plan_interference(spark, d):
    return G.interference(_orders(spark, d))


@query(f"{_PLANS} SELECT graph, CAST(max(c) AS INTEGER) AS slots FROM (SELECT b.graph, b.place, count(*) AS c FROM p a JOIN p b ON a.graph = b.graph AND a.place <= b.place AND b.place < a.stop GROUP BY b.graph, b.place) GROUP BY graph")
def plan_memory(spark, d):
    return _orders(spark, d).groupBy("graph").agg((F.max("slot") + 1).cast("int").alias("slots"))


# Events.


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM g GROUP BY user_id, k""")
def ev_debounce(spark, d):
    return E.debounce(events(spark, d), ["user_id"], "6 hours")


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS n FROM events GROUP BY user_id, event_type")
def ev_latest_param(spark, d):
    return E.latest(events(spark, d), ["user_id", "event_type"])


@query("""WITH RECURSIVE k AS (SELECT user_id, min(epoch_ms(ts)) AS ms FROM events GROUP BY user_id
UNION ALL SELECT k.user_id, n.ms FROM k, LATERAL (SELECT min(epoch_ms(e.ts)) AS ms FROM events e WHERE e.user_id = k.user_id AND epoch_ms(e.ts) >= k.ms + 7200000) n WHERE n.ms IS NOT NULL),
r AS (SELECT e.event_id, e.user_id, e.ts, row_number() OVER (PARTITION BY e.user_id, epoch_ms(e.ts) ORDER BY e.ts, e.event_id) AS n, epoch_ms(e.ts) AS ms FROM events e)
SELECT r.event_id, r.user_id, r.ts FROM r JOIN k ON k.user_id = r.user_id AND k.ms = r.ms WHERE r.n = 1""")
def ev_throttle(spark, d):
    rows = events(spark, d).select("event_id", "user_id", "ts").where("user_id is not null")  # as in SQL, where null equals nothing
    return E.throttle(rows, ["user_id"], 7_200_000)


@query("""SELECT CAST(user_id % 7 AS BIGINT) AS node_id, event_type AS port, count(*) AS subscribers, CAST(CASE WHEN count(*) > 4 THEN 2 ELSE max(1 + event_id % 60) END AS BIGINT) AS fps, CAST(max(1 + event_id % 256) AS BIGINT) AS size
FROM events GROUP BY 1, 2""")
def ev_fanout(spark, d):
    rows = events(spark, d).select((F.col("user_id") % 7).alias("node_id"), F.col("event_type").alias("port"), (F.col("event_id") % 60 + 1).alias("fps"), (F.col("event_id") % 256 + 1).alias("size"))
    done = E.fan_out(rows)
    return done.select("node_id", "port", "subscribers", F.col("fps").cast("long"), F.col("size").cast("long"))


@query("""WITH l AS (SELECT user_id, CAST(event_id % 40 AS BIGINT) AS item, max(ts) AS ts FROM events GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item) AS INTEGER) AS rank FROM l) SELECT user_id, item, ts, rank FROM r WHERE rank <= 10""")
def recent_top10(spark, d):
    return E.recent(events(spark, d).withColumn("item", F.col("event_id") % 40), "user_id", "item")


_CONTROL = "CASE event_type WHEN 'signup' THEN 'unsubscribe' WHEN 'view' THEN 'subscribe' WHEN 'click' THEN 'subscribe' ELSE event_type END"


@query(f"""WITH c AS (SELECT user_id AS client, {_CONTROL} AS kind, ts, event_id, event_type FROM events), l AS (SELECT client, arg_max(struct_pack(k := kind, e := event_id, p := event_type), (ts, event_id)) AS c FROM c WHERE kind IN ('subscribe', 'unsubscribe') GROUP BY client)
SELECT client, c.e % 7 AS node_id, c.p AS port, least(greatest(c.e % 400, 1), 256) AS max_size, least(greatest(c.e % 90, 1), 60) AS fps FROM l WHERE c.k = 'subscribe'""")
def ev_subscriptions(spark, d):
    return E.subscriptions(_controls(spark, d))


def _controls(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).select(F.col("user_id").alias("client"), "ts", "event_id", F.expr(_CONTROL).alias("kind"), (e % 7).alias("node_id"), F.col("event_type").alias("port"), (e % 400).alias("max_size"), (e % 90).alias("fps"))


@query("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o), b AS (SELECT user_id, max(ts) AS last_ts FROM g GROUP BY user_id, k)
SELECT user_id, last_ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last_ts) AS BIGINT) AS run_id, 'completed' AS status FROM b""")
def ev_runs(spark, d):
    return E.runs(E.debounce(events(spark, d), ["user_id"], "6 hours"), "user_id").select("user_id", "last_ts", "run_id", "status")


@query("""WITH a AS (SELECT user_id, event_id, ts, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pipeline_id FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, pipeline_id ORDER BY ts, event_id) - 1 AS number FROM a WHERE pipeline_id IS NOT NULL)
SELECT user_id, event_id, pipeline_id, CAST(number AS BIGINT) AS number FROM n WHERE event_type <> 'signup'""")
def ev_active(spark, d):
    return E.active(events(spark, d), "user_id", F.col("event_type") == "signup").select("user_id", "event_id", "pipeline_id", "number")


@query(f"""WITH c AS (SELECT user_id AS client, arg_max({_CONTROL}, (ts, event_id)) AS kind FROM events WHERE {_CONTROL} IN ('subscribe', 'unsubscribe') GROUP BY user_id)
SELECT e.event_id, c.client FROM events e JOIN c ON c.client % 50 = e.user_id % 50 WHERE e.event_type = 'error' AND c.kind = 'subscribe'""")
def ev_broadcast(spark, d):
    frames = events(spark, d).where("event_type = 'error'").select("event_id", (F.col("user_id") % 50).alias("session"))
    clients = E.subscriptions(_controls(spark, d)).select("client", (F.col("client") % 50).alias("session"))
    return E.broadcast(frames, clients, "session").select("event_id", "client")


@query("""WITH c AS (SELECT user_id, min(ts) + INTERVAL 7 DAY AS expires_at FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT e.event_id, CASE WHEN coalesce(c.expires_at > e.ts, false) OR e.event_type <> 'error' THEN 'ready' WHEN c.expires_at IS NOT NULL THEN 'stale' ELSE 'error' END AS status, coalesce(c.expires_at > e.ts, false) AS from_cache
FROM events e LEFT JOIN c USING (user_id)""")
def ev_schema_cache(spark, d):
    entries = events(spark, d).where("event_type = 'view'").groupBy("user_id").agg((F.min("ts") + F.expr("interval 7 days")).alias("expires_at"))
    requests = events(spark, d).select("event_id", "user_id", F.col("ts").alias("now"), (F.col("event_type") != "error").alias("reachable"))
    return E.cached(requests, entries, "user_id").select("event_id", "status", "from_cache")


@query("""SELECT event_id, printf('%02X%08X%08X%08X', event_id % 5, user_id, event_id * 86400000 % 4294967296, strlen(props)) || hex(encode(props)) AS frame, CAST(user_id AS BIGINT) AS node, event_id * 86400000 % 4294967296 AS ts_ms, props AS payload FROM events""")
def ev_frames(spark, d):
    frame = E.frames(F.col("event_id") % 5, F.col("user_id"), F.col("event_id") * 86_400_000, F.col("props").cast("binary"))
    rows = events(spark, d).withColumn("f", frame).withColumn("p", E.parsed_frames(F.col("f")))
    return rows.select("event_id", F.hex("f").alias("frame"), "p.node", "p.ts_ms", F.col("p.payload").cast("string").alias("payload"))
