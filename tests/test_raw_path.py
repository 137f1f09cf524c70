"""From raw files to pixels: parsers, opcodes, white balance, tables and graphs, by hand-made files and known values."""

import base64
import json
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from compare import SF
from pyspark.sql import functions as F

from tessella import queries as Q
from tessella.functions import blobs as B
from tessella.functions import pixel as P
from tessella.operators import measure as M
from tessella.operators import nodes as D
from tessella.operators import pointwise as N
from tessella.operators import stencil as S
from tessella.operators.pointwise import NodeError
from tessella.plans import graph as G
from tessella.sources import dng, rasters

CODES = (64 + 9 * np.arange(12)).reshape(3, 4)
IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
FIELDS = {"linearization": [0, 128, 1024, 4095], "black": [64, 65, 66, 67], "white": 4095, "color_matrix1": IDENTITY, "color_matrix2": IDENTITY, "forward_matrix1": IDENTITY, "forward_matrix2": IDENTITY, "neutral": [1.0, 2.0, 3.0], "illuminant1": 21, "illuminant2": 17, "make": "Some", "model": "Camera 8", "active_area": [0, 1, 3, 4]}


def code(f):
    with pytest.raises(NodeError) as e:
        f()
    return e.value.code


# Files.


def test_dng_fields_and_samples():
    data = dng.encode(CODES, **FIELDS)
    head = dng.header(data)
    assert (head["height"], head["width"], head["cfa_repeat"], head["cfa_pattern"]) == (3, 4, [2, 2], [0, 1, 1, 2])
    assert head["active_area"] == [1, 0, 3, 3] and head["linearization"] == [0, 128, 1024, 4095] and head["black"] == [64, 65, 66, 67] and head["white"] == 4095
    assert head["neutral"] == [1.0, 2.0, 3.0] and head["color_matrix1"] == IDENTITY and (head["illuminant1"], head["illuminant2"]) == (21, 17)
    assert (head["camera_id"], head["physical_camera_id"]) == ("Some", "Camera 8")
    assert (dng.samples(data, head) == CODES).all()


@pytest.mark.parametrize("broken", [
    b"MM\0*" + bytes(20), b"II*\0", b"II*\0\xff\xff\0\0", dng.encode(CODES, **FIELDS)[:60], dng.encode(CODES, samples=3), dng.encode(CODES, photometric=2), dng.encode(CODES, cfa_repeat=[3, 3]), dng.encode(CODES, cfa_pattern=b"\0\1"),
    dng.encode(CODES, bits=12), dng.encode(CODES, compression=7), dng.encode(CODES, height=0),
])
def test_dng_that_is_none(broken):
    assert code(lambda: dng.header(broken)) == "FAILED"


def test_dng_strip_past_the_end():
    data = dng.encode(CODES, **FIELDS)
    assert code(lambda: dng.samples(data[:-1], dng.header(data))) == "FAILED"


def gain_map(plane=0, planes=1, gain=(1, 2, 3, 5), points=(2, 2), spacing=(2.0, 2.0), pitch=(1, 1), map_planes=1):
    return struct.pack(">10I4dI", 0, 0, 4, 4, plane, planes, *pitch, *points, *spacing, 0.0, 0.0, map_planes) + struct.pack(f">{len(gain)}f", *gain)


def test_gain_maps():
    assert dng.gain_maps(b"") == [] and dng.gain_maps(dng.opcode_list((1, 0, b"abc"))) == []
    (m,) = dng.gain_maps(dng.opcode_list((9, 0, gain_map())))
    assert (m["points"], m["spacing"], m["gain"]) == ((2, 2), (2.0, 2.0), [1, 2, 3, 5])
    for blob in (b"\0\0", dng.opcode_list((9, 0, gain_map()))[:-3], dng.opcode_list((9, 0, gain_map()[:70])), dng.opcode_list((9, 0, gain_map(gain=(1, 2))))):
        assert code(lambda: dng.gain_maps(blob)) == "FAILED"  # noqa: B023
    for bad in ({"planes": 3}, {"plane": 1}, {"pitch": (0, 1)}, {"map_planes": 2}, {"spacing": (0.0, 1.0)}, {"spacing": (float("nan"), 1.0)}):
        assert code(lambda: dng.gain_maps(dng.opcode_list((9, 0, gain_map(**bad))))) == "UNSUPPORTED"  # noqa: B023


WARP = struct.pack(">I8d", 1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5)
VIGNETTE = struct.pack(">7d", 1, 0, 0, 0, 0, 0.5, 0.5)


def test_lens_opcode_lists():
    assert dng.lens_opcodes(b"") == []
    ops = dng.lens_opcodes(dng.opcode_list((1, 0, WARP), (3, 1, VIGNETTE), (4, 0, struct.pack(">2I", 7, 0)), (5, 0, struct.pack(">9I", 0, 1, 1, 2, 3, 4, 5, 6, 7)), (6, 0, struct.pack(">4I", 1, 1, 3, 3)), (77, 1, b"?")))
    assert [op["id"] for op in ops] == [1, 3, 4, 5, 6, 77] and [op["optional"] for op in ops] == [False, True, False, False, False, True]
    assert ops[2]["constant"] == 7 and ops[3]["points"] == [(2, 3)] and ops[3]["rects"] == [(4, 5, 6, 7)] and ops[0]["cx"] == 0.5
    assert code(lambda: dng.lens_opcodes(dng.opcode_list((77, 0, b"")))) == "UNSUPPORTED"
    for body in ((1, 0, WARP[:-1]), (1, 0, struct.pack(">I2d", 0, 0.5, 0.5)), (3, 0, VIGNETTE + b"\0"), (4, 0, b"\0"), (5, 0, struct.pack(">3I", 0, 1, 0)), (6, 0, b"")):
        assert code(lambda: dng.lens_opcodes(dng.opcode_list(body))) == "FAILED"  # noqa: B023
    for blob in (b"\0\0\0", dng.opcode_list((3, 0, VIGNETTE))[:-1], struct.pack(">I", 2)):
        assert code(lambda: dng.lens_opcodes(blob)) == "FAILED"  # noqa: B023


def test_raw_binaries(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(CODES.astype("<u2").tobytes())
    rows = rasters.raw_images(spark, f"file://{tmp_path}/a.raw", 3, 4).collect()
    assert list(rows[0].codes) == CODES.ravel().tolist()
    with pytest.raises(Exception, match="FAILED"):
        rasters.raw_images(spark, f"file://{tmp_path}/a.raw", 3, 5).collect()


# Tables.

CUBE = "TITLE \"x\"\n# none\nLUT_3D_SIZE 2\nDOMAIN_MIN 0 0 0\n" + "\n".join(f"{r} {g} {b} # c" for r in (0, 1) for g in (0, 1) for b in (0, 1))
SPI = "SPILUT 1.0\n3 3\n2 2 2\n" + "\n".join(f"{r} {g} {b} {r} {g} {b}" for b in (0, 1) for g in (0, 1) for r in (0, 1))


def test_identity_tables(spark, tmp_path):
    own = [float(v) for r in (0, 1) for g in (0, 1) for b in (0, 1) for v in (r, g, b)]
    assert rasters.parse_lut(CUBE, "cube") == (2, own) and rasters.parse_lut(SPI, "spi3d") == (2, own)
    (tmp_path / "x.CUBE").write_text(CUBE)
    assert rasters.read_lut(spark, f"file://{tmp_path}/x.CUBE") == (2, own)
    px = spark.createDataFrame([(1, 0, 0, 0.25, 0.5, 0.75, 0.5), (1, 0, 1, -1.0, 2.0, 1.0, 1.0)], "image_id long, y int, x int, r double, g double, b double, a double")
    for how in ("tetrahedral", "trilinear"):
        got = N.lut3d(px, 2, own, how).orderBy("x").collect()
        assert [tuple(r)[3:] for r in got] == [(0.25, 0.5, 0.75, 0.5), (0.0, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("text, kind", [
    (CUBE.replace("1 1 1 #", "1 1 x #"), "cube"), (CUBE.replace("LUT_3D_SIZE 2", "LUT_3D_SIZE 3"), "cube"), (CUBE.replace("LUT_3D_SIZE 2\n", ""), "cube"), (CUBE.replace("LUT_3D_SIZE 2", "LUT_3D_SIZE x"), "cube"), (CUBE + "\nhello", "cube"),
    (SPI.replace("SPILUT", "OTHER"), "spi3d"), (SPI.replace("1 1 1 1 1 1", ""), "spi3d"), (SPI.replace("1 1 1 1 1 1", "5 1 1 1 1 1"), "spi3d"), (SPI.replace("2 2 2", "2 2 3"), "spi3d"), ("LUT_3D_SIZE 1\n0 0 0", "cube"),
])
def test_malformed_tables(text, kind):
    assert code(lambda: rasters.parse_lut(text, kind)) == "FAILED"


def test_one_dimensional_look(spark):
    text = "Version 1\nFrom 0 1\nLength 3\nComponents 3\n{\n 0 0 0\n 0.25 0.25 0.25\n 1 1 1\n}\n"
    low, high, values = rasters.parse_look(text)
    assert (low, high, values) == (0.0, 1.0, [0.0, 0.25, 1.0])
    got = spark.createDataFrame([(v,) for v in (-1.0, 0.25, 0.5, 0.75, 1.0, 2.0)], "v double").select(rasters.look(F.col("v"), low, high, values).alias("v")).collect()
    assert [r.v for r in got] == [0.0, 0.125, 0.25, 0.625, 1.0, 1.0]
    assert code(lambda: rasters.parse_look(text.replace("Length 3", "Length 4"))) == "FAILED"


# Half floats, blobs and white balance.


def test_half_floats_at_their_ends(spark):
    values = [65504.0, 65519.9, 65520.0, -70000.0, 6e-8, 1e-9, float("inf"), float("nan"), 0.1]
    got = [r.h for r in spark.createDataFrame([(v,) for v in values], "v double").select(P.f16(F.col("v")).alias("h")).collect()]
    with np.errstate(over="ignore"):
        assert np.array_equal(got, np.array(values).astype(np.float16).astype(float), equal_nan=True)


def test_blobs(spark):
    own = B.put(B.put(B.blobs(), F.lit("b"), F.lit("1").cast("binary")), F.lit("a"), F.lit("2").cast("binary"))
    row = spark.range(1).select(own.alias("m")).select(B.keys(F.col("m")).alias("k"), B.get(F.col("m"), F.lit("b")).alias("b"), B.get(F.col("m"), F.lit("c")).alias("c"), B.keys(B.erase(F.col("m"), F.lit("a"))).alias("rest"), B.get(B.put(F.col("m"), F.lit("a"), F.lit("3").cast("binary")), F.lit("a")).alias("a"), B.keys(B.put(F.col("m"), F.lit("a"), F.lit(None).cast("binary"))).alias("gone")).first()
    assert (row.k, bytes(row.b), row.c, row.rest, bytes(row.a), row.gone) == (["a", "b"], b"1", None, ["b"], b"3", ["b"])


IMAGE = {"neutral": [0.9520738, 1.0, 0.8886605], "illuminant1": 17, "illuminant2": 21, "color_matrix1": [1.2, 0, 0, 0, 1, 0, 0, 0, 0.8], "color_matrix2": [0.9, 0, 0, 0, 1, 0, 0, 0, 1.1], "forward_matrix1": [float(k) for k in range(1, 10)], "forward_matrix2": [float(k) for k in range(9, 0, -1)]}


def test_dual_illuminant():
    got = M.dual_illuminant(IMAGE)
    assert abs(got["scene_cct"] - 5000) < 0.5 and abs(got["dual_illuminant_weight"] - 0.23424658) < 2.5e-4
    assert np.allclose(got["camera_to_xyz_d50"], [7.1260276, 6.5945206, 6.0630136, 5.5315065, 5, 4.4684930, 3.9369864, 3.4054794, 2.8739727], rtol=1e-3)
    assert np.allclose(got["camera_diag"], 1 / np.array(IMAGE["neutral"]))
    plain = M.dual_illuminant(IMAGE | {"forward_matrix2": None})
    w = plain["dual_illuminant_weight"]
    assert np.allclose(np.array(plain["camera_to_xyz_d50"]).reshape(3, 3), np.diag([1 / (1.2 * w + 0.9 * (1 - w)), 1, 1 / (0.8 * w + 1.1 * (1 - w))]))
    for broken in ({"neutral": [0.0, 1, 1]}, {"neutral": [1.0, float("nan"), 1]}, {"neutral": None}, {"illuminant1": 3}, {"color_matrix1": None}, {"color_matrix1": [0.0] * 9, "color_matrix2": [0.0] * 9}):
        assert code(lambda: M.dual_illuminant(IMAGE | broken)) == "NEED_METADATA"  # noqa: B023


def test_scene_temperature_against_a_dense_search(spark):
    """The query's temperatures are the best of all between 1500 and 10000 K, tried one tenth of a kelvin apart."""
    rows = Q.wb_cct(spark, "/root/testdata/sf0.001").orderBy("image_id").limit(12).collect()
    neutrals = {r.image_id: np.array([r.nr, r.ng, r.nb]) for r in M.greyworld(Q.rgba(spark, "/root/testdata/sf0.001")).collect()}
    t = np.arange(1500.0, 10000.05, 0.1)
    one, two = np.array(Q.MATRIX1, float), np.array(Q.MATRIX2, float)
    for r in rows:
        w = np.clip((1 / t - 1 / 6500) / (1 / 2850 - 1 / 6500), 0, 1)[:, None]
        xyz = neutrals[r.image_id] / (one[[0, 4, 8]] * w + two[[0, 4, 8]] * (1 - w))  # both matrices are diagonal
        x, y = M._locus(t)
        error = (xyz[:, 0] / xyz.sum(1) - x) ** 2 + (xyz[:, 1] / xyz.sum(1) - y) ** 2
        best = error.min()
        at = t[error <= best + 1e-12]
        assert at.min() - 0.2 <= r.cct <= at.max() + 0.2
        assert abs(r.weight - np.clip((1 / r.cct - 1 / 6500) / (1 / 2850 - 1 / 6500), 0, 1)) < 1e-3


def test_grey_world_without_light(spark):
    px = spark.createDataFrame([(1, 0, 0, 0.5, 0.5, 0.25, 1.0), (2, 0, 0, 0.0, 0.5, 0.5, 1.0), (3, 0, 0, float("nan"), 0.5, 0.5, 1.0)], "image_id long, y int, x int, r double, g double, b double, a double")
    assert [tuple(r) for r in M.greyworld(px, strict=False).collect()] == [(1, 1.0, 1.0, 0.5)]
    with pytest.raises(Exception, match="NEED_METADATA"):
        M.greyworld(px).collect()


# Nodes over tiles.


def frame(spark, planes, meta, size=0):
    """A frame of one image, cut into tiles of ``size``."""
    planes = np.asarray(planes, float)
    height, width = planes.shape[1:]
    said = json.dumps({k: base64.b64encode(v).decode() if isinstance(v, bytes) else v for k, v in meta.items()})
    rows = []
    for y in range(0, height, size or height):
        for x in range(0, width, size or width):
            part = planes[:, y : y + (size or height), x : x + (size or width)]
            rows.append((1, height, width, y, x, part.shape[1], part.shape[2], [p.ravel().tolist() for p in part], said))
    images = spark.createDataFrame([(1, height, width, said)], "image_id long, height int, width int, meta string")
    return D.Frame(spark.createDataFrame(rows, S.TILES), images, size)


def planes_of(frame):
    rows = frame.tiles.collect()
    out = np.zeros((len(rows[0].planes), rows[0].height, rows[0].width))
    for r in rows:
        out[:, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.array(r.planes).reshape(-1, r.h, r.w)
    return out


def test_black_level_node(spark):
    meta = {"cfa_repeat": [2, 2], "cfa_pattern": [0, 1, 1, 2], "black": [10, 20, 30, 30], "white": 110}
    got = planes_of(D.black_level(frame(spark, [[[10, 65, 110, 200], [20, 70, 0, 110]]], meta), {}))[0]
    assert np.allclose(got, [[0, 0.5, 1, 1], [0, 0.5, 0, 1]])
    with pytest.raises(Exception, match="NEED_METADATA"):
        D.black_level(frame(spark, [[[1.0]]], meta | {"white": 20}), {}).tiles.collect()


def test_gain_map_node(spark):
    meta = {"cfa_repeat": [2, 2], "cfa_pattern": [0, 1, 1, 2], "opcode2": dng.opcode_list((9, 0, gain_map()))}
    got = planes_of(D.shading_gain(frame(spark, np.full((1, 3, 3), 10.0), meta, 2), {}))[0]
    assert got[0].tolist() == [10, 15, 20] and got[1, 1] == 27.5 and got[2, 2] == 50
    quad = {"cfa_repeat": [4, 4], "cfa_pattern": D.QUAD_BAYER, "opcode2": dng.opcode_list(*[(9, 0, gain_map(k, 4, (k + 1,) * 4)) for k in range(4)])}
    got = planes_of(D.shading_gain(frame(spark, np.ones((1, 8, 8)), quad, 4), {}))[0]
    assert got[:4, :4].tolist() == np.kron([[1, 2], [3, 4]], np.ones((2, 2))).tolist() and (got[4:, 4:] == got[:4, :4]).all()
    assert (planes_of(D.shading_gain(frame(spark, np.ones((1, 4, 4)), quad | {"opcode2": b""}), {})) == 1).all()
    with pytest.raises(Exception, match="UNSUPPORTED"):
        D.shading_gain(frame(spark, np.ones((1, 4, 4)), quad | {"opcode2": dng.opcode_list((9, 0, gain_map(0, 4)))}), {}).tiles.collect()


def test_remosaic_node(spark):
    raw = (100 + 23 * np.arange(8)[:, None] + 11 * np.arange(8)[None, :])[None].astype(float)
    bayer = frame(spark, raw, {"cfa_repeat": [2, 2], "cfa_pattern": [0, 1, 1, 2]})
    assert (planes_of(D.remosaic(bayer, {})) == raw).all()
    quad = {"cfa_repeat": [4, 4], "cfa_pattern": D.QUAD_BAYER}
    one, several = D.remosaic(frame(spark, raw, quad), {}), D.remosaic(frame(spark, raw, quad, 4), {})
    assert (planes_of(one) == planes_of(several)).all() and json.loads(one.tiles.first().meta)["cfa_repeat"] == [2, 2]
    with pytest.raises(Exception, match="UNSUPPORTED"):
        D.remosaic(frame(spark, raw, quad | {"cfa_pattern": [0] * 16}), {}).tiles.collect()
    with pytest.raises(Exception, match="UNSUPPORTED"):
        D.RUN["demosaic.rcd"](frame(spark, raw, quad), {}).tiles.collect()


def lens(spark, planes, *ops, size=0):
    return planes_of(D.lens_opcodes(frame(spark, planes, {"opcode3": dng.opcode_list(*ops)}, size), {}))


@pytest.mark.parametrize("size", [0, 2])
def test_lens_opcodes_by_known_values(spark, size):
    ramp = D.f16(np.stack([np.arange(9).reshape(3, 3) / 10.0] * 4))
    assert (lens(spark, ramp, (1, 0, WARP), size=size) == ramp[0, 1, 1]).all()
    ones = np.ones((4, 3, 3))
    got = lens(spark, ones, (3, 0, VIGNETTE), size=size)
    assert np.allclose(got[0], [[2, 1.5, 2], [1.5, 1, 1.5], [2, 1.5, 2]]) and (got[3] == 1).all()
    hole = ones.copy()
    hole[:3, 1, 1] = 0
    assert (lens(spark, hole, (4, 0, struct.pack(">2I", 0, 0)), size=size) == 1).all()
    assert (lens(spark, hole, (5, 0, struct.pack(">5I", 0, 1, 0, 1, 1)), size=size) == 1).all()
    got = lens(spark, ones, (99, 1, b""), (6, 0, struct.pack(">4I", 1, 1, 3, 3)), size=size)
    assert got[:, 0, 0].tolist() == [0] * 4 and got[:, 1, 1].tolist() == [1] * 4 and got[:, 2, 2].tolist() == [1] * 4
    # In order: the trim first, then the vignette on what it left, not the other way round; without a list nothing happens.
    trimmed = lens(spark, ones, (6, 0, struct.pack(">4I", 0, 0, 1, 3)), (5, 0, struct.pack(">5I", 0, 1, 0, 0, 0)), size=size)
    assert trimmed[0, 0, 0] == 0.5 and trimmed[0, 1, 1] == 0
    assert (planes_of(D.lens_opcodes(frame(spark, ramp, {}, size), {})) == ramp).all()


def test_warp_of_a_part_is_an_error():
    assert code(lambda: S.warp_rectilinear([(1.0, 0, 0, 0, 0, 0)])(np.zeros((1, 1, 2, 2)), 0, 0, 4, 4)) == "BAD_INDEX"


@pytest.mark.parametrize("kind", ["demosaic.rcd", "demosaic.amaze", "denoise.guided_filter", "denoise.bm3d", "denoise.wavelet_bayes_shrink", "sharpen.edge_aware_usm"])
def test_tiles_make_the_same_image(spark, kind):
    """In one tile and in tiles of 8 with odd ones at the edges."""
    rng = np.random.default_rng(1)
    meta = {"cfa_repeat": [2, 2], "cfa_pattern": [2, 1, 1, 0], "noise_profile": [[1e-4, 1e-4]]}
    raw = D.f16(rng.random((1 if kind.startswith("demosaic") else 4, 19, 26)))
    params = {"radius": 2} if kind in ("denoise.guided_filter", "sharpen.edge_aware_usm") else {}
    got = [planes_of(D.RUN[kind](frame(spark, raw, meta, size), params)) for size in (0, 8)]
    assert np.array_equal(*got)


def test_noise_profile_sets_the_strength():
    assert abs(S.noise_sigma([(1e-4, 4e-4), (-1.0, 0.0)]) - (1e-4) ** 0.5) < 1e-12
    assert (S.noise_sigma([(1, 1)], 0.05, 0.1), S.noise_sigma(None, None, 0.5), S.noise_sigma()) == (0.05, 0.2, 0.03)


def test_fusion_and_exposures(spark):
    p = D.f16(np.random.default_rng(2).random((4, 4, 4)))
    under, normal, over = (frame(spark, D.f16(p * g), {}) for g in (0.25, 1, 4))
    got = planes_of(D.mertens(under, normal, over, {}))
    px = [S.pixels(f.tiles, ("r", "g", "b", "a")) for f in (under, normal, over)]
    want = np.array([[r.r, r.g, r.b] for r in N.mertens(*px).orderBy("y", "x").collect()]).T.reshape(3, 4, 4)
    assert np.allclose(got[:3], want, atol=1e-3)
    assert planes_of(D.RUN["fusion.hdr_plus_derivative"](under, normal, {})).tolist() == planes_of(under).tolist()


def test_grey_world_node(spark):
    p = D.f16(np.random.default_rng(3).random((4, 6, 6)) + 0.1)
    out = D.grey_world(frame(spark, p, IMAGE, 4), {})
    sums = p.sum((1, 2))
    assert np.allclose(planes_of(out)[:3], D.f16(p[:3] / np.array([sums[0] / sums[1], 1, sums[2] / sums[1]])[:, None, None]))
    assert json.loads(out.tiles.first().meta)["camera_to_xyz_d50"]


# Graphs.


def graph(*kinds, **more):
    return json.loads(Q.chain(list(kinds))) | more


def test_graph_from_a_file_to_pixels(spark, tmp_path):
    """The source node reads the file; precision, steps and tiles follow from there."""
    raw = (np.arange(24 * 20).reshape(24, 20) * 7) % 4
    (tmp_path / "one.dng").write_bytes(dng.encode(raw, **FIELDS | {"active_area": [0, 0, 24, 20]}))
    text = Q.chain(["builtin.dng_input", *Q.MINIMUM], {"builtin.dng_input": {"path": f"file://{tmp_path}/one.dng"}})
    out = G.fold(G.load(text), D.Frame(None, None), D.RUN, D.convert)
    got = planes_of(out)
    assert got.shape == (4, 24, 20) and (got[3] == 255).all() and got[:3].max() <= 255
    small = D.dng_frame(dng.read_dng(spark, f"file://{tmp_path}/one.dng"), 8)
    assert small.split == 8 and np.array_equal(planes_of(G.fold(G.load(Q.chain(Q.MINIMUM)), small, D.RUN, D.convert)), got)


def test_graph_errors():
    assert code(lambda: G.load("{}")) == "FAILED"
    assert code(lambda: G.load(json.dumps(graph("none.such")))) == "BAD_INDEX"
    assert code(lambda: G.load(json.dumps(graph("tone.reinhard")))) == "NEED_METADATA"
    doc = graph("linearize.dng_lut")
    assert code(lambda: G.load(json.dumps(doc | {"edges": [{"from": "gone.out", "to": "n00.in"}]}))) == "BAD_INDEX"
    assert code(lambda: G.load(json.dumps(doc | {"nodes": [{"id": "n00", "type": "linearize.dng_lut", "params": {"x": 1}}]}))) == "BAD_INDEX"
    two = graph("linearize.dng_lut", "blacklevel.dng_levels")
    assert code(lambda: G.load(json.dumps(two | {"edges": [{"from": "n00.out", "to": "n01.in"}, {"from": "n01.out", "to": "n00.in"}]}))) == "BAD_INDEX"
    assert code(lambda: G.load(Q.chain(Q.MINIMUM), cap_bytes=10)) == "OUT_OF_MEMORY"
    plan = G.load(json.dumps(doc))
    assert code(lambda: G.fold(plan, None, {})) == "NOT_IMPLEMENTED"
    for target in ("DisplayP3", "BT2020-HLG"):
        assert code(lambda: D.to_display(None, {"target": target})) == "UNSUPPORTED"  # noqa: B023
    assert code(lambda: D.lut3d(None, {})) == "NOT_FOUND" and code(lambda: D.dng_input(None, {})) == "NOT_FOUND"


def test_every_node_type_has_a_function():
    assert set(G.kinds()) - {"precision_convert"} == set(D.RUN) and G.kinds() == sorted(G.NODES)


def test_ports_in_their_order():
    text = json.dumps({"version": "0.4", "inputs": [{"port": "raw"}], "nodes": [{"id": "m", "type": "fusion.hdr_plus_derivative"}, {"id": "a", "type": "demosaic.quad_bayer_remosaic"}], "edges": [{"from": "inputs.raw", "to": "a.in"}, {"from": "a.out", "to": "m.frame"}, {"from": "inputs.raw", "to": "m.ref"}]})
    run = {"fusion.hdr_plus_derivative": lambda ref, frame, p: (ref, frame), "demosaic.quad_bayer_remosaic": lambda f, p: "remosaiced"}
    assert G.fold(G.load(text), "raw", run) == ("raw", "remosaiced")
    missing = json.loads(text)
    missing["edges"] = missing["edges"][:2]
    assert code(lambda: G.fold(G.load(json.dumps(missing)), "raw", run)) == "BAD_INDEX"


def test_migration():
    old = graph("linearize.dng_lut", version="0.3") | {"$schema": "https://example.org/pipeline/v0.3.json"}
    new = json.loads(G.migrate(json.dumps(old)))
    assert new["version"] == "0.4" and new["$schema"].endswith("v0.4.json") and new["nodes"] == old["nodes"]
    assert code(lambda: G.migrate(json.dumps(new))) == "FAILED"


def test_conversions_run():
    plan = G.load(Q.chain([*Q.MINIMUM[:-1], "builtin.passthrough"]))
    assert [c[2] for c in plan.converts] == ["rgba.u8"]
    assert code(lambda: G.load(Q.chain(["linearize.dng_lut", "builtin.passthrough"]))) == "BAD_PRECISION"


# Work and memory of the tasks.


def python_steps(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("MapInArrow"), plan.count("MapInPandas"), plan.count("Exchange ")


def test_kernels_of_a_graph_share_a_worker(spark):
    assert python_steps(Q.min_pipeline(spark, SF)) == (1, 0, 0)
    assert python_steps(Q.full_classic_sdr(spark, SF)) == (1, 0, 0)
    assert python_steps(Q.graph_conversion(spark, SF)) == (1, 0, 0)
    assert python_steps(Q.lens_opcodes(spark, SF)) == (1, 0, 0)


def test_kernels_get_a_bounded_number_of_pixels():
    n = 9000
    shape = {"height": 8, "width": 8, "y0": 0, "x0": 0, "h": 8, "w": 8, "meta": None}
    batch = S.tile_rows(np.arange(n), shape, np.arange(n * 64.0).reshape(1, n, 8, 8))
    parts = list(S.stacks(batch))
    assert max(p.size for _, _, p in parts) <= S.CELLS and (np.concatenate([i for i, _, _ in parts]) == np.arange(n)).all()
    assert (np.concatenate([p for _, _, p in parts], 1) == np.arange(n * 64.0).reshape(1, n, 8, 8)).all()


def test_tiles_are_warped_with_one_shuffle(spark):
    assert python_steps(Q.warp_rectilinear_tiled(spark, SF)) == (2, 0, 1)


def test_files_are_read_once_and_not_shuffled(spark):
    """Of a scan, one step writes the files and one cuts them; headers are kept in Python for a few files at a time."""
    assert python_steps(Q.dng_scan(spark, SF))[:2] == (2, 0)
    assert python_steps(Q.dng_min_pipeline(spark, SF))[:2] == (5, 0)
    batch = pa.record_batch([pa.array([str(k) for k in range(1000)]), pa.array([b"x"] * 1000)], names=["path", "content"])
    parts = list(dng._files([batch]))
    assert max(len(p[0]) for p in parts) <= 256 and sum((p[0] for p in parts), []) == [str(k) for k in range(1000)]


def test_tiles_of_images_of_several_sizes(spark):
    """Tiles of one batch that differ in size, place and what their images say."""
    rng, rows = np.random.default_rng(3), []
    sizes = {1: (8, 8), 2: (5, 11), 3: (8, 8), 4: (3, 3), 5: (9, 4)}
    whole = {k: rng.random((4, *s)) for k, s in sizes.items()}
    for k, (height, width) in sizes.items():
        for y in range(0, height, 4):
            for x in range(0, width, 4):
                part = whole[k][:, y : y + 4, x : x + 4]
                rows.append((k, height, width, y, x, *part.shape[1:], [p.ravel().tolist() for p in part], f"of {k % 2}"))
    tiles = spark.createDataFrame(rows, S.TILES).repartition(3)
    kernel, radius = S.edge_aware_usm(0.75, 1, 0.0)
    warp = S.Warp(Q.WARP)
    for made, want in (
        (S.stencil(tiles, kernel, radius, 4), lambda p: kernel(np.pad(p[:, None], ((0, 0), (0, 0), (1, 1), (1, 1)), "edge"), -1, -1, *p.shape[1:], None)[:, 0]),
        (S.warp_tiles(tiles, 4, Q.WARP), lambda p: warp.sampled(p[:, None], 0, 0, np.arange(p.shape[1]), np.arange(p.shape[2]), *p.shape[1:])[:, 0]),
    ):
        got = {k: np.zeros_like(p) for k, p in whole.items()}
        for r in made.collect():
            assert r.meta == f"of {r.image_id % 2}"
            got[r.image_id][:, r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.array(r.planes).reshape(-1, r.h, r.w)
        assert all(np.allclose(got[k], want(p), atol=1e-12) for k, p in whole.items())


def test_chroma_does_not_depend_on_the_order_of_rows(spark):
    """A block whose mean is right at the middle between two codes when its pixels are added in order."""
    own = [(1, 0, 0, 479, 466, 411), (1, 0, 1, 453, 452, 448), (1, 1, 0, 442, 446, 459), (1, 1, 1, 431, 441, 467)]
    rows = [(i, y, x, *[v * 64 for v in c]) for i, y, x, *c in own]
    for order in ((0, 1, 2, 3), (3, 2, 1, 0), (2, 3, 0, 1)):
        px = spark.createDataFrame([rows[k] for k in order], "image_id long, y int, x int, r int, g int, b int").coalesce(1)
        assert [tuple(r) for r in M.ycbcr420(px, True)[1].collect()] == [(1, 0, 0, 510, 512)]


def test_plans_of_many_graphs(spark):
    """Graphs of all sorts, in batches smaller than some of them: as one by one; and planned in one step only."""
    rng, nodes, edges, want = random.Random(4), [], [], {}
    for g in range(60):
        n = rng.choice((1, 2, 5, 40))
        own = [f"n{k:02d}" for k in range(n)]
        shuffled = rng.sample(own, n)
        links = sorted({(shuffled[i], shuffled[j]) for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(2 * n)) if i < j})
        nodes += [(g, k) for k in own]
        edges += [(g, a, b) for a, b in links]
        order = G.toposort(own, links)
        slots, _ = G._slots(order, links, dict.fromkeys(own, 1))
        for k, v in enumerate(order):
            want[g, v] = (k, max([order.index(b) for a, b in links if a == v], default=k) + 1, slots[v])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        made = G.plans(spark.createDataFrame(rng.sample(nodes, len(nodes)), "graph long, id string"), spark.createDataFrame(edges, "graph long, a string, b string"))
        assert {(r.graph, r.id): (r.place, r.stop, r.slot) for r in made.collect()} == want
        pairs = sorted(tuple(r) for r in G.interference(made).collect())
        broken = G.plans(spark.createDataFrame([(1, 1)], "graph long, id long"), spark.createDataFrame([(1, 1, 2)], "graph long, a long, b long"))
        with pytest.raises(Exception, match="BAD_INDEX"):
            broken.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    live = [(g, a, p, s) for (g, a), (p, s, _) in want.items()]
    assert pairs == sorted((g, a, b) for g, a, p, s in live for h, b, q, _ in live if g == h and p < q < s)
    assert python_steps(Q.plan_interference(spark, SF))[0] == 1
