"""Uncompressed DNG files: tags, opcode lists and samples, read into tiles and written."""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.pointwise import NodeError

# TIFF field types (struct code, bytes) and the tags that are read.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("B", 1), 10: ("ii", 8)}
TAGS = {
    "width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "make": 271, "model": 272, "strip_offsets": 273, "orientation": 274, "samples": 277, "strip_bytes": 279,
    "cfa_repeat": 33421, "cfa_pattern": 33422, "exif": 34665, "exposure": 33434, "aperture": 33437, "iso": 34855, "focal": 37386,
    "linearization": 50712, "black": 50714, "white": 50717, "color_matrix1": 50721, "color_matrix2": 50722, "neutral": 50728,
    "illuminant1": 50778, "illuminant2": 50779, "active_area": 50829, "forward_matrix1": 50964, "forward_matrix2": 50965,
    "opcode2": 51009, "opcode3": 51022,
}
_CFA_PHOTOMETRIC, _PLAIN = 32803, 1

SCHEMA = (
    "height int, width int, active_area array<int>, cfa_repeat array<int>, cfa_pattern array<int>, black array<double>, white double, linearization array<int>, "
    "neutral array<double>, color_matrix1 array<double>, color_matrix2 array<double>, forward_matrix1 array<double>, forward_matrix2 array<double>, illuminant1 int, illuminant2 int, "
    "exposure_ns long, iso int, aperture double, focal_mm double, orientation int, camera_id string, physical_camera_id string, opcode2 binary, opcode3 binary"
)
#: What tiles carry of an image, in ``meta``.
META = [c.split()[0] for c in SCHEMA.split(", ")][2:] + ["noise_profile"]


def tags(data: bytes) -> dict[str, list | bytes]:
    """The known fields of the first directory and of the EXIF directory. Little-endian files only."""
    if len(data) < 8 or data[:4] != b"II*\0":
        raise NodeError("FAILED", "not a little-endian TIFF")
    names, out = {v: k for k, v in TAGS.items()}, {}

    def directory(at: int) -> None:
        if at + 2 > len(data):
            raise NodeError("FAILED", "a directory reaches past the end")
        (count,) = struct.unpack_from("<H", data, at)
        if at + 2 + 12 * count > len(data):
            raise NodeError("FAILED", "a directory reaches past the end")
        for k in range(count):
            tag, kind, n = struct.unpack_from("<HHI", data, at + 2 + 12 * k)
            if tag not in names or kind not in _TYPES:
                continue
            code, size = _TYPES[kind]
            place = at + 10 + 12 * k
            if n * size > 4:
                (place,) = struct.unpack_from("<I", data, place)
            if place + n * size > len(data):
                raise NodeError("FAILED", f"tag {tag} reaches past the end")
            if kind in (2, 7):
                out[names[tag]] = data[place : place + n]
            else:
                flat = struct.unpack_from(f"<{n * len(code)}{code[0]}", data, place)
                out[names[tag]] = [a / b if b else 0.0 for a, b in zip(flat[::2], flat[1::2], strict=True)] if len(code) == 2 else list(flat)

    directory(struct.unpack_from("<I", data, 4)[0])
    if "exif" in out:
        directory(out["exif"][0])
    return out


def _opcodes(blob: bytes):
    """Number, flags and parameters of each opcode of a big-endian list; an empty blob is an empty list."""
    if not blob:
        return
    if len(blob) < 4:
        raise NodeError("FAILED", "opcode count cut off")
    at = 4
    for _ in range(struct.unpack_from(">I", blob)[0]):
        if at + 16 > len(blob):
            raise NodeError("FAILED", "opcode cut off")
        code, _, flags, size = struct.unpack_from(">IIII", blob, at)
        if at + 16 + size > len(blob):
            raise NodeError("FAILED", "opcode parameters cut off")
        yield code, flags, blob[at + 16 : at + 16 + size]
        at += 16 + size


def gain_maps(blob: bytes) -> list[dict]:
    """The gain maps (opcode 9) of an opcode list; all other opcodes are left out."""
    out = []
    for code, _, body in _opcodes(blob):
        if code != 9:
            continue
        if len(body) < 76:
            raise NodeError("FAILED", "gain map cut off")
        head = struct.unpack_from(">10I4dI", body)
        plane, planes, row_pitch, col_pitch, rows, columns = head[4:10]
        if len(body) < 76 + 4 * rows * columns:
            raise NodeError("FAILED", "gain map cut off")
        if planes not in (1, 4) or plane >= planes or head[14] != 1 or not (row_pitch and col_pitch) or not all(map(math.isfinite, head[10:14])) or min(head[10:12]) <= 0:
            raise NodeError("UNSUPPORTED", "gain map shape")
        out.append({"plane": plane, "planes": planes, "points": (rows, columns), "spacing": head[10:12], "origin": head[12:14], "gain": list(struct.unpack_from(f">{rows * columns}f", body, 76))})
    return out


def _lens_parameters(code: int, b: bytes) -> dict | None:
    """The parameters of a known opcode, or None if they are not exactly as long as they must be."""
    if code == 1 and len(b) >= 4:
        n = struct.unpack_from(">I", b)[0]
        if 0 < n <= 4 and len(b) == 4 + 48 * n + 16:
            v = struct.unpack(f">{6 * n + 2}d", b[4:])
            return {"coefficients": [v[6 * k : 6 * k + 6] for k in range(n)], "cx": v[-2], "cy": v[-1]}
    elif code == 3 and len(b) == 56:
        v = struct.unpack(">7d", b)
        return {"k": list(v[:5]), "cx": v[5], "cy": v[6]}
    elif code == 4 and len(b) == 8:
        return {"constant": struct.unpack(">II", b)[0]}
    elif code == 5 and len(b) >= 12:
        _, points, rects = struct.unpack_from(">III", b)
        if len(b) == 12 + 8 * points + 16 * rects:
            v = struct.unpack(f">{2 * points + 4 * rects}I", b[12:])
            return {"points": [v[2 * k : 2 * k + 2] for k in range(points)], "rects": [v[2 * points + 4 * k : 2 * points + 4 * k + 4] for k in range(rects)]}
    elif code == 6 and len(b) == 16:
        return dict(zip(("top", "left", "bottom", "right"), struct.unpack(">4I", b), strict=True))
    return None


def lens_opcodes(blob: bytes) -> list[dict]:
    """Opcodes 1, 3, 4, 5 and 6 of a list, in order; of others only optional ones, as they do nothing."""
    out = []
    for code, flags, body in _opcodes(blob):
        if code in (1, 3, 4, 5, 6):
            own = _lens_parameters(code, body)
            if own is None:
                raise NodeError("FAILED", f"opcode {code} has {len(body)} bytes")
        elif flags & 1:
            own = {}
        else:
            raise NodeError("UNSUPPORTED", f"opcode {code}")
        out.append({"id": code, "optional": bool(flags & 1), **own})
    return out


def header(data: bytes) -> dict:
    """The columns of ``SCHEMA`` of one file, and where its strips are."""
    t = tags(data)
    one = lambda k, d: t.get(k, [d])[0]
    if one("photometric", _CFA_PHOTOMETRIC) != _CFA_PHOTOMETRIC or one("samples", 1) != 1:
        raise NodeError("FAILED", "not one plane of a filter array")
    repeat, pattern = list(t.get("cfa_repeat", [])), list(t.get("cfa_pattern", b""))
    if repeat not in ([2, 2], [4, 4]) or len(pattern) != repeat[0] * repeat[1]:
        raise NodeError("FAILED", "not a 2x2 or 4x4 mosaic")
    height, width, bits = one("height", 0), one("width", 0), one("bits", 0)
    if not height or not width or not 0 < bits <= 16 or not sum(t.get("strip_bytes", [])):
        raise NodeError("FAILED", "a required field is missing")
    if one("compression", _PLAIN) != _PLAIN or bits != 16:
        raise NodeError("FAILED", "samples are not uncompressed 16-bit")
    top, left, bottom, right = t["active_area"] if len(t.get("active_area", [])) == 4 else (0, 0, height, width)
    real = lambda k: [float(v) for v in t.get(k, [])]
    text = lambda k: bytes(t.get(k, b"")).split(b"\0")[0].decode("ascii", "replace")
    return {
        "height": height, "width": width, "active_area": [left, top, right - left, bottom - top] if bottom >= top and right >= left else [0, 0, width, height],
        "cfa_repeat": repeat, "cfa_pattern": pattern, "black": (real("black") + [0.0] * 4)[:4], "white": float(one("white", 0)),
        "linearization": [int(v) for v in t.get("linearization", [])], "neutral": real("neutral")[:3], "color_matrix1": real("color_matrix1"), "color_matrix2": real("color_matrix2"),
        "forward_matrix1": real("forward_matrix1"), "forward_matrix2": real("forward_matrix2"), "illuminant1": one("illuminant1", 0), "illuminant2": one("illuminant2", 0),
        "exposure_ns": int(round(one("exposure", 0) * 1e9)), "iso": int(one("iso", 0)), "aperture": float(one("aperture", 0)), "focal_mm": float(one("focal", 0)), "orientation": one("orientation", 1),
        "camera_id": text("make"), "physical_camera_id": text("model"), "opcode2": bytes(t.get("opcode2", b"")), "opcode3": bytes(t.get("opcode3", b"")),
        "strips": list(zip(t["strip_offsets"], t["strip_bytes"], strict=False)),
    }


def samples(data: bytes, head: dict) -> np.ndarray:
    """The file's codes, row by row; what a strip lacks is 0."""
    size = 2 * head["height"] * head["width"]
    if any(a + n > len(data) for a, n in head["strips"]):
        raise NodeError("FAILED", "a strip reaches past the end")
    raw = b"".join(data[a : a + n] for a, n in head["strips"])[:size].ljust(size, b"\0")
    return np.frombuffer(raw, "<u2").reshape(head["height"], head["width"])


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<double>": pa.list_(pa.float64())}
_KINDS = {c.split()[0]: _ARROW[c.split()[1]] for c in SCHEMA.split(", ")}


def _files(batches, most: int = 256):
    """Paths and contents, ``most`` at a time: what a header takes in Python is some times its file's."""
    for batch in batches:
        for k in range(0, batch.num_rows, most):
            yield [c.to_pylist() for c in batch.slice(k, most).columns]


def headers(files: DataFrame) -> DataFrame:
    """``image_id, path`` and the columns of ``SCHEMA`` of ``files(path, content)``; the id is a hash of the path."""

    def run(batches):
        for paths, contents in _files(batches):
            rows = [header(c) for c in contents]
            yield pa.record_batch([pa.array(paths, pa.string()), *[pa.array([r[k] for r in rows], t) for k, t in _KINDS.items()]], names=["path", *_NAMES])

    out = files.select("path", "content").mapInArrow(run, f"path string, {SCHEMA}")
    return out.select(F.xxhash64("path").alias("image_id"), "*")


def tiles(files: DataFrame, size: int) -> DataFrame:
    """Tiles of the samples of ``files(path, content)`` with the columns of ``SCHEMA``, cut where a file is read, once."""
    places = {"y0": pa.int32(), "x0": pa.int32(), "h": pa.int32(), "w": pa.int32(), "planes": pa.list_(pa.list_(pa.float64()))}
    names = ["path", *_NAMES, *places]

    def cut(batches):
        for paths, contents in _files(batches):
            for path, data in zip(paths, contents, strict=True):
                head = header(data)
                codes = samples(data, head)
                for y in range(0, head["height"], size):
                    for x in range(0, head["width"], size):
                        part = codes[y : y + size, x : x + size]
                        yield path, head, (y, x, *part.shape), part.astype(float).ravel()

    def batch_of(rows: list) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(r[3]) for r in rows]]), pa.int32()), pa.array(np.concatenate([r[3] for r in rows])))
        planes = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1), pa.int32()), lists)
        heads = [pa.array([r[1][k] for r in rows], t) for k, t in _KINDS.items()]
        return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), *heads, *[pa.array([r[2][k] for r in rows], pa.int32()) for k in range(4)], planes], names=names)

    def run(batches):
        waiting, held = [], 0
        for row in cut(batches):
            waiting.append(row)
            held += len(row[3])
            if len(waiting) >= 256 or held >= 1 << 18:
                yield batch_of(waiting)
                waiting, held = [], 0
        if waiting:
            yield batch_of(waiting)

    out = files.select("path", "content").mapInArrow(run, f"path string, {SCHEMA}, y0 int, x0 int, h int, w int, planes array<array<double>>")
    return out.select(F.xxhash64("path").alias("image_id"), *out.columns[1:])


def read_dng(spark: SparkSession, path: str) -> DataFrame:
    """``path, content`` of the files at ``path``, wherever Spark can read."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def encode(codes: np.ndarray, **fields) -> bytes:
    """A file with one strip. ``fields`` are tags by name: numbers, lists, bytes, or floats for rationals."""
    height, width = codes.shape
    fields = {"width": width, "height": height, "bits": 16, "compression": _PLAIN, "photometric": _CFA_PHOTOMETRIC, "samples": 1, "cfa_repeat": [2, 2], "cfa_pattern": bytes([0, 1, 1, 2])} | fields
    strip = codes.astype("<u2").tobytes()
    short = {"bits", "compression", "photometric", "orientation", "samples", "cfa_repeat", "linearization", "illuminant1", "illuminant2", "iso"}
    rows = []
    for name, v in sorted({**fields, "strip_offsets": 0, "strip_bytes": len(strip)}.items(), key=lambda f: TAGS[f[0]]):
        if isinstance(v, str):
            v = v.encode() + b"\0"
        if isinstance(v, bytes):
            rows.append((name, 2 if name in ("make", "model") else 1 if name == "cfa_pattern" else 7, len(v), v))
            continue
        many = [v] if isinstance(v, (int, float)) else list(v)
        if any(isinstance(x, float) for x in many):
            rows.append((name, 10, len(many), b"".join(struct.pack("<ii", *_ratio(x)) for x in many)))
        else:
            rows.append((name, 3 if name in short else 4, len(many), struct.pack(f"<{len(many)}{'H' if name in short else 'I'}", *many)))
    at = 8 + 2 + 12 * len(rows) + 4
    places, extra = [], b""
    for _, _, _, body in rows:
        places.append(at + len(extra) if len(body) > 4 else None)
        extra += body + b"\0" * (len(body) % 2) if len(body) > 4 else b""
    out = struct.pack("<2sHIH", b"II", 42, 8, len(rows))
    for (name, kind, n, body), place in zip(rows, places, strict=True):
        value = struct.pack("<I", at + len(extra)) if name == "strip_offsets" else body.ljust(4, b"\0") if place is None else struct.pack("<I", place)
        out += struct.pack("<HHI", TAGS[name], kind, n) + value
    return out + b"\0\0\0\0" + extra + strip


def _ratio(x: float) -> tuple[int, int]:
    """Numerator and denominator of 31 bits that come close to a number."""
    below = 1 << max(0, 30 - max(0, math.frexp(x)[1]))
    return round(x * below), below


def opcode_list(*opcodes: tuple[int, int, bytes]) -> bytes:
    """A big-endian list of (number, flags, parameters)."""
    return struct.pack(">I", len(opcodes)) + b"".join(struct.pack(">IIII", code, 0x01030000, flags, len(body)) + body for code, flags, body in opcodes)
