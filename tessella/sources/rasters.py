"""Rasters from tables and files, and LUT and raw readers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.pointwise import NodeError

SIDE, TOP = 8, 16383


def embedding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``image_id, codes``: each vector of 64 values as the row-major codes of an 8x8 mosaic."""
    code = F.transform("embedding", lambda v: F.floor((v.cast("double") + 0.6) * (TOP / 1.2)).cast("double"))
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("image_id"), code.alias("codes"))


def mosaic_of(codes: DataFrame, side: int = SIDE) -> DataFrame:
    """``image_id, y, x, v``."""
    out = codes.select("image_id", F.posexplode("codes").alias("i", "v"))
    return out.select("image_id", F.floor(F.col("i") / side).cast("int").alias("y"), (F.col("i") % side).cast("int").alias("x"), "v")


def raw_images(spark: SparkSession, path: str, height: int, width: int) -> DataFrame:
    """``path, codes`` of files that hold nothing but little-endian 16-bit samples; any other size is an error."""
    size = 2 * height * width

    def run(parts):
        for pdf in parts:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                if len(data) != size:
                    raise NodeError("FAILED", f"{name}: {len(data)} bytes, not {size}")
            yield pdf[["path"]].assign(codes=[np.frombuffer(d, "<u2").astype(float) for d in pdf["content"]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, codes array<double>")


def _numbers(parts: list[str], kind: type = float) -> list:
    try:
        return [kind(v) for v in parts]
    except ValueError:
        raise NodeError("FAILED", f"not numbers: {' '.join(parts)[:60]}") from None


def _cube(lines: list[str]) -> tuple[int, list[list[float]]]:
    size, rows = 0, []
    for line in lines:
        head, *rest = line.split()
        if head in ("TITLE", "DOMAIN_MIN", "DOMAIN_MAX"):
            continue
        if head == "LUT_3D_SIZE":
            size = _numbers(rest[:1] or [""], int)[0]
        else:
            rows.append(_numbers([head, *rest][:3]))
    return size, rows


def _spi3d(lines: list[str]) -> tuple[int, list[list[float]]]:
    words = " ".join(lines).split()
    if words[:1] != ["SPILUT"] or len(words) < 7 or words[2:4] != ["3", "3"] or len(set(words[4:7])) != 1:
        raise NodeError("FAILED", "spi3d header")
    size, own = _numbers(words[4:5], int)[0], words[7:]
    table = {tuple(_numbers(own[k : k + 3], int)): _numbers(own[k + 3 : k + 6]) for k in range(0, len(own) - 5, 6)}
    if any(not 0 <= v < size for key in table for v in key):
        raise NodeError("FAILED", "spi3d index")
    return size, [table.get((r, g, b), []) for r in range(size) for g in range(size) for b in range(size)] if size <= 256 else []


def parse_lut(text: str, kind: str) -> tuple[int, list[float]]:
    """Size and values (red slowest, blue fastest) of a ``cube`` or ``spi3d`` table. Domain lines are ignored; other rows must be three numbers."""
    lines = [x for x in (re.sub(r"#.*", "", line).strip() for line in text.splitlines()) if x]
    if kind not in ("cube", "spi3d"):
        raise NodeError("UNSUPPORTED", kind)
    size, rows = (_cube if kind == "cube" else _spi3d)(lines)
    if not 2 <= size <= 256 or len(rows) != size**3 or any(len(r) != 3 for r in rows):
        raise NodeError("FAILED", "LUT size or rows")
    return size, [v for r in rows for v in r]


def parse_look(text: str) -> tuple[float, float, list[float]]:
    """Where a ``spi1d`` curve starts and ends, and its values (the first component of each row)."""
    head, _, body = text.partition("{")
    said = dict(x.split(None, 1) for x in head.splitlines() if len(x.split()) > 1)
    rows = [_numbers(x.split()) for x in body.partition("}")[0].splitlines() if x.strip()]
    low, high = _numbers(said.get("From", "").split() or [""])[:2] if len(said.get("From", "").split()) == 2 else (None, None)
    if low is None or high <= low or len(rows) < 2 or str(len(rows)) != said.get("Length", "").strip():
        raise NodeError("FAILED", "spi1d rows")
    return low, high, [r[0] for r in rows]


def look(v: Column, low: float, high: float, values: list[float]) -> Column:
    """A value through a curve of evenly spaced points, held at its ends."""
    at = F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * (len(values) - 1)
    below = F.least(F.floor(at), F.lit(len(values) - 2)).cast("int")
    points = F.array(*[F.lit(float(x)) for x in values])
    return F.get(points, below) + (F.get(points, below + 1) - F.get(points, below)) * (at - below)


def write_cube(spark: SparkSession, path: str, size: int, grid) -> None:
    """A ``.cube`` table in closed form: ``grid(r, g, b)`` gives the columns of a row from its grid indices."""
    k = F.col("id")
    rgb = grid((k / (size * size)).cast("long").cast("double"), ((k / size).cast("long") % size).cast("double"), (k % size).cast("double"))
    rows = spark.range(0, size**3, 1, 1).select(k, F.concat_ws(" ", *[c.cast("string") for c in rgb]).alias("value"))
    head = spark.range(-1, 0, 1, 1).select("id", F.lit(f"LUT_3D_SIZE {size}").alias("value"))
    head.union(rows).coalesce(1).sortWithinPartitions("id").select("value").write.mode("overwrite").text(path)


def read_lut(spark: SparkSession, path: str) -> tuple[int, list[float]]:
    """A table file of at most 256**3 rows; its name ends in .cube or .spi3d."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return parse_lut(text, path.lower().rpartition(".")[2])
