"""Near-duplicate vectors by randomised-rotation binary codes."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tessella.llm.common import components, spanning, staged, unstage

#: Half width of the confidence interval of an estimate in standard errors: both tails are under 1e-8.
SIGMAS = 6.0
#: Chance that two vectors right at the threshold share no bucket.
MISS = 1e-6
#: Buckets up to this size are joined with themselves in SQL; larger ones are compared in blocks.
SMALL, BLOCK = 16, 512


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors: buckets stay small, misses under ``MISS``."""
    bits = max(16, math.ceil(math.log2(max(2, rows))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log(1 - same))


@lru_cache(8)
def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices side by side: ``dim`` rows, ``count * dim`` columns."""
    rng = np.random.default_rng(977 + dim)
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.where(np.diag(r) < 0, -1.0, 1.0))
    return np.concatenate(out, 1)


def encode(unit: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Sign bits of the rotated vectors, and for each rotation the code's inner product with its vector."""
    x = unit @ rotations(unit.shape[1], count)
    dim = unit.shape[1]
    return x >= 0, np.abs(x).reshape(len(x), count, dim).sum(2) / math.sqrt(dim)


def bounds(bits: np.ndarray, factor: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased estimate of the inner products of coded vectors with ``other`` unit vectors, and its half width.

    ``bits`` has a row for each coded vector; a matrix with a column for each of ``other`` comes back.
    """
    count, dim = factor.shape[1], other.shape[1]
    scaled = np.where(bits, 1.0, -1.0).reshape(len(bits), count, dim) / (math.sqrt(dim) * factor[:, :, None] * count)
    return scaled.reshape(len(bits), -1) @ (other @ rotations(dim, count)).T, _width(factor, dim)[:, None]


def _width(factor: np.ndarray, dim: int) -> np.ndarray:
    spread = np.maximum(0, 1 - factor**2) / factor**2 / max(1, dim - 1)
    return SIGMAS * np.sqrt(spread.sum(1)) / factor.shape[1] + 1e-9


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (a, b))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _clean(batches):
    """Bytes of the usable vectors, as doubles; null for those that link with nothing."""
    for batch in batches:
        size = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False) + 0.0  # nulls are not a number here, and -0.0 is 0.0
        ends = np.cumsum(size)
        counts = [np.append(0, np.cumsum(x))[[ends, ends - size]] for x in (~np.isfinite(flat), flat != 0)]
        (bad, some), data = ((x[0] - x[1] for x in counts), flat.tobytes())
        good = (bad == 0) & (some > 0)
        rows = [data[8 * (b - n) : 8 * b] if ok else None for b, n, ok in zip(ends.tolist(), size.tolist(), good.tolist(), strict=True)]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["vec_id", "label", "raw"])


def _rows(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def _coded(bits: int, bands: int):
    weights = (1 << np.arange(bits)).astype(np.int64)

    def run(pieces):
        for pdf in pieces:
            for size, part in pdf.groupby(pdf["raw"].str.len()):
                count = -(-bits * bands // (size // 8))
                code, factor = encode(_unit(_rows(part["raw"])), count)
                keys = code[:, : bits * bands].reshape(len(part), bands, bits) @ weights
                yield part.assign(code=[x.tobytes() for x in np.packbits(code, 1)], factor=[x.tobytes() for x in factor], keys=list(keys))

    return run, "key long, rep long, label string, copies long, raw binary, code binary, factor binary, keys array<long>"


def _bits(code, columns: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1), axis=1, count=columns).astype(bool)


def _keys(bits: np.ndarray, width: int, bands: int) -> np.ndarray:
    return bits[:, : width * bands].reshape(len(bits), bands, width) @ (1 << np.arange(width)).astype(np.int64)


def _linked(threshold: float):
    @F.pandas_udf(BooleanType())
    def run(raw_a: pd.Series, code_a: pd.Series, factor_a: pd.Series, raw_b: pd.Series) -> pd.Series:
        out = np.zeros(len(raw_a), bool)
        sizes = raw_a.str.len().to_numpy()
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            a, b, factor, dim = _rows(raw_a.iloc[at]), _rows(raw_b.iloc[at]), _rows(factor_a.iloc[at]), size // 8
            x = (_unit(b) @ rotations(dim, factor.shape[1])).reshape(len(at), -1, dim)
            sign = np.where(_bits(code_a.iloc[at], dim * factor.shape[1]), 1.0, -1.0).reshape(x.shape)
            estimate = ((x * sign).sum(2) / (math.sqrt(dim) * factor)).mean(1)
            unsure = np.flatnonzero(estimate + _width(factor, dim) >= threshold)
            out[at[unsure]] = _cosines(a[unsure], b[unsure]) >= threshold
        return pd.Series(out)

    return run


def _blocks(threshold: float, width: int, bands: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between two blocks of a bucket: each vector's count, and edges that span what is linked.

        A pair that shares several large buckets counts in the first of them only.
        """
        out = []
        band = int(pdf["band"].iloc[0])
        for (_, size), part in pdf.groupby(["label", pdf["raw"].str.len()]):
            part = part.sort_values("key", kind="stable").reset_index(drop=True)
            dim, raw = size // 8, _rows(part["raw"])
            factor = _rows(part["factor"])
            bits = _bits(part["code"], dim * factor.shape[1])
            left = np.flatnonzero(part["block"] == part["i"])
            right = np.flatnonzero(part["block"] == part["j"])
            estimate, half = bounds(bits[left], factor[left], _unit(raw[right]))
            x, y = np.nonzero(estimate + half >= threshold)
            x, y = left[x], right[y]
            keep = (x < y) if int(part["i"].iloc[0]) == int(part["j"].iloc[0]) else (x != y)
            x, y = x[keep], y[keep]
            keys = _keys(bits, width, bands)
            large = np.zeros((len(part), bands), bool)
            for k, own in enumerate(part["large"]):
                large[k, np.asarray(own)] = True
            at = np.zeros(len(x), bool)
            for s in range(0, len(x), 65536):
                p, q = x[s : s + 65536], y[s : s + 65536]
                at[s : s + 65536] = ((keys[p] == keys[q]) & large[p]).argmax(1) == band
            x, y = x[at], y[at]
            sure = np.zeros(len(x), bool)
            for s in range(0, len(x), 65536):
                sure[s : s + 65536] = _cosines(raw[x[s : s + 65536]], raw[y[s : s + 65536]]) >= threshold
            x, y = x[sure], y[sure]
            if not len(x):
                continue
            copies, keys = part["copies"].to_numpy(), part["key"].to_numpy()
            links = np.bincount(x, copies[y], len(part)) + np.bincount(y, copies[x], len(part))
            comp = spanning(x, y, len(part))
            some = np.flatnonzero(links)
            out.append(pd.DataFrame({"key": keys[some], "links": links[some].astype(np.int64), "other": keys[comp[some]]}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "links": [], "other": []}).astype("int64")

    return run


def embedding_dedup(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Two vectors of the same non-null label link when their cosine, in doubles, is at least
    ``threshold``. Candidates share a band of sign bits of their rotated vectors (a pair at the
    threshold is missed with a chance of at most ``MISS``); the code's estimate and its upper bound
    tell which candidates can link, and those are computed exactly. Equal vectors are compared once
    and counted as often as they occur. Vectors that are null, empty, zero or hold null or non-finite
    components, and rows without label or id, link with nothing and are their own component, as do
    vectors of different lengths. An empty table gives no rows; other columns are not read. Rows that
    repeat an id are vectors of their own, with their own links; a component is named by the smallest id in it.
    """
    raw = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    raw = staged(raw.mapInArrow(_clean, "vec_id long, label string, raw binary"), "vectors")
    good = raw.where("raw is not null and label is not null and vec_id is not null")
    reps = good.groupBy("label", "raw").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Each distinct vector has a number of its own: an id may occur with several labels or vectors.
    reps = staged(reps.select(F.monotonically_increasing_id().alias("key"), "rep", "label", "copies", "raw"), "distinct")
    width, bands = plan(reps.count(), threshold)
    run, schema = _coded(width, bands)
    codes = coded = staged(reps.mapInPandas(run, schema), "codes")

    rows = coded.select("key", F.xxhash64("label", F.length("raw")).alias("g"), F.posexplode("keys").alias("band", "value"))
    rows = rows.select("key", F.xxhash64("g", "band", "value").alias("bucket"), "band")
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rows = staged(rows.join(sizes, "bucket"), "buckets")
    large = rows.where(F.col("c") > SMALL)
    masks = large.groupBy("key").agg(F.array_sort(F.collect_set("band")).alias("large"))
    coded = staged(coded.join(masks, "key", "left").withColumn("large", F.coalesce("large", F.array().cast("array<int>"))), "coded")

    small = rows.where(F.col("c") <= SMALL)
    pairs = small.select("bucket", F.col("key").alias("x")).join(small.select("bucket", F.col("key").alias("y")), "bucket")
    pairs = pairs.where("x < y").select("x", "y").distinct()
    for x in "xy":
        side = coded.select(F.col("key").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("label", "copies", "raw", "code", "factor", "keys", "large")])
        pairs = pairs.join(side, x)
    both = F.exists(F.col("large_x"), lambda k: F.get("keys_x", k) == F.get("keys_y", k))
    pairs = pairs.where((F.col("label_x") == F.col("label_y")) & (F.length("raw_x") == F.length("raw_y")) & ~both)
    pairs = pairs.where(_linked(threshold)("raw_x", "code_x", "factor_x", "raw_y"))
    found = staged(pairs.select("x", "y", "copies_x", "copies_y"), "pairs")
    ones = found.select(F.col("x").alias("key"), F.col("copies_y").alias("links"), F.col("y").alias("other"))
    ones = ones.union(found.select("y", "copies_x", "x"))

    count = F.ceil(F.col("c") / BLOCK).cast("int")
    parts = large.withColumn("block", F.pmod(F.xxhash64("key", F.lit(5)), count).cast("int"))
    parts = parts.withColumn("with", F.explode(F.sequence(F.lit(0), count - 1)))
    parts = parts.select("bucket", "band", "block", "key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    parts = parts.join(coded.select("key", "label", "copies", "raw", "code", "factor", "large"), "key")
    many = parts.groupBy("bucket", "i", "j").applyInPandas(_blocks(threshold, width, bands), "key long, links long, other long")

    links = staged(ones.union(many), "links")
    unstage(codes, coded, rows, found)
    label = components(links.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "key")
    total = links.groupBy("key").agg(F.sum("links").alias("links"))
    named = label.join(reps.select("key", "rep"), "key").groupBy("component_id").agg(F.min("rep").alias("component"))
    groups = reps.join(total, "key", "left").join(label, "key", "left").join(named, "component_id", "left")
    groups = groups.select("label", "raw", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component"))
    out = good.join(groups, ["label", "raw"]).select("vec_id", "links", "component")
    alone = raw.where("raw is null or label is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("component"))
    out = out.union(alone)
    return out.select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("vec_id").eqNullSafe(F.col("component")).alias("kept"))
