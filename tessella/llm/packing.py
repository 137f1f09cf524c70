"""Vector best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.chunks import ChunkCache, chunk_of, keys
from tessella.llm.common import staged
from tessella.llm.wordhash import slices

#: What one task packs at most: sequences' worth of ids, and pieces.
SEQUENCES, PIECES = 2000, 100_000


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most: ids, pieces of documents, and attention cost (sum of squared lengths)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    by: str = "norm"

    def __post_init__(self) -> None:
        if self.by not in ("norm", "dot") or min(self.tokens, self.documents, self.attention) < 1:
            raise ValueError(f"not a capacity: {self}")

    @property
    def piece(self) -> int:
        """Longest piece: one that fits into an empty sequence under every constraint."""
        return min(self.tokens, int(self.attention**0.5))


@lru_cache(2)
def _cache(path: str) -> ChunkCache:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    # In the byte alphabet of this kind of vocabulary a space is written as U+0120.
    spaced = np.zeros(tokenizer.get_vocab_size(), bool)
    spaced[[i for t, i in tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True

    def encode(new: list[str]) -> list[bytes]:
        """Ids of many keys from few calls: chunks with one space, at their start, are joined."""
        plain = [k for k, c in enumerate(new) if " " not in c]
        out: list[bytes | None] = [None] * len(new)
        groups = [plain[k : k + 200] for k in range(0, len(plain), 200)]
        for group, e in zip(groups, tokenizer.encode_batch_fast([" " + " ".join([new[k] for k in g]) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            starts = np.flatnonzero(spaced[ids])
            if len(starts) == len(group) and starts[0] == 0:
                data, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
                for k, x, y in zip(group, ends[:-1], ends[1:], strict=True):
                    out[k] = data[x:y]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, e in zip(rest, tokenizer.encode_batch_fast([chunk_of(new[k]) for k in rest], add_special_tokens=False), strict=True):
            out[k] = np.array(e.ids, "<u4").tobytes()
        return out

    return ChunkCache(encode, keys)


def _tokenized(path: str, piece: int):
    def run(batches):
        """A row per piece. The ids of a document end with id 0; if it is too long, its first piece is the short one."""
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for whole in batches:
            for batch in slices(whole):
                rows = []
                ids = _cache(path)([x or "" for x in batch.column(1).to_pylist()])
                for doc, own in zip(batch.column(0).to_pylist(), ids, strict=True):
                    data = own.tobytes() + b"\0\0\0\0"
                    n = len(data) // 4
                    first = n % piece or piece
                    cuts = [0, *range(first, n + 1, piece)] if n > piece else [0, n]
                    rows += [(doc, k, a, b - a, zlib.crc32(data[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=names)

    return run


def pieces(docs: DataFrame, tokenizer: str, piece: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of ``docs(doc_id, text)``."""
    return docs.mapInArrow(_tokenized(tokenizer, piece), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. Longest first; each goes to the open bin that it fills best.

    ``norm``: least weighted norm of what is left in all capacities afterwards; ``dot``: least weighted
    dot product of the item with what is left before. A bin must have room in every capacity.
    """
    full = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights) / sum(cap.weights)
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    smallest = lengths.min() if len(lengths) else 0
    left = np.zeros((64, 3))
    names = np.zeros(64, np.int64)
    used, made = 0, 0
    for at in order:
        n = int(lengths[at])
        need = np.array([n, 1, n * n], float)
        room = left[:used]
        k = -1
        fits = (room >= need).all(1)
        if fits.any():
            if cap.by == "norm":
                score = ((((room - need) / full) ** 2) * weights).sum(1)
            else:
                score = ((room / full) * (need / full) * weights).sum(1)
            k = int(np.where(fits, score, np.inf).argmin())
        if k < 0:
            if used == len(left):
                left, names = np.concatenate((left, np.zeros_like(left))), np.concatenate((names, np.zeros_like(names)))
            k, used = used, used + 1
            left[k], names[k] = full, made
            made += 1
        bins[at], offsets[at] = names[k], cap.tokens - int(left[k, 0])
        left[k] -= need
        if left[k, 0] < smallest or left[k, 1] < 1 or left[k, 2] < smallest * smallest:  # nothing more can go in
            used -= 1
            left[k], names[k] = left[used], names[used]
    return bins, offsets


def pack(items: DataFrame, cap: Capacity) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``. Items are dealt evenly at random over enough tasks."""
    total, rows = items.agg(F.sum("length"), F.count(F.lit(1))).first()
    groups = max(1, -(-(total or 0) // (SEQUENCES * cap.tokens)), -(-rows // PIECES))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable", na_position="first")
        bins, offsets = best_fit(pdf["length"].to_numpy(), cap)
        group = int(pdf["group"].iloc[0])
        return pdf.drop(columns="group").assign(sequence_id=(group << 32) + bins, offset=offsets)

    dealt = items.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("group").applyInPandas(run, ", ".join([*columns, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, tokenizer: str, cap: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is the ids of its whole text followed by id 0, so a null or empty text is one id. Only
    documents longer than a piece can be are cut; their first piece is the shorter one. Pieces are
    packed by ``best_fit`` inside groups of some 2000 sequences, so that no task sees everything. A
    null id is a document like any other, as is a repeated one; an empty table gives no rows; other
    columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pack(staged(pieces(docs, tokenizer, cap.piece), "pieces"), cap)
