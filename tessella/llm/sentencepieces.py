"""Encoding and decoding with a public piece vocabulary, by suffix-array matching of batch text."""

from __future__ import annotations

import heapq
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.chunks import ChunkCache
from tessella.llm.wordhash import slices

_SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
#: Chunks longer than this are relaxed one edge at a time from a heap instead of all chunks in step.
LONG = 64
#: Characters of one suffix array, so that its tables (some 200 bytes a character) stay bounded; a longer chunk has one alone.
BUFFER = 1 << 18


def _pad(strings: list[str], width: int, fill: int = 0) -> np.ndarray:
    out = np.full((len(strings), width), fill, np.uint32)
    for k, s in enumerate(strings):
        own = np.frombuffer(s.encode("utf-32-le"), np.uint32)
        out[k, : len(own)] = own
    return np.ascontiguousarray(out).view(f"<U{width}").ravel()


class Pieces:
    """The vocabulary of a model file, and encoding of chunks with it."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(k) for k in range(model.get_piece_size())]
        special = [model.is_control(k) or model.is_unknown(k) or model.is_unused(k) for k in range(len(names))]
        self.byte = np.zeros(256, np.uint32)
        self.out = [b"" if special[k] else x.replace(_SPACE, " ").encode() for k, x in enumerate(names)]
        for k, x in enumerate(names):
            if model.is_byte(k):
                self.byte[int(_BYTE.fullmatch(x)[1], 16)] = k
                self.out[k] = bytes([int(_BYTE.fullmatch(x)[1], 16)])
        ids = [k for k in range(len(names)) if not special[k] and not model.is_byte(k)]
        self.width = max(len(names[k]) for k in ids)
        self.ids = np.array(ids)
        self.length = np.array([len(names[k]) for k in ids])
        # Pieces of equal score have equal rank; the leftmost goes first then.
        score = np.array([model.get_score(k) for k in range(len(names))])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        text = [names[k] for k in ids]
        self.low, self.high = _pad(text, self.width), _pad(text, self.width, 0x10FFFF)

    def edges(self, buffer: np.ndarray) -> np.ndarray:
        """For each position and length the piece that stands there, or -1.

        The suffixes (up to the longest piece) are sorted once; two binary searches give the range of
        each piece's occurrences.
        """
        padded = np.concatenate((buffer, np.zeros(self.width, np.uint32)))
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, self.width)[: len(buffer)]).view(f"<U{self.width}").ravel()
        order = _suffix_order(buffer, self.width)
        windows = windows[order]
        first, last = np.searchsorted(windows, self.low), np.searchsorted(windows, self.high, "right")
        count = last - first
        piece = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        out = np.full((len(buffer), self.width + 1), -1, np.int32)
        out[at, self.length[piece]] = self.ids[piece]  # sorted by position and length
        return out

    def encode(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; the chunks' text is indexed in buffers of some ``BUFFER`` characters."""
        out, group, size = [], [], 0
        for c in chunks:
            if group and size + len(c) > BUFFER:
                out += self._encode(group)
                group, size = [], 0
            group.append(c)
            size += len(c) + 1
        return out + self._encode(group) if group else out

    def _encode(self, chunks: list[str]) -> list[bytes]:
        text = [c.replace(" ", _SPACE) for c in chunks]
        size = np.array([len(t) for t in text])
        buffer = np.frombuffer("\0".join([*text, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = self.edges(buffer)
        base = np.cumsum(size + 1) - size - 1
        long = size > LONG
        start = np.flatnonzero(buffer != 0) if not (size == 0).any() and not any("\0" in t for t in text) else np.concatenate([np.arange(b, b + n) for b, n in zip(base, size, strict=True)])
        owner = np.repeat(np.arange(len(text)), size)
        start, owner, length = self._in_step(edges, start[~long[owner]], owner[~long[owner]])
        pieces = [(start, length, owner)]
        for k in np.flatnonzero(long):
            s, n = self._one(edges, int(base[k]), int(size[k]))
            pieces.append((s, n, np.full(len(s), k)))
        start, length, owner = (np.concatenate(x) for x in zip(*pieces, strict=True))
        order = np.argsort(start, kind="stable")
        start, length, owner = start[order], length[order], owner[order]
        ids = edges[start, length].astype(np.int64)
        if (ids < 0).any():  # characters without a piece become their bytes
            out_ids, out_owner = [], []
            bad = np.flatnonzero(ids < 0)
            spelled = [self.byte[np.frombuffer(chr(buffer[start[k]]).encode("utf-8", "surrogatepass"), np.uint8)] for k in bad]
            times = np.ones(len(ids), np.int64)
            times[bad] = [len(x) for x in spelled]
            ids, owner = np.repeat(ids, times), np.repeat(owner, times)
            ids[ids < 0] = np.concatenate(spelled)
        ends = np.cumsum(np.bincount(owner, minlength=len(text)))
        data, ends = ids.astype("<u4").tobytes(), np.concatenate(([0], ends)) * 4
        return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def _in_step(self, edges: np.ndarray, start: np.ndarray, owner: np.ndarray):
        """Relaxes the best edge of each chunk, all chunks in step, until none has an edge left.

        An edge joins two neighbouring symbols whose text is a piece; the best has the highest score,
        the leftmost of equals.
        """
        length = np.ones(len(start), np.int64)
        done: list[tuple] = []
        while len(start):
            both = length[:-1] + length[1:]
            ok = (owner[1:] == owner[:-1]) & (both <= self.width)
            found = np.where(ok, edges[start[:-1], np.minimum(both, self.width)], -1)
            key = np.where(found >= 0, self.rank[found], 1 << 40)
            heads = np.flatnonzero(np.diff(owner, prepend=-1))
            key = np.append(key, 1 << 40)
            best = np.minimum.reduceat(key, heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(owner))))
            hit = np.flatnonzero(key == best[group])
            hit = hit[np.unique(group[hit], return_index=True)[1]]  # the leftmost of each chunk
            open_ = best < 1 << 40
            still = open_[group]
            if not still.all():
                done.append((start[~still], owner[~still], length[~still]))
            hit = hit[open_[group[hit]]]
            length[hit] += length[hit + 1]
            keep = still
            keep[hit + 1] = False
            start, owner, length = start[keep], owner[keep], length[keep]
        if not done:
            return start, owner, length
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))

    def _one(self, edges: np.ndarray, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long chunk, with a heap of edges: near linear in its length."""
        length, before, after = [1] * size, list(range(-1, size - 1)), [*range(1, size), -1]
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int) -> None:
            b = after[a]
            if b >= 0 and length[a] + length[b] <= self.width and (p := edges[base + a, length[a] + length[b]]) >= 0:
                heapq.heappush(heap, (int(self.rank[p]), a, length[a], length[b]))

        for a in range(size):
            push(a)
        while heap:
            _, a, n, m = heapq.heappop(heap)
            b = after[a] if length[a] == n else -1
            if b < 0 or length[b] != m:
                continue
            length[a], length[b] = n + m, 0
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            push(a)
            if before[a] >= 0:
                push(before[a])
        left = [k for k in range(size) if length[k]]
        return base + np.array(left), np.array([length[k] for k in left])

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces and bytes joined, without the space that encoding puts first."""
        text = b"".join([self.out[k] for k in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _suffix_order(buffer: np.ndarray, width: int) -> np.ndarray:
    """Positions in the order of their suffixes' first ``width`` characters, by doubling."""
    rank = np.unique(buffer, return_inverse=True)[1].astype(np.int64) + 1
    step = 1
    while True:
        key = (rank << 32) | np.append(rank[step:], np.zeros(min(step, len(rank)), np.int64))
        order = np.argsort(key)
        step *= 2
        if step >= width:
            return order
        new = np.append(0, np.cumsum(np.diff(key[order]) != 0)) + 1
        rank = np.empty_like(rank)
        rank[order] = new


def _split(text: str) -> list[str]:
    """Chunks of the text with the space put before it: runs of spaces stay with the word after them."""
    if not text:
        return []
    parts = text.split(" ")
    if all(parts):
        return parts
    return [x[1:] for x in re.findall(r" +[^ ]+| +", f" {text}")]


@lru_cache(2)
def _cache(path: str) -> tuple[Pieces, ChunkCache]:
    pieces = Pieces(path)
    return pieces, ChunkCache(lambda new: pieces.encode([f" {c}" for c in new]), _split)


def encode_texts(texts: list[str], path: str, cached: bool = True) -> list[np.ndarray]:
    """Ids of each text, as the vocabulary's own library gives them.

    No piece reaches over a space before a word, so a batch is cut there, and each distinct chunk is indexed and
    relaxed once: with ``cached``, only those that no batch of this worker had before; else all of the batch's.
    """
    pieces, cache = _cache(path)
    return (cache if cached else ChunkCache(cache.encode, _split))(texts)


def decode_ids(ids: np.ndarray, path: str) -> str:
    return _cache(path)[0].decode(ids)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, ids`` (array of int). Null and empty texts have no ids.

    Repeated and null ids are encoded like any other; an empty table gives no rows; other columns are
    not read.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                ids = encode_texts([x or "" for x in batch.column(1).to_pylist()], vocabulary)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int32)
                yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``doc_id, text`` of ``encoded(doc_id, ids)``; null ids give a null text."""

    def run(batches):
        for batch in batches:
            text = [None if x is None else decode_ids(np.array(x, np.int64), vocabulary) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_ids, ids_crc32, round_trip``; the last says that decoding gives the text back.

    Nulls, empty texts and repeated ids as in ``encode_documents``; a null text counts as empty.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                texts = [x or "" for x in batch.column(1).to_pylist()]
                ids = encode_texts(texts, vocabulary)
                same = [decode_ids(x, vocabulary) == t for x, t in zip(ids, texts, strict=True)]
                yield pa.record_batch([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), pa.array(same)], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean")
