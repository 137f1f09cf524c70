"""Repeated passages: runs of consecutive sentences, and stretches of words, hashed and joined over the whole corpus."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged, unstage
from tessella.llm.wordhash import mix, slices
from tessella.llm.wordhash import words as word_hashes

#: Consecutive sentences of a run. Shorter repeats are common lines of text that clean documents share too: on the
#: 1000 documents of sf0.01, runs of 2, 3 and 4 sentences touch 229, 67 and 20 that hold no repeated stretch.
RUN = 4

#: Words of a stretch. Of any ``NEAR`` consecutive stretches the one with the least hash is compared, so that each
#: passage of ``STRETCH + NEAR - 1`` = 51 words holds a compared one, the same wherever the passage stands.
STRETCH, NEAR = 36, 16

#: Places from here on are of words, those below of sentences.
_WORD_PLACE = 1 << 30
#: Odd, so it has an inverse modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_END = re.compile(r"(?<=[.!?])\s+|\n\s*")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence: it ends with a line, or with ``.``, ``!`` or ``?`` before white space."""
    out, at = [], 0
    for m in _END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out


def runs(text: str, run: int = RUN) -> list[tuple[int, int]]:
    """Place and 128-bit hash of each run of ``run`` sentences, white space and case set aside.

    A text of fewer sentences is one run.
    """
    own = [" ".join(text[a:b].lower().split()) for a, b in sentences(text)]
    size = min(run, len(own))
    if not size:
        return []
    return [(k, xxhash.xxh3_128_intdigest("\n".join(own[k : k + size]).encode("utf-8", "surrogatepass"))) for k in range(len(own) - size + 1)]


def stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and 128-bit hash (two columns) of each compared stretch of words (``str.split``, case set aside)."""
    w, n = word_hashes([" ".join(t.lower().split()).encode("utf-8", "surrogatepass") for t in texts])
    ends = np.cumsum(n)
    text = np.repeat(np.arange(len(texts)), n)
    first = np.flatnonzero(np.arange(len(w)) + STRETCH + NEAR - 1 <= ends[text])
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    h = []
    for k, base in enumerate(_BASES):
        powers = [np.cumprod(np.append(np.uint64(1), np.full(len(w), b, np.uint64)), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
        total = np.append(np.uint64(0), np.cumsum(mix(w + np.uint64(k)) * powers[0][:-1], dtype=np.uint64))
        h.append(mix((total[STRETCH:] - total[:-STRETCH]) * powers[1][: len(w) - STRETCH + 1]))
    least, at = h[0][first], first.copy()
    for k in range(1, NEAR):
        other = h[0][first + k]
        less = other < least
        least[less], at[less] = other[less], first[less] + k
    at = np.unique(at)
    return text[at], at - (ends - n)[text[at]], np.stack([x[at] for x in h], 1).view("<i8")


def _hashed(run: int):
    def go(batches):
        for whole in batches:
            for batch in slices(whole):
                docs, places, values = [], [], []
                ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
                for doc, text in zip(ids, texts, strict=True):
                    own = runs(text, run)
                    docs += [doc] * len(own)
                    places += [k for k, _ in own]
                    values += [h for _, h in own]
                data = np.frombuffer(b"".join(h.to_bytes(16, "little") for h in values), "<i8").reshape(-1, 2)
                text, at, more = stretches(texts)
                docs = np.concatenate((np.array(docs, np.int64), np.array(ids, np.int64)[text]))
                places = np.concatenate((np.array(places, np.int32), (at + _WORD_PLACE).astype(np.int32)))
                data = np.concatenate((data, more))
                yield pa.record_batch([pa.array(docs), pa.array(places), pa.array(data[:, 0].copy()), pa.array(data[:, 1].copy())], names=["doc_id", "at", "h1", "h2"])

    return go, "doc_id long, at int, h1 long, h2 long"


def repeated(docs: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, gone``: the ranges (``a`` to ``b``, of sentences or of words) to remove from each document that has any."""
    go, schema = _hashed(run)
    spans = staged(docs.where("doc_id is not null").mapInArrow(go, schema), "spans")
    # All spans are shuffled twice, as hashes and counts and then as rows; what follows is about the repeated ones only.
    several = staged(spans.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2"), "several")
    again = staged(spans.join(several, ["h1", "h2"]), "again")
    unstage(spans, several)
    first = staged(again.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "at")).alias("first")), "first")
    later = again.join(first, ["h1", "h2"]).where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("at") != F.col("first.at")))
    # Words of the first occurrence itself stay, also where a later one in the same document overlaps it.
    of_words = F.col("at") >= _WORD_PLACE
    a = F.when(of_words & (F.col("doc_id") == F.col("first.doc_id")), F.greatest("at", F.col("first.at") + STRETCH)).otherwise(F.col("at"))
    b = F.col("at") + F.when(of_words, STRETCH).otherwise(run)
    gone = staged(later.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct(a.alias("a"), b.alias("b")))).alias("gone")), "gone")
    unstage(again, first)
    return gone


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, gone: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]], int]:
    """The text without the ranges ``gone``, the removed ranges, and the number of sentences that lose words to them.

    White space after a removed range goes too; after one that starts inside a sentence, that before it does.
    """
    if not gone:
        return text, [], 0
    own = sentences(text)
    starts = [a for a, _ in own] + [len(text)]
    ranges = [(starts[a], starts[min(b, len(own))]) for a, b in _joined([r for r in gone if r[0] < _WORD_PLACE]) if a < len(own)]
    if gone[-1][0] >= _WORD_PLACE:
        words, heads = [m.span() for m in re.finditer(r"\S+", text)], set(starts)
        for a, b in _joined([(a - _WORD_PLACE, b - _WORD_PLACE) for a, b in gone if a >= _WORD_PLACE]):
            if a >= len(words):
                continue
            b = min(b, len(words))
            if a == 0 or words[a][0] in heads:
                ranges.append((words[a][0], words[b][0] if b < len(words) else len(text)))
            else:
                ranges.append((words[a - 1][1], words[b - 1][1]))
    ranges = _joined(ranges)
    out, at, k, touched = [], 0, 0, 0
    for a, b in ranges:
        out.append(text[at:a])
        at = b
    for a, b in own:
        while k < len(ranges) and ranges[k][1] <= a:
            k += 1
        touched += k < len(ranges) and ranges[k][0] < b
    return "".join([*out, text[at:]]), ranges, touched


def span_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN) -> DataFrame:
    """One row per document: ``doc_id, n_sentences, n_removed, removed, text, text_sha256``.

    Every run of ``run`` consecutive sentences is compared with all others,
    of the same and of other documents. Its first occurrence (smallest id, then place) stays; sentences
    covered by any other are removed. A text of fewer sentences is one run. Apart from sentences, stretches
    of ``STRETCH`` words are compared in the same way, and the words that they cover are removed: each
    repeated passage of ``STRETCH + NEAR - 1`` = 51 words or more loses all but ``NEAR - 1`` words at most
    at either end, however it is cut into sentences and lines. ``n_removed`` counts the sentences that are
    removed in whole or in part, so it is 0 only for a text that stays as it is; ``removed`` are the ranges
    ``start:end`` in code points of the source. A null text
    counts as empty. Rows that repeat an id are the same document; a document with a null id is neither
    compared nor changed. An empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def go(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                new, ranges, touched = cut(text or "", [(r["a"], r["b"]) for r in gone or []])
                rows.append((len(sentences(text or "")), touched, ",".join(f"{a}:{b}" for a, b in ranges), new, hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest()))
            columns = zip(*rows, strict=True)
            yield pa.record_batch([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.string()] * 3, strict=True)]], names=["doc_id", "n_sentences", "n_removed", "removed", "text", "text_sha256"])

    marked = docs.join(repeated(docs, run), "doc_id", "left").select("doc_id", "text", "gone")
    return marked.mapInArrow(go, "doc_id long, n_sentences long, n_removed long, removed string, text string, text_sha256 string")
