"""64-bit hashes of the words of many texts at once, by prefix sums over their bytes.

The hash of a word is the polynomial of its bytes' table values in an odd base modulo 2**64. The
inverse of the base exists, so the value does not depend on where in the buffer the word stands,
and one cumulative sum serves all words of a buffer.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed in one numpy pass; longer texts are taken in parts that end at a space.
PART = 1 << 20

_rng = np.random.default_rng(20240229)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all bits; a bijection of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(PART + 64, n).bit_length()
    if size not in _powers:
        both = []
        for base in (_BASE, _INVERSE):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            both.append(np.cumprod(out, dtype=np.uint64))
        if size > 4 * PART:  # for one huge word only: not worth keeping
            return both[0], both[1]
        _powers[size] = (both[0], both[1])
    return _powers[size]


#: Kinds of bytes for tokens(): 0 white space, 1 letters, digits, ``_`` and all beyond ASCII, 2 the rest.
_KIND = np.full(256, 2, np.int8)
_KIND[_SPACE] = 0
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1


def runs(raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal runs of bytes of one kind other than 0."""
    kinds = kind[raw]
    start = np.flatnonzero(np.diff(kinds, prepend=0))
    end = np.append(start[1:], len(raw))
    some = kinds[start] > 0
    return start[some], end[some]


def run_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True) -> np.ndarray:
    """Hashes of the bytes from each start to each end; A-Z count as a-z if ``lower``."""
    power, inverse = _power(len(raw) + 1)
    value = _TABLE[_LOWER[raw] if lower else raw]
    value *= power[: len(raw)]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _hash_buffer(buf: bytes, lower: bool, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start offsets and hashes of the maximal runs of bytes of one kind other than 0."""
    raw = np.frombuffer(buf, np.uint8)
    start, end = runs(raw, kind)
    return start, run_hashes(raw, start, end, lower)


def by_doc(doc: np.ndarray, h: np.ndarray, top: np.ndarray) -> np.ndarray:
    """The order by document, then ``top`` (under 2**52, growing), then ``h``; of fewer than 4096 documents."""
    key = (doc.astype(np.uint64) << np.uint64(52)) | top
    order = np.argsort(key)
    a, b = h[order], key[order]
    if np.any((b[1:] == b[:-1]) & (a[1:] != a[:-1])):  # one sort key for several values: sort by all of it
        return np.lexsort((h, key))
    return order


def slices(batch: pa.RecordBatch, column: int = 1, size: int = 2 << 20, rows: int = 2048):
    """Parts of a batch with up to ``size`` bytes of text (or one row), so that memory doesn't grow with the batch."""
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, at + int(np.searchsorted(np.cumsum(length[at : at + rows]), size, "right")))
        yield batch.slice(at, to - at)
        at = to


def parts(data: bytes):
    """The text in parts of some ``PART`` bytes that end before white space."""
    at = 0
    while len(data) - at > PART:
        to = at + PART
        while to < len(data) and not _SPACE[data[to]]:
            to += 1
        yield data[at:to]
        at = to
    yield data[at:]


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+`` of the texts, in order, and each text's number of words."""
    return _hashed(texts, True, (~_SPACE).astype(np.int8))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same for runs of word characters and runs of other characters that are not white space."""
    return _hashed(texts, True, _KIND)


def _hashed(texts: list[bytes], lower: bool, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hashes, counts = [], np.zeros(len(texts), np.int64)
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            start, h = _hash_buffer(b"\n".join(x for _, x in group), lower, kind)
            ends = np.cumsum([len(x) + 1 for _, x in group])
            np.add.at(counts, [k for k, _ in group], np.diff(np.searchsorted(start, ends), prepend=0))
            hashes.append(h)
        group.clear()
        size = 0

    for k, data in enumerate(texts):
        for part in parts(data):
            if size + len(part) > PART:
                flush()
            group.append((k, part))
            size += len(part) + 1
    flush()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingles(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed ``width``-word shingles of each text, ordered by text and hash, and the number of each.

    A text of fewer words has its whole word sequence as its one shingle; one without words has none.
    """
    w, n = words(texts)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64))
    padded = np.concatenate((w, np.zeros(width, np.uint64)))
    h = np.zeros(len(w), np.uint64)
    for k in range(width):
        h += padded[k : k + len(w)] * (factor[k] | np.uint64(1))
    doc = np.repeat(np.arange(len(texts)), n)
    last = np.cumsum(n)
    place = np.arange(len(w)) - np.repeat(last - n, n)
    keep = place <= np.repeat(n, n) - width
    short = np.flatnonzero((n > 0) & (n < width))
    for k in short:  # at most width - 1 words each
        a = last[k] - n[k]
        own = w[a : last[k]]
        own = np.concatenate((own * (factor[: len(own)] | np.uint64(1)), mix(np.full(1, len(own) + 1000, np.uint64))))
        h[a] = own.sum(dtype=np.uint64)
        keep[a] = True
    h, doc = mix(h[keep]), doc[keep]
    order = by_doc(doc, h, h >> np.uint64(12))
    h, doc = h[order], doc[order]
    if len(h):
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
        h, doc = h[new], doc[new]
    return h, np.bincount(doc, minlength=len(texts))
