"""Token ids of texts put together from the ids of their space-separated chunks, each encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np

#: A space that no chunk may start with.
_BOUND = re.compile(r" (?:\s|\Z)")


def chunks(text: str) -> list[str]:
    """The text cut before every space that is followed by a character other than white space."""
    parts = text.split(" ")
    if not _BOUND.search(text):
        return [parts[0], *[f" {p}" for p in parts[1:]]] if parts[0] else [f" {p}" for p in parts[1:]]
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(f" {p}")
        else:
            out[-1] += f" {p}"
    return out if out[0] else out[1:]


def keys(text: str) -> list[str]:
    """The chunks under shorter names: a space and a word go by the word, all others by a space and the chunk."""
    if text and not _BOUND.search(text):
        parts = text.split(" ")
        if parts[0]:
            parts[0] = f" {parts[0]}"
            return parts
        return parts[1:]
    return [c[1:] if c[0] == " " and c[1:] and not c[1].isspace() else f" {c}" for c in chunks(text)]


def chunk_of(key: str) -> str:
    return key[1:] if key[0] == " " else f" {key}"


class ChunkCache:
    """Ids of chunks as bytes of unsigned 32-bit numbers, kept up to a bound between batches of a worker."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], split: Callable[[str], list[str]] = chunks, most: int = 500_000) -> None:
        self.encode, self.split, self.most, self.ids = encode, split, most, {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.split(t) for t in texts]
        if len(self.ids) > self.most:
            self.ids.clear()
        new = list(set().union(*cut).difference(self.ids))
        if new:
            self.ids.update(zip(new, self.encode(new), strict=True))
        get = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), "<u4") for parts in cut]
