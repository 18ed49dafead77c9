"""Runs of bytes in whole texts, and their hashes, on Arrow buffers."""

from __future__ import annotations

import numpy as np

from marketlens.llm.shingles import _hash, _tables


def byte_set(*parts: str | range | int) -> np.ndarray:
    """A table of 256 truth values: the bytes of characters, ranges, numbers."""
    table = np.zeros(256, bool)
    for p in parts:
        table[list(p.encode()) if isinstance(p, str) else p] = True
    return table


def runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of ``inside`` bytes of texts laid end
    to end, and the text that each lies in.  Runs end with their text."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    within = inside[buf]
    first = np.zeros(len(buf) + 1, bool)  # positions at which a text starts
    first[offsets] = True
    before = np.concatenate(([False], within[:-1])) & ~first[:-1]
    after = np.concatenate((within[1:], [False])) & ~first[1:]
    begin = np.flatnonzero(within & ~before)
    stop = np.flatnonzero(within & ~after) + 1
    return begin, stop, np.searchsorted(offsets, begin, side="right") - 1


def hashes(buf: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64 bits of each run, A-Z lower-cased."""
    return _hash(buf, begin, stop, _tables()[0]) if len(begin) else np.zeros(0, np.uint64)
