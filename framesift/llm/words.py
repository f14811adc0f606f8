"""Words of a batch of texts as numpy arrays, for use inside Spark tasks.

A word is a longest run of ASCII letters, ASCII digits and non-ASCII characters of the lower-cased text, seen as
UTF-8 bytes. Everything is vectorised over the bytes of a block of texts, so no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

_IN_WORD = np.zeros(256, bool)
for _a, _b in ((48, 58), (97, 123), (65, 91), (128, 256)):
    _IN_WORD[_a:_b] = True
_SPAN = 1024
_POWER = np.cumprod(np.r_[np.uint64(1), np.full(_SPAN - 1, 0x9E3779B97F4A7C15, np.uint64)])


class Words(NamedTuple):
    """hash of each word, its first byte and the byte after it in raw, and bounds[d]:bounds[d+1] for text d."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    raw: np.ndarray


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; different seeds give independent hash functions."""
    h = h + np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def blocks(texts: list, most: int = 200_000) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) with at most `most` characters in each block; a longer text is a block alone."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield at, held
            at, held, size = i, [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield at, held


def words(texts: list[str]) -> Words:
    """The words of these texts; null and empty texts have none."""
    coded = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    inside = _IN_WORD[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    text_at = np.cumsum([0] + [len(c) + 1 for c in coded])
    bounds = np.searchsorted(start, text_at)
    if not len(start):
        return Words(np.zeros(0, np.uint64), start, end, bounds, raw)
    at = np.flatnonzero(inside)
    size = end - start
    first = np.cumsum(size) - size
    rel = np.arange(len(at)) - np.repeat(first, size)
    value = (raw[at].astype(np.uint64) + np.uint64(1)) * _POWER[rel % _SPAN]
    return Words(mix(np.add.reduceat(value, first)), start, end, bounds, raw)


def prefixes(w: Words, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """For each size the hash of the first bytes of every word (of the whole word where it is shorter)."""
    total, at, pad = np.zeros(len(w.start), np.uint64), 0, np.r_[w.raw, np.zeros(max(sizes), np.uint8)]
    for k in sizes:
        while at < k:
            here = w.start + at
            total = total + np.where(here < w.end, pad[here].astype(np.uint64) + np.uint64(1), np.uint64(0)) * _POWER[at]
            at += 1
        yield mix(total, k)


def shingles(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the runs of k words; of all words together if there are fewer than k but at least one."""
    if not len(hashes):
        return hashes
    k = min(k, len(hashes))
    n = len(hashes) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    return mix(out, 7)
