"""Words of texts as UTF-8 bytes, by separators, as numpy arrays; A-Z count as a-z."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from framesift.llm.words import mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: White space of ASCII; what separates words in pieces, and pieces.
SPACES, BLANKS, STOPS = b" \t\n\x0b\x0c\r", b" \t", b".,;:!?\n\x0b\x0c\r"


class ByteWords(NamedTuple):
    """hash of each word (never 0), its first byte and the byte after it in raw; bounds[d]:bounds[d+1] are those of text d; piece: equal for words of one piece."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    piece: np.ndarray
    raw: np.ndarray


def byte_words(texts: list, blanks: bytes = SPACES, stops: bytes = b"\n") -> ByteWords:
    """Longest runs without blanks and stops; a stop and a text's end also end a piece. Null and empty texts have no words."""
    coded = [(t or "").encode("utf-8", "replace") for t in texts]
    raw = _LOWER[np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)]
    blank, stop = np.zeros(256, bool), np.zeros(256, bool)
    blank[list(blanks)], stop[list(stops + b"\n")] = True, True
    inside = ~(blank | stop)[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside].view(np.int8)))
    start, end = edge[::2], edge[1::2]
    bounds = np.searchsorted(start, np.cumsum([0] + [len(c) + 1 for c in coded]))
    piece = np.cumsum(stop[raw])[start] if len(start) else start
    if not len(start):
        return ByteWords(np.zeros(0, np.uint64), start, end, bounds, piece, raw)
    size = end - start
    power = np.cumprod(np.r_[np.uint64(1), np.full(int(size.max()) - 1, _FACTOR, np.uint64)])
    at, first = np.flatnonzero(inside), np.cumsum(size) - size
    rel = np.arange(len(at)) - np.repeat(first, size)
    value = mix(np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * power[rel], first) + size.astype(np.uint64))
    return ByteWords(np.maximum(value, np.uint64(1)), start, end, bounds, piece, raw)
