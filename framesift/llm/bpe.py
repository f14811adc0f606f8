"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token marks a certain cut: no merge can ever cross it.
Each word is cut there, the fragments are encoded independently by the merges, and their ids are concatenated. The new
fragments of a block of texts are merged together, as arrays. Equal chunks of text between white space are encoded once
in a task, within bounded tables.

The vocabulary is a public tokenizer file whose path is a parameter; it is read on the driver and broadcast (its size is
that of a vocabulary, a few MB). Nothing but the file's own normaliser, pattern and merges is used.

Defined results: null and empty texts have no tokens and decode to an empty text; texts of any length are encoded
whole; repeated rows and rows without an id are encoded as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.storage import map_frames
from framesift.llm.words import blocks

#: Chunks, and words, of a generation that a Python worker remembers (it has two); up to so many pieces fragments are merged as arrays; fewer words than that are encoded one by one; characters of a block.
REMEMBERED, FEW, ALONE, BLOCK = 150_000, 40, 50, 1_000_000
#: Bytes in the order in which the byte alphabet takes the next free character from 256 on: those that are not printable.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    rest = iter(range(256, 512))
    plain = set(_PLAIN)
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ids, merge ranks and special tokens of a tokenizer file of word-end byte pair encoding."""

    def __init__(self, text: str) -> None:
        held = json.loads(text)
        model = held["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {p: i for i, p in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.pattern: str = held["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]

    @cached_property
    def names(self) -> dict[int, str]:
        return {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}

    @cached_property
    def joined(self) -> set[str]:
        """The pairs of neighbouring byte characters that occur inside some token."""
        out: set[str] = set()
        for token in self.ids:
            bare = token.removesuffix(self.suffix) if self.suffix else token
            out.update(bare[i : i + 2] for i in range(len(bare) - 1))
        return out

    def fragments(self, word: str) -> list[str]:
        """A word of byte characters, cut at the pairs that no token holds."""
        out, at = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                out.append(word[at:i])
                at = i
        return [*out, word[at:]]

    def merge(self, parts: list[str]) -> list[str]:
        """The pieces after all merges, lowest rank first and leftmost first among equals."""
        return self._merge_few(parts) if len(parts) <= FEW else self._merge_many(parts)

    def _merge_few(self, parts: list[str]) -> list[str]:
        get, none = self.ranks.get, len(self.ranks)
        order = [get(p, none) for p in zip(parts, parts[1:])]
        while order and (least := min(order)) < none:
            i = order.index(least)
            parts[i] += parts.pop(i + 1)
            del order[i]
            if i:
                order[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(order):
                order[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def _merge_many(self, parts: list[str]) -> list[str]:
        n = len(parts)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(self.ranks[p], i) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in self.ranks]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if not gone[i] else n
            if j >= n or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            gone[j] = True
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for i, p in enumerate(parts) if not gone[i]]

    def encode_word(self, word: str) -> list[str]:
        pieces = self.fragments(word)
        out: list[str] = []
        for k, fragment in enumerate(pieces):
            parts = list(fragment)
            if k == len(pieces) - 1:
                parts[-1] += self.suffix
            out += self.merge(parts)
        return out

    @cached_property
    def arrays(self) -> Arrays:
        return Arrays(self)


class Arrays:
    """The same vocabulary as arrays, to encode many words at once."""

    def __init__(self, v: Vocabulary) -> None:
        self.v, alphabet = v, byte_alphabet()
        self.alphabet = dict(enumerate(alphabet))
        #: Ids of the bytes inside a word and at its end; whether a token holds the two bytes 256 * a + b.
        self.inner, self.last = (np.array([v.ids.get(c + end, -1) for c in alphabet]) for end in ("", v.suffix))
        self.held = np.array([a + b in v.joined for a in alphabet for b in alphabet])
        self.none, self.wide = len(v.ranks), max(v.ids.values()) + 1
        #: Pairs of ids in order, with their ranks; the id that a merge makes, by rank.
        pair = np.array([v.ids[a] * self.wide + v.ids[b] for a, b in v.ranks], np.int64)
        rank = np.array(list(v.ranks.values()), np.int64)
        order = np.argsort(pair)
        self.pair, self.rank = np.r_[pair[order], np.int64(-1)], np.r_[rank[order], self.none]
        self.made = np.zeros(int(rank.max(initial=0)) + 1, np.int64)
        self.made[rank] = [v.ids[a + b] for a, b in v.ranks]
        self.none = max(self.none, len(self.made))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.wide + right
        at = np.searchsorted(self.pair[:-1], key)
        return np.where(self.pair[at] == key, self.rank[at], self.none)

    def _merge(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all fragments in order and their numbers, after all merges; ids holds the fragments' first ones, size their numbers.

        In each round every fragment that can merge does so at its pair of lowest rank, the leftmost among equals."""
        own, rank = np.arange(len(size)), np.full(len(ids), self.none)
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(size) - 1] = False  # a fragment's last id begins no pair
        begin = np.flatnonzero(inside)
        rank[begin] = self._ranks(ids[begin], ids[begin + 1])
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(own):
            first = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, first)
            live = least < self.none
            if not live.all():
                each = np.repeat(live, size)
                done.append((own[~live], size[~live], ids[~each]))
                own, size, least, ids, rank = own[live], size[live], least[live], ids[each], rank[each]
                if not len(own):
                    break
            place = np.repeat(np.arange(len(own)), size)
            hit = np.flatnonzero(rank == least[place])
            hit = hit[np.r_[True, np.diff(place[hit]) != 0]]
            ids[hit] = self.made[least]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            rank[hit] = rank[hit + 1]  # whether a pair follows
            ids, rank, size = ids[stay], rank[stay], size - 1
            at, first = hit - np.arange(len(hit)), np.cumsum(size) - size
            for i in (at[at > first] - 1, at[at < first + size - 1]):
                rank[i] = self._ranks(ids[i], ids[i + 1])
        owner, count = (np.concatenate([d[k] for d in done]) for k in (0, 1))
        flat, start = np.concatenate([d[2] for d in done]), np.cumsum(count) - count
        order = np.argsort(owner)
        count = count[order]
        return flat[np.repeat(start[order] - (np.cumsum(count) - count), count) + np.arange(len(flat))], count

    def encode(self, words: list[str]) -> list[bytes]:
        """ids of each word as little-endian 32-bit integers; words aren't empty."""
        coded = [w.encode("utf-8", "replace") for w in words]
        if len(words) < ALONE:
            return [b"".join([self.v.ids[t].to_bytes(4, "little") for t in self.v.encode_word(c.decode("latin-1").translate(self.alphabet))]) for c in coded]
        raw, length = np.frombuffer(b"".join(coded), np.uint8).astype(np.int64), np.array([len(c) for c in coded])
        end = np.cumsum(length)
        cut = np.r_[True, ~self.held[raw[:-1] * 256 + raw[1:]]]
        cut[end[:-1]] = True
        begin = np.flatnonzero(cut)
        size = np.diff(np.r_[begin, len(raw)])
        ids = self.inner[raw]
        ids[end - 1] = self.last[raw[end - 1]]
        long = np.flatnonzero(size > FEW)
        if len(long):  # as fragments of their merged pieces, which the rounds below leave as they are
            last, parts, at = set((end - 1).tolist()), [], 0
            for k in long.tolist():
                lo, hi = int(begin[k]), int(begin[k] + size[k])
                names = list(raw[lo:hi].astype(np.uint8).tobytes().decode("latin-1").translate(self.alphabet))
                if hi - 1 in last:
                    names[-1] += self.v.suffix
                merged = [self.v.ids[t] for t in self.v.merge(names)]
                parts += [ids[at:lo], np.array(merged)]
                at, size[k] = hi, len(merged)
            ids = np.concatenate([*parts, ids[at:]])
        if (ids < 0).any():
            raise KeyError("the vocabulary lacks a byte")
        ids, count = self._merge(ids, size)
        total = np.r_[0, np.cumsum(count)]
        bound = (total[np.r_[np.searchsorted(begin, end - length), len(begin)]] * 4).tolist()
        flat = ids.astype("<u4").tobytes()
        return [flat[a:b] for a, b in zip(bound, bound[1:])]


# What the library's tables know of Unicode 16 (and, for small letters, 17) beyond Python's Unicode 15.1.
_LETTERS = "1C89-1C8A A7CB-A7CD A7DA-A7DC 105C0-105F3 10D4A-10D65 10D6F-10D85 10EC2-10EC4 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11BC0-11BE0 13460-143FA 16100-1611D 16D40-16D6C 18CFF 1E5D0-1E5ED 1E5F0"
_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 16130-16139 16D70-16D79 1CCF0-1CCF9 1E5F1-1E5FA"
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _class(kind: str, more: str) -> str:
    """A set of all characters whose category begins so in Python's table, and of those ranges."""
    edges, inside = [], False
    for c in range(0x110001):
        here = c < 0x110000 and unicodedata.category(chr(c))[0] == kind
        if here != inside:
            edges.append(c)
            inside = here
    ranges = [(a, b - 1) for a, b in zip(edges[::2], edges[1::2], strict=True)]
    ranges += [(int(r.split("-")[0], 16), int(r.split("-")[-1], 16)) for r in more.split()]
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


class Remembered(dict):
    """What was asked for lately, in two generations: the older one goes when the newer one is full."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}

    def lacks(self, keys: set) -> list:
        """The keys that aren't known; the others are in the newer generation now."""
        older, out = self.older, []
        for k in keys:
            if k not in self:
                if (got := older.get(k)) is None:
                    out.append(k)
                else:
                    self[k] = got
        return out

    def age(self, new: list) -> None:
        """new: the keys since the last call. Long ones aren't kept."""
        for k in new:
            if len(k) >= 100:
                del self[k]
        if len(self) >= REMEMBERED:
            self.older = self.copy() if len(self) < 3 * REMEMBERED else {}
            self.clear()


class Encoder:
    """Texts -> ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.word = regex.compile(vocabulary.pattern.replace(r"\s", r"\p{White_Space}"))
        self.exact: regex.Pattern | None = None
        self.gap = regex.compile(r"\p{White_Space}+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.known, self.words = Remembered(), Remembered()
        self.assigned: set[str] = set()
        names = vocabulary.names
        self.names = pa.array([names.get(i) for i in range(max(names) + 1)], pa.large_string())

    def _split(self, chunk: str) -> list[str]:
        """The chunk's words. Where it has characters that Python's table doesn't know, newer tables say otherwise than the library's, so all classes are ranges."""
        if chunk.isascii():
            return [chunk] if chunk.isalpha() else self.word.findall(chunk)
        if self.assigned.issuperset(chunk):
            return self.word.findall(chunk)
        if all(unicodedata.category(c) != "Cn" for c in chunk):
            self.assigned.update(chunk)
            return self.word.findall(chunk)
        if self.exact is None:
            pattern = self.v.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\p{L}", _class("L", _LETTERS)).replace(r"\p{N}", _class("N", _NUMBERS))
            self.exact = regex.compile(pattern, regex.V1)
        return self.exact.findall(chunk.translate(_SMALL))

    def chunks(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # Letters are lower-cased one by one: a capital sigma never becomes a final one.
        low = text.replace("Σ", "σ").lower()
        if any(c in low for c in "\x1c\x1d\x1e\x1f"):  # str.split takes these for white space
            return [c for c in self.gap.split(low) if c]
        return low.split()

    def _pieces(self, text: str) -> list[str | bytes]:
        """The text's chunks; a special token is its id."""
        if not self.cut or not any(s in text for s in self.v.special):
            return self.chunks(text)
        out: list[str | bytes] = []
        for piece in self.cut.split(text):
            out += [self.v.special[piece].to_bytes(4, "little")] if piece in self.v.special else self.chunks(piece)
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """ids of each whole text."""
        pieces = [self._pieces(t) for t in texts]
        known, words = self.known, self.words
        new = known.lacks(set(chain.from_iterable(pieces)))
        found = {c: self._split(c) for c in new if isinstance(c, str)}
        fresh = words.lacks(set(chain.from_iterable(found.values())))
        words.update(zip(fresh, self.v.arrays.encode(fresh), strict=True))
        for chunk, own in found.items():
            known[chunk] = words[own[0]] if len(own) == 1 else b"".join([words[w] for w in own])
        known.update((c, c) for c in new if isinstance(c, bytes))
        get = known.__getitem__
        out = [b"".join(map(get, p)) for p in pieces]
        known.age(new)
        words.age(fresh)
        return out

    def decode_all(self, coded: list[bytes]) -> list[str]:
        """Token names of each joined by spaces, as the file names no decoder."""
        at = np.cumsum([0, *(len(b) // 4 for b in coded)])
        names = self.names.take(pa.array(np.frombuffer(b"".join(coded), "<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), names), pa.scalar(" ", pa.large_string())).to_pylist()

    def encode(self, text: str) -> tuple[bytes, str]:
        """ids and decoded text of a whole text."""
        ids = self.encode_all([text])[0]
        return ids, " ".join([self.v.names[i] for i in np.frombuffer(ids, "<u4").tolist()])


_HELD: dict[int, Encoder] = {}


def _encoder(text: str) -> Encoder:
    """The encoder of this vocabulary file, kept while the Python worker lives."""
    key = hash(text)
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Encoder(Vocabulary(text))
    return _HELD[key]


def _encoded(documents: DataFrame, path: str, decoded: bool) -> DataFrame:
    with open(path, encoding="utf-8") as f:
        shared = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value)
        for frame in frames:
            for at, texts in blocks(frame["text"].tolist(), BLOCK):
                ids = encoder.encode_all(texts)
                out = {"doc_id": frame["doc_id"].array[at : at + len(texts)], "ids": ids, "n_tokens": [len(b) // 4 for b in ids]}
                yield pd.DataFrame(out | ({"decoded": encoder.decode_all(ids)} if decoded else {}))

    return map_frames(documents.select("doc_id", "text"), run, "doc_id long, ids binary, n_tokens long" + ", decoded string" * decoded)


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), n_tokens of every row's whole text."""
    return _encoded(documents, path, False)


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """As encode, and decoded: the text of the ids."""
    return _encoded(documents, path, True)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with ids as encode gives them: token names joined by spaces, as the file names no decoder."""
    with open(path, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Vocabulary(shared.value).names
        for frame in frames:
            texts = [" ".join(names[int.from_bytes(b[i : i + 4], "little")] for i in range(0, len(b or b""), 4)) for b in frame["ids"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "text": texts})

    return map_frames(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    got = round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
    return got.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
