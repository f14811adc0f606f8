"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of 64 words at every 32nd word. Their TF-IDF rows, over the benchmark's own terms (other
terms add nothing to a product with an item), are decomposed by a distributed randomised SVD: tasks sum A'(A x) for
random vectors x, and the driver turns those sums, of the size of terms x rank, into singular vectors. Every passage is
projected on these and takes as candidates the items whose cosine passes a low threshold. Candidates are checked word
by word: the longest common subsequence of item and surrounding words must cover most of the item, and so must that
of its answer, the item's last words; so paraphrases that keep most words in order are found and passages that share a
phrase are not.

Scale: the benchmark is taken in parts of about ITEMS items, so that what is broadcast and summed stays bounded. For each part
texts are read once; what is kept of them is where benchmark words stand, in a table that the later steps read. Counts and
directions come from all passages and all items, and every passage is searched. Only sums are shuffled.

Defined results: null and empty texts and items match nothing; items without a term that is rare enough are compared by
all their terms; rows with equal ids (or without one) are searched one by one and give one result row for each item; items
with equal ids and other texts, or without an id, are searched each and share a result row of their id; ties in cosine
don't matter, as every candidate is checked; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.storage import map_frames, saved, scratch
from framesift.llm.words import blocks, words

HALF, RANK, OVER, ITEMS = 32, 224, 16, 1500
#: Cosine of a candidate; shares of the item and of its answer in the common subsequence; share of the item that makes up for the answer; words of an answer; share of passages above which a term is too common.
COSINE, SHARE, ANSWER_SHARE, SURE, ANSWER, COMMON = 0.2, 0.75, 0.6, 0.9, 5, 0.01
_CHUNK = 64


def common_length(item: np.ndarray, other: np.ndarray) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    masks: dict[int, int] = {}
    for i, x in enumerate(item.tolist()):
        masks[x] = masks.get(x, 0) | (1 << i)
    full = (1 << len(item)) - 1
    v = full
    for y in other.tolist():
        if m := masks.get(y, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


class Terms:
    """The distinct word hashes of a part of the benchmark, and where they occur in a block of texts."""

    def __init__(self, items: list[np.ndarray]) -> None:
        self.hashes = np.unique(np.concatenate(items)) if items else np.zeros(0, np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes & np.uint64((1 << 20) - 1)] = True

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """places of the words that are terms, and their terms."""
        at = np.flatnonzero(self.maybe[hashes & np.uint64((1 << 20) - 1)])
        term = np.minimum(np.searchsorted(self.hashes, hashes[at]), max(len(self) - 1, 0))
        real = self.hashes[term] == hashes[at] if len(self) else np.zeros(len(at), bool)
        return at[real], term[real]


class Held(NamedTuple):
    """Some texts' benchmark words: place and term of each, bounds[t]:bounds[t+1] for text t, and the number of its first half passage (one more at the end)."""

    at: np.ndarray
    term: np.ndarray
    bounds: np.ndarray
    halves: np.ndarray

    def cells(self, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """half passage, term and count of every cell that isn't empty, in order."""
        text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        half = self.halves[text] + self.at // HALF
        cell, count = np.unique(half * max(terms, 1) + self.term, return_counts=True)
        return cell // max(terms, 1), cell % max(terms, 1), count


def _kept(documents: DataFrame, terms: Terms) -> DataFrame:
    """doc_id, n_words, at, term (32-bit numbers as binaries) of every text that has a benchmark word; others count by n_words."""
    shared = documents.sparkSession.sparkContext.broadcast(terms)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, block in blocks(frame["text"].tolist()):
                w = words(block)
                at, term = shared.value.find(w.hash)
                cut = np.searchsorted(at, w.bounds)
                at, term = at.astype(np.uint32), term.astype(np.uint32)
                rows = [((at[a:b] - lo).astype(np.uint32).tobytes(), term[a:b].tobytes()) for a, b, lo in zip(cut[:-1].tolist(), cut[1:].tolist(), w.bounds[:-1].tolist(), strict=True)]
                out = pd.DataFrame(rows, columns=["at", "term"])
                out.insert(0, "n_words", np.diff(w.bounds))
                out.insert(0, "doc_id", frame["doc_id"].array[first : first + len(block)])
                yield out

    return map_frames(documents.select("doc_id", "text"), run, "doc_id long, n_words long, at binary, term binary")


def _parts(frames: Iterator[pd.DataFrame], rows: int = 400) -> Iterator[tuple[list, Held]]:
    for frame in frames:
        for k in range(0, len(frame), rows):
            part = frame.iloc[k : k + rows]
            size = np.array([len(b) // 4 for b in part["at"]])
            at, term = (np.frombuffer(b"".join(part[c]), np.uint32).astype(np.int64) for c in ("at", "term"))
            yield part["doc_id"].tolist(), Held(at, term, np.r_[0, np.cumsum(size)], np.r_[0, np.cumsum(-(-part["n_words"].to_numpy() // HALF))])


def _begins(key: np.ndarray) -> np.ndarray:
    """Where each distinct key of a sorted array begins."""
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)


def _products(rows: np.ndarray, row: np.ndarray, value: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of a sorted array and, over each, the sum of value times that row. Keys of as many values are multiplied together."""
    begin = _begins(key)
    size, out = np.diff(np.r_[begin, len(key)]), np.empty((len(begin), rows.shape[1]), rows.dtype)
    for n in np.unique(size).tolist():
        which = np.flatnonzero(size == n)
        at = begin[which][:, None] + np.arange(n)
        out[which] = np.matmul(value[at][:, None], rows[row[at]])[:, 0]
    return key[begin], out


def _weights(kept: DataFrame, n_terms: int) -> np.ndarray:
    """Inverse document frequency of each term over all half passages; 0 for those in too many."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, total = np.zeros(n_terms, np.int64), 0
        for _, held in _parts(frames):
            seen += np.bincount(held.cells(n_terms)[1], minlength=n_terms)
            total += int(held.halves[-1])
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"term": np.r_[-1, some], "n": np.r_[total, seen[some]]})

    n = np.zeros(n_terms + 1)
    for r in kept.mapInPandas(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[r.term] = r.n  # the total is last
    idf = np.log((n[-1] + 2) / (n[:-1] + 1))
    return np.where(n[:-1] > COMMON * max(n[-1], 1), 0, idf)


def _directions(kept: DataFrame, weight: np.ndarray, own: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the weighted rows of these half passages and of the items (own)."""
    rank = min(rank, len(weight))
    wide = min(rank + OVER, len(weight))
    test = np.random.default_rng(11).normal(size=(len(weight), wide)).astype(np.float32)
    shared = kept.sparkSession.sparkContext.broadcast((weight.astype(np.float32), test))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weight, test = shared.value
        out = np.zeros(test.shape, np.float32)
        for _, held in _parts(frames):
            half, term, count = held.cells(len(weight))
            use = weight[term] > 0
            half, term, value = half[use], term[use], (count[use] * weight[term[use]]).astype(np.float32)
            if not len(half):
                continue
            _, y = _products(test, term, value, half)
            row = np.cumsum(np.r_[0, np.diff(half) != 0])
            order = np.argsort(term, kind="stable")
            which, z = _products(y, row[order], value[order], term[order])
            out[which] += z
        for k in range(0, len(out), _CHUNK):
            part = out[k : k + _CHUNK]
            if part.any():
                yield pd.DataFrame({"chunk": [k // _CHUNK], "sums": [part.tobytes()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "sums": [np.sum([np.frombuffer(b, np.float32).astype(np.float64) for b in frame["sums"]], axis=0).tobytes()]})

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # sums of a few partial ones before they are gathered
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for k, b in zip(frame["chunk"], frame["sums"], strict=True):
                x = np.frombuffer(b, np.float32).astype(np.float64)
                held[k] = held[k] + x if k in held else x
        yield pd.DataFrame({"chunk": list(held), "sums": [v.tobytes() for v in held.values()]})

    parts = kept.mapInPandas(multiply, "chunk int, sums binary")
    total = np.zeros(test.shape)
    for r in parts.repartition("chunk").mapInPandas(fold, "chunk int, sums binary").collect():
        total[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] += np.frombuffer(r.sums).reshape(-1, wide)
    # The trace of A'A, estimated from the same products, is what the passages weigh; the items together weigh as much.
    energy = float((test * total).sum()) / wide
    total += max(1.0, energy / max(float((own**2).sum()), 1e-30)) * (own.T @ (own @ test.astype(np.float64)))
    # Nystroem: A'A is close to Y (X'Y)^-1 Y' for Y = A'A X, so the left singular vectors of Y (X'Y)^-1/2 are A's right ones.
    shift = 1e-7 * max(float(np.linalg.norm(total)), 1e-30)
    total = total + shift * test
    core = test.T.astype(np.float64) @ total
    value, vector = np.linalg.eigh((core + core.T) / 2)
    keep = value > 1e-10 * max(value.max(), 1e-30)
    u, _, _ = np.linalg.svd(total @ (vector[:, keep] / np.sqrt(value[keep])), full_matrices=False)
    return u[:, :rank]


def _search(documents: DataFrame, items: list[np.ndarray], names: list[int], answers: int = ANSWER) -> DataFrame:
    terms = Terms(items)
    kept = saved(_kept(documents, terms), "benchmark-words")
    weight = _weights(kept, len(terms))
    own, items = np.zeros((len(items), len(terms))), [np.searchsorted(terms.hashes, item) for item in items]
    for k, item in enumerate(items):
        np.add.at(own[k], item, 1)
    bare = (own * weight).sum(1) == 0
    if bare.any():  # an item of common terms only
        weight = np.where((own[bare] > 0).any(0) & (weight == 0), 0.1, weight)
    own *= weight
    base = _directions(kept.where("length(at) > 0"), weight, own)
    latent = own @ base
    # By the square of what the directions keep of an item over its length: a verbatim passage has cosine 1 however little that is.
    latent *= np.linalg.norm(own, axis=1, keepdims=True) / np.maximum((latent**2).sum(1, keepdims=True), 1e-12)
    shared = documents.sparkSession.sparkContext.broadcast(((base * weight[:, None]).astype(np.float32), latent.T.astype(np.float32), weight, items, names))

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, latent, weight, items, names = shared.value
        used = weight > 0
        flags = np.zeros((len(items), len(used)), bool)
        for k, item in enumerate(items):
            flags[k, item] = True
        for ids, held in _parts(frames):
            half, term, count = held.cells(len(used))
            use = used[term]
            half, term, count = half[use], term[use], count[use]
            if not len(half):
                continue
            filled, y = _products(base, term, count.astype(np.float32), half)
            # Passage p is the half passages p and p + 1 of one text; one that begins before a filled half is that half alone.
            text = np.searchsorted(held.halves, filled, "right") - 1
            follow = np.flatnonzero((filled[1:] == filled[:-1] + 1) & (text[1:] == text[:-1]))
            size = np.add.reduceat((count * weight[term]) ** 2, _begins(half))
            y[follow] += y[follow + 1]
            size[follow] += size[follow + 1]
            y /= np.sqrt(np.maximum(size, 1e-12))[:, None]  # by the whole row's length, so what the directions miss counts against it
            p, k = np.nonzero(y @ latent >= COSINE)
            done: dict[tuple[int, int], tuple[float, float, float]] = {}
            for a, b in zip(p.tolist(), k.tolist(), strict=True):
                d, item = int(text[a]), items[b]
                lo, hi = int(held.bounds[d]), int(held.bounds[d + 1])
                start = int(filled[a] - held.halves[d]) * HALF
                i, j = np.searchsorted(held.at[lo:hi], (start - HALF - len(item), start + 2 * HALF + len(item))) + lo
                around = held.term[i:j]
                around = around[flags[b][around]]
                if len(around) < SHARE * len(item):
                    continue
                share = common_length(item, around) / len(item)
                if share < SHARE:
                    continue
                end = item[-answers:]
                answer = common_length(end, around) / len(end)
                if share >= SURE or answer >= ANSWER_SHARE:
                    done[d, b] = max(done.get((d, b), (0.0, 0.0, 0.0)), (share, answer, float(y[a] @ latent[:, b])))
            yield pd.DataFrame([(ids[d], names[b], *v) for (d, b), v in done.items()], columns=["doc_id", "item_id", "overlap", "answer_overlap", "cosine"], dtype=object)

    return map_frames(kept.where("length(at) > 0"), look, "doc_id long, item_id long, overlap double, answer_overlap double, cosine double")


def contaminated(documents: DataFrame, benchmark: DataFrame, most: int = ITEMS) -> DataFrame:
    """doc_id, item_id, overlap, answer_overlap, cosine of every document and item that it holds."""
    docs, spark = documents.select("doc_id", "text"), documents.sparkSession
    known = benchmark.where("text is not null").select("item_id", "text").distinct()
    # Every distinct item falls into one part by a hash of its id and text, so equal ids and null ids lose none; parts hold 0.9 * most on average.
    parts = max(1, -(-known.count() * 10 // (most * 9)))
    out = spark.createDataFrame([], "doc_id long, item_id long, overlap double, answer_overlap double, cosine double")
    for k in range(parts):
        got = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).orderBy("item_id", "text").collect()
        w = words([r.text for r in got])
        items = [w.hash[a:b] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        real = [i for i, x in enumerate(items) if len(x)]
        if real:
            with scratch(spark) as keep:
                out = out.unionByName(keep(_search(docs, [items[i] for i in real], [got[i].item_id for i in real]), "leaks"))
    best = F.max(F.struct("overlap", "answer_overlap", "cosine")).alias("b")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def remove_contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents that hold no item; rows without an id stay."""
    bad = contaminated(documents, benchmark).select("doc_id").distinct()
    return documents.join(bad, "doc_id", "left_anti")


def op8_benchmark_leaks(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    got = contaminated(docs, items)
    return got.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"), F.round("answer_overlap", 6).alias("answer_overlap"), F.round("cosine", 3).alias("cosine"))
