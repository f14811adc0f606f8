"""Toxicity: a linear-chain conditional random field over words.

Labelled tokens come from labelled documents: in a toxic document a word is tagged toxic if it, or its beginning, occurs
nearly only in toxic documents; every other word is tagged clean. The field has two tags, hashed features of the word
and its beginnings, and four transition weights, and is trained by gradient ascent on the log-likelihood of the tags
(toxic documents weigh more), with exact single and pairwise marginals. All labelled texts train it: tasks sum counts and
gradients, the driver holds the weights. Exact forward-backward marginals of each word
follow for every document: the document's score is the largest marginal and the offending spans are the words whose
marginal passes a threshold.

Spark deals out documents; a task works on blocks of at most 200,000 characters (a longer text is one). Forward-backward
over a block is a scan of 2 x 2 matrices, so that no Python code runs per word.

Defined results: null and empty texts score 0 and have no spans; a repeated row is scored as often as it occurs; without
labelled rows of both classes the field stays untrained and every score is under 0.01; rows without an id are scored too but never train; further columns of
the inputs are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.storage import by_bytes, filter_rows, map_frames, saved, scratch
from framesift.llm.words import Words, blocks, mix, prefixes, words

#: Features of a word: itself and its first 3 to 6 bytes, hashed into BUCKETS weights.
BUCKETS = 1 << 20
SIZES = (3, 4, 5, 6)
#: Rounds of training; parts of the labelled texts that take turns, and texts of a part at least.
ROUNDS, PARTS, LEAST = 30, 15, 2400
#: Weight of a toxic document's log-likelihood in training, against 1 of a clean one.
TOXIC_WEIGHT = 3.0
#: A feature can mark toxic words if it is in so many toxic documents (of FEW; of more in proportion) and their share (smoothed) is so large. Of these,
#: the ones that explain documents not yet explained are taken first to last, and besides those in a part COMMON of them.
SUPPORT, FEW, SHARE, COMMON = 3, 800, 0.97, 0.05
#: Features that a pass of the cover looks at together.
TOP = 16


def features(w: Words) -> np.ndarray:
    """Bucket of every feature of every word, shape (features, words)."""
    mask = np.uint64(BUCKETS - 1)
    return np.stack([(mix(h, 11) & mask).astype(np.int32) for h in (w.hash, *prefixes(w, SIZES))])


def _scan(emit: np.ndarray, first: np.ndarray, move: np.ndarray, begin: float) -> np.ndarray:
    """Ratio of the forward weights toxic / clean after each word. emit: toxic against clean; first: a text begins."""
    n = len(emit)
    rows = max(1, int(np.sqrt(n)))
    cols = -(-n // rows)
    e = np.ones(rows * cols)
    e[:n] = emit
    f = np.zeros(rows * cols, bool)
    f[:n] = first
    e, f = np.ascontiguousarray(e.reshape(cols, rows).T), np.ascontiguousarray(f.reshape(cols, rows).T)
    m00, m01, m10, m11 = move.ravel()
    p00, p01, p10, p11 = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for i in range(rows):  # the product of each column's matrices
        a, b, c, d = np.where(f[i], 1.0, m00), np.where(f[i], begin, m01), np.where(f[i], 1.0, m10), np.where(f[i], begin, m11)
        b, d = b * e[i], d * e[i]
        p00, p01, p10, p11 = p00 * a + p01 * c, p00 * b + p01 * d, p10 * a + p11 * c, p10 * b + p11 * d
        s = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / s, p01 / s, p10 / s, p11 / s
    start, x, y = np.empty(cols), 1.0, 0.0
    for c in range(cols):
        start[c] = y / max(x, 1e-300)
        x, y = x * p00[c] + y * p10[c], x * p01[c] + y * p11[c]
        x, y = x / (x + y), y / (x + y)
    out, r = np.empty((rows, cols)), start
    for i in range(rows):
        r = np.where(f[i], begin, (m01 + m11 * r) / (m00 + m10 * r)) * e[i]
        r = np.clip(r, 1e-30, 1e30)
        out[i] = r
    return out.T.ravel()[:n]


def _both_ways(emit: np.ndarray, bounds: np.ndarray, move: np.ndarray, begin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ratios toxic / clean of the weights before and with each word, and after it; and where texts begin."""
    n = len(emit)
    at = np.unique(bounds[:-1])
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[at[at < n]] = True
    last[np.r_[at[(at < n) & (at > 0)] - 1, n - 1]] = True
    ahead = _scan(emit, first, move, begin)
    # The backward weights obey the same recursion on the reversed words, except that a word's own weight comes last.
    back = _scan(emit[::-1], last[::-1], move.T, 1.0)[::-1]
    after = np.ones(n)
    nxt = back[1:]
    after[:-1] = np.where(last[:-1], 1.0, (move[1, 0] + move[1, 1] * nxt) / (move[0, 0] + move[0, 1] * nxt))
    return ahead, after, first


def marginals(emit: np.ndarray, bounds: np.ndarray, move: np.ndarray, begin: float) -> np.ndarray:
    """Probability of the toxic tag for each word. move[i, j]: weight of tag j after tag i; bounds: of the texts."""
    if not len(emit):
        return np.zeros(0)
    ahead, after, _ = _both_ways(emit, bounds, move, begin)
    odds = ahead * after
    return odds / (1 + odds)


class Gradient(NamedTuple):
    """Of the log-likelihood of tags: word (for the emission weight of each word), trans (2 x 2), bias and begin."""

    word: np.ndarray
    trans: np.ndarray
    bias: float
    begin: float


def gradient(emit: np.ndarray, tag: np.ndarray, bounds: np.ndarray, trans: np.ndarray, begin: float, weight: np.ndarray) -> Gradient:
    """Exact gradient of the sum over texts of weight times the log-likelihood of its tags. trans, begin: log weights;
    weight: for each word, the same for all words of a text."""
    move = np.exp(trans)
    ahead, after, first = _both_ways(emit, bounds, move, float(np.exp(begin)))
    p = ahead * after / (1 + ahead * after)
    word = (tag - p) * weight
    second = np.flatnonzero(~first)  # words with one before them in their text
    x, y = ahead[second - 1], (emit * after)[second]
    pair = np.stack([np.full(len(second), move[0, 0]), move[0, 1] * y, move[1, 0] * x, move[1, 1] * x * y])
    pair *= weight[second] / pair.sum(0)
    kind = tag[second - 1].astype(int) * 2 + tag[second]
    seen = np.bincount(kind, weight[second], 4)
    return Gradient(word, (seen - pair.sum(1)).reshape(2, 2), float(word.sum()), float(word[first].sum()))


class Field:
    """weight: of each bucket; bias: of the toxic tag; trans: 2 x 2 log weights; begin: of the toxic tag at the start."""

    def __init__(self) -> None:
        self.weight, self.bias, self.trans, self.begin = np.zeros(BUCKETS, np.float32), -6.0, np.zeros((2, 2)), -2.0

    def emit(self, f: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(self.weight[f].sum(0, dtype=np.float64) + self.bias, -30, 30))

    def tag(self, w: Words) -> np.ndarray:
        return marginals(self.emit(features(w)), w.bounds, np.exp(self.trans), float(np.exp(self.begin)))


def _coded(texts: list, toxic: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """features, bounds of the texts, text of each word and whether each text is toxic, by blocks of texts."""
    for at, block in blocks(texts):
        w = words(block)
        yield features(w), w.bounds, np.repeat(np.arange(len(block)), np.diff(w.bounds)), toxic[at : at + len(block)]


class Counts:
    """In how many toxic documents each feature is, of whatever kind, and in how many clean ones as a feature of each kind."""

    def __init__(self) -> None:
        self.bad, self.good = np.zeros(BUCKETS, np.int64), np.zeros((1 + len(SIZES), BUCKETS), np.int64)

    def add(self, texts: list, toxic: np.ndarray) -> None:
        for f, _, doc, bad in _coded(texts, toxic):
            base = doc.astype(np.int64) * BUCKETS
            is_bad = bad[doc]
            for k, one in enumerate(f):
                np.add.at(self.good[k], np.unique((base + one)[~is_bad]) % BUCKETS, 1)
            np.add.at(self.bad, np.unique((base + f)[:, is_bad]) % BUCKETS, 1)


def _support(n_toxic: int) -> float:
    return SUPPORT * max(1.0, n_toxic / FEW)


def _fit_for(bad: np.ndarray, good: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    part = bad / n_toxic
    return (bad >= _support(n_toxic)) & (part / (part + (good + 0.2) / n_clean) >= SHARE)


def _step(f: np.ndarray, bounds: np.ndarray, doc: np.ndarray, toxic: np.ndarray, taken: np.ndarray, field: Field, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Gradient of a block: for each bucket, and of transitions, bias and begin."""
    tag = toxic[doc] & taken[f].any(0)
    seen = f if whole else f[1:3]
    d = gradient(field.emit(seen), tag, bounds, field.trans, field.begin, np.where(toxic, TOXIC_WEIGHT, 1.0)[doc])
    g = np.zeros(BUCKETS)
    for one in seen:
        g += np.bincount(one, d.word, BUCKETS)
    return g, np.r_[d.trans.ravel(), d.bias, d.begin]


class Ascent:
    """A field and the squared gradients so far."""

    def __init__(self) -> None:
        self.field, self.grad2, self.small = Field(), np.full(BUCKETS, 1e-6), np.full(6, 1e-6)

    def move(self, g: np.ndarray, step: np.ndarray) -> None:
        field = self.field
        g = g - 1e-2 * field.weight
        self.grad2 += g * g
        field.weight = (field.weight + 0.5 * g / np.sqrt(self.grad2)).astype(np.float32)
        self.small += step * step
        step = 0.2 * step / np.sqrt(self.small)
        field.trans = field.trans + step[:4].reshape(2, 2) - 0.01 * field.trans
        field.bias += step[4]
        field.begin += step[5]


def train(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS) -> Field:
    """As fit() does, for a few texts in memory. One class alone gives the untrained field."""
    toxic = np.asarray(toxic, bool)
    if toxic.all() or not toxic.any():
        return Field()
    n = Counts()
    n.add(texts, toxic)
    good = n.good.max(0)
    fit_for = _fit_for(n.bad, good, int(toxic.sum()), int((~toxic).sum()))
    held = list(_coded(texts, toxic))
    sets = [np.unique(f[:, doc == k]) for f, _, doc, bad in held for k in np.flatnonzero(bad)]
    sets = [x[fit_for[x]] for x in sets]
    taken = fit_for & (n.bad >= COMMON * toxic.sum()) & (good == 0)
    left = sets
    while left:
        score = np.bincount(np.concatenate(left), minlength=BUCKETS) - 0.25 * good
        best = int(np.where(fit_for, score, -np.inf).argmax())
        if score[best] < _support(int(toxic.sum())):
            break
        taken[best] = True
        left = [x for x in left if best not in x]
    ascent = Ascent()
    for k in range(rounds):
        got = [_step(*x, taken, ascent.field, bool(k % 2)) for x in held]
        ascent.move(sum(g for g, _ in got), sum(s for _, s in got))
    return ascent.field


def _labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of every labelled text, equal texts once."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    docs = documents.select("doc_id", F.xxhash64("text").alias("k"), "text").where(F.length("text") > 0)
    once = docs.select("doc_id", "k").join(known, "doc_id").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    return docs.join(once, ["doc_id", "k"]).dropDuplicates(["doc_id", "k"]).select("doc_id", "text", "toxic")


def _marks(held: DataFrame, n_toxic: int, n_clean: int) -> np.ndarray:
    """Which features mark toxic words, learned from all documents: a greedy cover of the toxic ones.

    A pass of the cover looks at the TOP features that explain most. How often these stand together says what the greedy choice
    takes among them, and it is the choice among all features as long as it explains more than the next one did before."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = Counts()
        for frame in frames:
            n.add(frame["text"].tolist(), frame["toxic"].to_numpy(bool))
        for kind, x in enumerate([n.bad, *n.good]):
            at = np.flatnonzero(x)
            yield pd.DataFrame({"kind": kind, "what": at, "n": x[at]})

    by_kind = held.mapInPandas(count, "kind int, what int, n long").groupBy("what", "kind").agg(F.sum("n").alias("n"))
    both = by_kind.groupBy("what").agg(F.max(F.when(F.col("kind") == 0, F.col("n"))).alias("bad"), F.max(F.when(F.col("kind") > 0, F.col("n"))).alias("good")).where(F.col("bad") >= SUPPORT)
    found = both.toArrow()  # BUCKETS rows at most
    what, bad, one = (found.column(c).to_numpy(zero_copy_only=False) for c in ("what", "bad", "good"))
    n, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS)
    n[what], good[what] = bad, np.nan_to_num(one.astype(float))
    fit_for = _fit_for(n, good, n_toxic, n_clean)
    shared = held.sparkSession.sparkContext.broadcast(fit_for)

    def choose(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for f, bounds, _, bad in _coded(frame["text"].tolist(), np.ones(len(frame), bool)):
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    x = np.unique(f[:, a:b])
                    rows.append(x[shared.value[x]].tolist())
            yield pd.DataFrame({"has": rows})

    sets = saved(held.where("toxic").mapInPandas(choose, "has array<int>").where(F.size("has") > 0), "toxic-features")
    taken, chosen = fit_for & (n >= COMMON * n_toxic) & (good == 0), []
    while True:
        left = sets.where(~F.arrays_overlap("has", F.array(*map(F.lit, chosen)))) if chosen else sets
        now = left.select(F.explode("has").alias("what")).groupBy("what").count().toArrow()
        what, score = now.column("what").to_numpy(), now.column("count").to_numpy().astype(float)
        score = score - 0.25 * good[what]
        order = np.lexsort((what, -score))
        top, rest = what[order[:TOP]], (score[order[TOP]], what[order[TOP]]) if len(order) > TOP else (-np.inf, 0)
        if not len(order) or score[order[0]] < _support(n_toxic):
            return taken
        mask = sum((F.when(F.array_contains("has", int(x)), 1 << k).otherwise(0) for k, x in enumerate(top)), F.lit(0))
        kinds = left.groupBy(mask.alias("mask")).count().where("mask > 0").toArrow()
        has = (kinds.column("mask").to_numpy()[:, None] >> np.arange(len(top))) & 1
        size = kinds.column("count").to_numpy().astype(float)
        while True:
            mine = size @ has - 0.25 * good[top]
            best = int(np.lexsort((top, -mine))[0])
            if mine[best] < _support(n_toxic) or (-mine[best], top[best]) > (-rest[0], rest[1]):
                break
            chosen.append(int(top[best]))
            taken[top[best]] = True
            size = np.where(has[:, best] > 0, 0, size)


def _gradient(held: DataFrame, taken, field: Field, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """Summed over all rows; in steps of 2**-24, so that the order of tasks changes nothing."""
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(field)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, small = np.zeros(BUCKETS), np.zeros(6)
        for frame in frames:
            for block in _coded(frame["text"].tolist(), frame["toxic"].to_numpy(bool)):
                one, step = _step(*block, taken.value, shared.value, whole)
                g += one
                small += step
        all_of = np.rint(np.r_[g, small] * 2.0**24).astype(np.int64)
        at = np.flatnonzero(all_of)
        yield pd.DataFrame({"what": at, "g": all_of[at]})

    got = held.select("text", "toxic").mapInPandas(run, "what int, g long").groupBy("what").agg(F.sum("g").alias("g")).toArrow()  # BUCKETS + 6 rows at most
    out = np.zeros(BUCKETS + 6)
    out[got.column("what").to_numpy()] = got.column("g").to_numpy() * 2.0**-24
    shared.destroy()
    return out[:BUCKETS], out[BUCKETS:]


def fit(documents: DataFrame, labels: DataFrame, rounds: int = ROUNDS, least: int = LEAST) -> Field:
    """A field from all labelled documents; equal texts count once.

    A document with several labels counts as toxic if one says so; null labels and null texts don't train. Texts are dealt out to
    PARTS parts (an odd number, fewer if a part had under `least` texts) by a hash of the id, and a round takes the next one. So
    every text is seen in whole-word and in other rounds."""
    with scratch(documents.sparkSession):
        part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))
        held = saved(_labelled(by_bytes(documents), labels).withColumn("part", part.cast("int")).sortWithinPartitions("part"), "labelled")
        n = {r.toxic: r["count"] for r in held.groupBy("toxic").count().collect()}
        if len(n) < 2:
            return Field()
        taken = documents.sparkSession.sparkContext.broadcast(_marks(held, n[True], n[False]))
        parts = next(k for k in (15, 5, 3, 1) if k == 1 or sum(n.values()) >= k * least)
        ascent, size = Ascent(), max(1.0, sum(n.values()) / parts / least)
        for k in range(rounds):
            # A round counts as much as one of `least` texts would, so that the weights are held back alike.
            g, small = _gradient(held.where(F.col("part") % parts == k % parts) if parts > 1 else held, taken, ascent.field, bool(k % 2))
            ascent.move(g / size, small / size)
        return ascent.field


def _offsets(text: str, marks: np.ndarray) -> list[tuple[int, int]]:
    """Character offsets in the text of the words whose numbers are in marks; touching words make one span."""
    out: list[tuple[int, int]] = []
    want, last = set(marks.tolist()), -2
    for k, m in enumerate(re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)):
        if k in want:
            if last == k - 1 and out:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
            last = k
    return out


def score(documents: DataFrame, field: Field, threshold: float = 0.5, batch: int = 200_000) -> DataFrame:
    """doc_id, score, n_offending, spans (array of start, end: character offsets, end exclusive) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = shared.value
        for frame in frames:
            texts, top, spans = frame["text"].tolist(), np.zeros(len(frame)), [[] for _ in range(len(frame))]
            for at, block in blocks(texts, batch):
                w = words(block)
                p = held.tag(w)
                full = np.flatnonzero(np.diff(w.bounds))
                if len(full):
                    top[at + full] = np.maximum.reduceat(p, w.bounds[:-1][full])
                hits = np.flatnonzero(p >= threshold)
                docs = np.searchsorted(w.bounds, hits, "right") - 1
                for d in np.unique(docs):
                    spans[at + d] = [{"start": a, "end": b} for a, b in _offsets(block[d], hits[docs == d] - w.bounds[d])]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "score": top, "n_offending": [len(s) for s in spans], "spans": spans})

    return map_frames(documents.select("doc_id", "text"), run, "doc_id long, score double, n_offending long, spans array<struct<start:long,end:long>>")


def clean(documents: DataFrame, field: Field, most: float) -> DataFrame:
    """The documents, all columns, that score less than `most`; they stay where they are, without a shuffle."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def keep(part: pa.RecordBatch) -> np.ndarray:
        out = np.ones(part.num_rows, bool)
        for at, block in blocks(part.column("text").to_pylist()):
            w = words(block)
            bad = np.flatnonzero(shared.value.tag(w) >= most)
            out[at + np.searchsorted(w.bounds, bad, "right") - 1] = False
        return out

    return filter_rows(documents, keep)


def held_out(name: str = "doc_id"):
    """True for the rows whose label must not be learned."""
    return F.crc32(F.col(name).cast("string")) % 3 == 1


def op1_toxicity_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    field = fit(docs.where(~held_out()), labels.where(~held_out()))
    out = score(docs, field)
    return out.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_offending", "spans")
