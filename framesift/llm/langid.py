"""Language ID: the mean of hashed subword embeddings under a linear softmax.

Subwords are the runs of 2, 3 and 4 bytes of the lower-cased text, with everything between words seen as one
kind of byte. Embeddings and softmax weights are trained together by stochastic gradient descent in numpy on a
bounded sample of labelled documents; part of that sample sets the softmax temperature and the score below which a
prediction is rejected. As everything after the mean is linear, a task only looks up one row of class logits per
subword and takes their mean over the whole text.

Defined results: null texts and texts without a letter get `und` with score 0 and are rejected; without labelled rows
every text gets `und`; equal scores go to the language first in alphabetical order; repeated rows and rows without an id
are judged as often as they occur; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.storage import map_frames
from framesift.llm.words import blocks, mix

BUCKETS, DIM, SIZES = 1 << 13, 16, (2, 3, 4)
#: Most training documents for each language and in all, and their longest text in characters.
TRAIN_EACH, TRAIN_ALL, TRAIN_CHARS = 400, 2400, 60_000
#: Parts of a language's documents, by a hash, that are ranked apart first, each for four times its share of the sample, so that a
#: frequent language isn't one task's work.
SALTS = 32
#: Among accepted texts of the calibration part, this share at least must be right.
PRECISION = 0.995
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.full(256, 32, np.uint64)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords, and at [t] : [t + 1] of the second array the part of text t. Each text gets a blank at both ends."""
    coded = [b" " + (t or "").lower().encode("utf-8", "replace") + b" \0\0\0" for t in texts]
    raw = np.frombuffer(b"".join(coded), np.uint8)
    folded = _FOLD[raw]
    ends = np.cumsum([len(c) for c in coded])
    n, out = len(raw) - 3, []
    value = folded[:n].copy()
    for k in range(2, max(SIZES) + 1):
        value = value * np.uint64(0x100000001B3) + folded[k - 1 : n + k - 1]
        if k in SIZES:
            b = (mix(value, k) >> np.uint64(20)).astype(np.int32) & (BUCKETS - 1)
            blank = folded[:n] == 32
            for j in range(1, k):
                blank &= folded[j : n + j] == 32
            b[blank] = BUCKETS  # no subword
            out.append(b)
    grid = np.stack(out, 1)
    for j in range(1, 4):  # the marks after a text belong to none
        grid[ends[:-1] - j] = BUCKETS
    return grid.ravel(), np.r_[0, ends[:-1], n] * len(SIZES)


class Model:
    def __init__(self, langs: list[str]) -> None:
        self.langs, self.logits, self.bias, self.heat, self.floor = langs, np.zeros((BUCKETS + 1, len(langs)), np.float32), np.zeros(len(langs)), 1.0, 0.0

    def raw(self, texts: list[str]) -> np.ndarray:
        """Class logits of each text before calibration."""
        out = np.zeros((len(texts), len(self.langs)))
        if not texts or not self.langs:
            return out
        b, at = subwords(texts)
        n = np.add.reduceat((b < BUCKETS).astype(np.int64), at[:-1])
        for k in range(len(self.langs)):
            out[:, k] = np.add.reduceat(self.logits[:, k][b], at[:-1], dtype=np.float64)
        return out / np.maximum(n, 1)[:, None] + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        x = self.raw(texts) * self.heat
        e = np.exp(x - x.max(1, keepdims=True)) if x.size else x
        return e / e.sum(1, keepdims=True) if x.size else x


def _means(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for i, t in enumerate(texts):
        b, _ = subwords([t])
        b = b[b < BUCKETS]
        if len(b):
            out[i] = np.bincount(b, minlength=BUCKETS) / len(b)
    return out


def train(texts: list[str], langs: list[str], epochs: int = 12, seed: int = 7) -> Model:
    """SGD on whole texts and on short random pieces of them; every fifth text calibrates."""
    model = Model(sorted(set(langs)))
    if len(model.langs) < 2:
        model.bias[:] = 1
        return model
    rng = np.random.default_rng(seed)
    y = np.array([model.langs.index(v) for v in langs])
    pieces, of = [], []
    for i, t in enumerate(texts):
        w = t.split()
        for size in (int(rng.integers(1, 4)), int(rng.integers(4, 25))):
            k = int(rng.integers(0, max(1, len(w) - size)))
            pieces.append(" ".join(w[k : k + size]))
            of.append(i)
    x, y = np.concatenate([_means(texts), _means(pieces)]), np.r_[y, y[of]]
    hold = np.r_[np.arange(len(texts)), of] % 5 == 4
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(model.langs)), np.float32), np.zeros(len(model.langs), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    rows = np.flatnonzero(~hold)
    weight = len(rows) / np.bincount(y[rows], minlength=len(model.langs)).clip(1) / len(model.langs)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 32)):
            h = x[part] @ emb
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            p *= weight[y[part]][:, None] / len(part)
            back = x[part].T @ (p @ out.T)
            out -= 4.0 * rate * (h.T @ p)
            bias -= 0.1 * rate * p.sum(0)
            emb -= 400.0 * rate * back
    model.logits[:BUCKETS], model.bias = emb @ out, bias.astype(np.float64)
    z, t = x[hold] @ model.logits[:BUCKETS] + model.bias, y[hold]
    if not len(t):
        return model

    def loss(heat: float) -> float:
        s = z * heat
        return float(np.mean(np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(t)), t]))

    model.heat = min(np.geomspace(0.1, 10, 41), key=loss)
    p = np.exp(z * model.heat - (z * model.heat).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    order = np.argsort(-p.max(1), kind="stable")
    right = np.cumsum((p.argmax(1) == t)[order]) / np.arange(1, len(t) + 1)
    good = np.flatnonzero(right >= PRECISION)
    model.floor = float(p.max(1)[order[good[-1]]]) if len(good) else 1.0
    return model


def fit(documents: DataFrame, each: int = TRAIN_EACH, most: int = TRAIN_ALL) -> Model:
    """A model from at most `each` documents of each language and `most` in all, chosen by a hash of the text."""
    known = documents.where(F.col("lang").isNotNull() & F.length("text").between(1, TRAIN_CHARS)).select("doc_id", "lang", F.xxhash64("text").alias("h"))
    salt = F.pmod("h", F.lit(SALTS)).alias("salt")
    first = known.select("*", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))).where(F.col("rank") <= max(1, 4 * each // SALTS))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))  # over 4 * each rows of a language at most
    some = first.drop("rank", "salt").withColumn("rank", rank).where(F.col("rank") <= each).orderBy("rank", "lang").limit(most).select("doc_id", "h", F.col("lang").alias("as_lang"))
    got = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.xxhash64("text") == F.col("h")).select("text", "as_lang").distinct().orderBy("as_lang", "text").collect()
    got = [r for r in got if _LETTER.search(r.text)]
    return train([r.text for r in got], [r.as_lang for r in got])


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (calibrated), rejected of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for frame in frames:
            texts = frame["text"].tolist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for at, block in blocks(texts) if m.langs else ():
                p = m.scores(block)
                for i, t in enumerate(block):
                    if _LETTER.search(t):
                        k = int(p[i].argmax())
                        lang[at + i], score[at + i] = m.langs[k], p[i, k]
            yield pd.DataFrame({"doc_id": frame["doc_id"].array, "lang_pred": lang, "score": score, "rejected": score < max(m.floor, 1e-12)})

    return map_frames(documents.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, rejected boolean")


def held_out(name: str = "doc_id"):
    return F.crc32(F.col(name).cast("string")) % 5 == 0


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
