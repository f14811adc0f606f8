"""Hard-negative mining by blocked dense products.

Anchors are dealt out evenly into blocks of a bounded number of rows. Each block is broadcast, and every task multiplies it
with its candidates, a batch at a time, in float64: components are whole numbers, so products are exact below 2 ** 53, and
where a batch could pass that bound it is multiplied with Python's whole numbers. A task keeps the best of each anchor and
gives them once, at its end; these lists are merged by an aggregate. The first pass finds the positives, the second
one, with the positives' scores broadcast beside the anchors, the negatives in each positive's window.

A row takes part if its id and label are there and its vector has no null and no non-finite component.

Defined results: no vectors, no anchors or no other rows give no rows; vectors of several lengths are compared as if zeros
followed the shorter one; an empty vector has score 0 with any; rows with an anchor's own id are never its positives or
negatives; repeated rows count as often as they occur, as candidates and as anchors; scores beyond 64 bits are cut to 64 bits; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.storage import saved, scratch

#: Anchors of one broadcast block; bytes of its vectors, at most about; positives of an anchor; negatives of a positive.
ANCHORS, BLOCK_BYTES, POSITIVES, NEGATIVES = 65_536, 64 << 20, 5, 3
#: Products of one step, about.
CELLS = 2_000_000
#: A place that no row has.
NONE = np.int64(np.iinfo(np.int64).min)


def prepared(rows: DataFrame, scale: int = 256, turned: int | None = 7, labels: int = 10) -> DataFrame:
    """vec_id, label, v (array<double> of whole numbers) of the rows that take part. Where vec_id is divisible by `turned`, the label is the next of `labels`."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("double"))
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    label = F.col("label").cast("long")
    if turned:
        label = F.when(F.col("vec_id") % turned == 0, (label + 1) % labels).otherwise(label)
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("v"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """The vectors as rows, with zeros after those shorter than the longest (or than `width`)."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
    size = np.diff(offsets)
    out = np.zeros((len(size), max(width, int(size.max(initial=0)))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - offsets[row]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows, as float64 where that is exact and else as 64-bit numbers."""
    d = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(d, 1) < 2.0**53:
        return a @ b.T
    whole = [np.array([[int(c) for c in r] for r in x], object).reshape(x.shape) for x in (a, b)]
    return np.clip(whole[0] @ whole[1].T, int(NONE) + 1, 2**63 - 1).astype(np.int64)


def merged(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of the last axis: higher scores, then smaller ids; a score of NONE is no entry."""
    turned = np.where(score == NONE, np.int64(2**63 - 1), -np.where(score == NONE, 0, score))
    order = np.lexsort((ids, turned), axis=-1)[..., :k]
    return np.take_along_axis(score, order, -1), np.take_along_axis(ids, order, -1)


def best(score: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best allowed columns of each row; columns are in the order of ids, so the first of equals has the least id."""
    k = min(k, score.shape[1])
    out = np.full((len(score), k), NONE), np.zeros((len(score), k), np.int64)
    low = -np.inf if score.dtype.kind == "f" else NONE
    left, busy = np.where(allowed, score, low), np.flatnonzero(allowed.any(1))
    for j in range(k):
        at = left[busy].argmax(1)
        got = left[busy, at]
        busy, at, got = busy[real := got > low], at[real], got[real]
        out[0][busy, j], out[1][busy, j] = got.astype(np.int64), ids[at]
        left[busy, at] = low
    return out


class _Block:
    """Anchors of a block as arrays: key, id, label, x, and (in the second pass) the positives' scores."""

    def __init__(self, table: pa.Table):
        held = table.combine_chunks().sort_by("key")
        column = lambda c: held.column(c).combine_chunks()
        self.key, self.id, self.label = (column(c).to_numpy() for c in ("key", "vec_id", "label"))
        self.x = matrix(column("v"))
        self.positive = np.full((len(self.key), POSITIVES), NONE)


def _search(candidates: DataFrame, block: _Block, k: int, windows: tuple[int, int] | None) -> DataFrame:
    """key, nth, id, score: of each anchor (and, with windows, of each of its positives, nth) the best k of each task."""
    shared = candidates.sparkSession.sparkContext.broadcast(block)
    sets = POSITIVES if windows else 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        kept_score, kept_id = np.full((len(b.key), sets, k), NONE), np.zeros((len(b.key), sets, k), np.int64)
        if windows:
            low, high = windows
            p = np.where(b.positive == NONE, 0, b.positive).astype(object)
            least = np.array(-((-low * p) // 100), np.float64 if np.abs(b.positive[b.positive != NONE]).max(initial=0) < 2**53 else np.int64)
            most = np.array((high * p) // 100, least.dtype)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, label, x = ids[order], batch.column(1).to_numpy()[order], matrix(batch.column(2))[order]
            step = max(1, CELLS // max(1, len(ids)))
            for at in range(0, len(b.key), step):
                some = slice(at, at + step)
                score = products(b.x[some], x)
                same = b.label[some, None] == label[None, :]
                if not windows:
                    found = [best(score, same & (b.id[some, None] != ids[None, :]), ids, k)]
                else:
                    other = ~same & (b.id[some, None] != ids[None, :])
                    found = [best(score, other & (score >= least[some, j, None]) & (score <= most[some, j, None]) & (b.positive[some, j, None] != NONE), ids, k) for j in range(sets)]
                for j, (s, i) in enumerate(found):
                    kept_score[some, j], kept_id[some, j] = merged(np.concatenate([kept_score[some, j], s], 1), np.concatenate([kept_id[some, j], i], 1), k)
        a, j, r = np.nonzero(kept_score != NONE)
        for at in range(0, len(a), 50_000):
            part = slice(at, at + 50_000)
            arrays = [b.key[a[part]], j[part].astype(np.int32), kept_id[a[part], j[part], r[part]], kept_score[a[part], j[part], r[part]]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["key", "nth", "id", "score"])

    return candidates.mapInArrow(work, "key long, nth int, id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of all tasks' lists, with their rank from 1."""
    order = Window.partitionBy("key", "nth").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 50, negatives: int = NEGATIVES, window: tuple[int, int] = (50, 95), most: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: vec_id, label, v as `prepared` gives. Anchors are the rows whose id is divisible by `every`; a positive's negatives have
    a score of window[0] to window[1] hundredths of its own."""
    with scratch(rows.sparkSession) as keep:
        anchors = rows.where(F.col("vec_id") % every == 0)
        n, width = anchors.agg(F.count("*"), F.max(F.size("v"))).first()
        size = max(1, min(most, BLOCK_BYTES // (8 * max(width or 1, 1))))
        parts = max(1, -(-n // size))
        # Dealt out in turn, so blocks are even whatever the ids are; a row's key is its place in the written table.
        held = saved(anchors.repartition(parts).withColumn("key", F.monotonically_increasing_id()), "anchors")
        results = None
        for i in [r.i for r in held.select(F.shiftright("key", 33).alias("i")).distinct().collect()]:
            block = _Block(held.where(F.shiftright("key", 33) == i).toArrow())
            positives = saved(_ranked(_search(rows, block, POSITIVES, None), POSITIVES), "positives")
            got = positives.select("key", "rank", "score").toArrow().to_pandas()
            block.positive[np.searchsorted(block.key, got["key"].to_numpy()), got["rank"].to_numpy() - 1] = got["score"].to_numpy()
            found = _ranked(_search(rows, block, negatives, window), negatives)
            own = positives.select("key", (F.col("rank") - 1).alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            both = found.withColumnRenamed("id", "negative_id").withColumnRenamed("score", "negative_score").join(own, ["key", "nth"]).join(held.select("key", F.col("vec_id").alias("anchor_id")), "key")
            made = keep(both.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"), "negatives")
            results = made if results is None else results.unionByName(made)
        if results is None:
            return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        return results


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """The first three hard negatives of each anchor and positive of the embeddings."""
    return hard_negatives(prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


OP13_SQL = """
with held as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
  from held a join held b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, other as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over w::int as rank, other as negative_id, positive_score, score as negative_score
from positives p join scored s using (anchor_id)
where not s.same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
window w as (partition by anchor_id, positive_id order by score desc, other)
qualify row_number() over w <= 3
"""
