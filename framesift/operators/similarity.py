"""Nearest neighbours across videos, reference sets, votes.

Nearest neighbours are exact. Vectors are packed into blocks of bounded bytes, those near one pivot together. Blocks are
dealt to the cells of a grid: with G bands of blocks a block goes to G cells, not to every other block, and a cell compares all blocks
of its two bands. A task holds the blocks of one band, at most about HELD_BYTES of them, and takes those of the other one by one. Each two blocks
are products of tiles for both directions, in the vectors' own precision; a tile is reduced to what may be among the best, which is computed again in
float64. Two blocks too far apart are left out: chords between unit vectors are a metric, so the distance of two pivots less the radii of
their blocks bounds all similarities from above, and every vector knows from its own block what it has to beat. A few vectors that ask are sent to all rows instead.
The best of all cells are merged by an aggregate; nothing of the size of the table is broadcast, and no pair of rows is materialised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from framesift.functions import vectors

#: Vectors that are compared with references at once; decimals to which similarities are compared, so that equal vectors tie and the least id wins.
BLOCK, DECIMALS = 2048, 9
#: Bytes of a block's vectors; of those that a task holds; most pivots (they decide only which vectors share a block).
BLOCK_BYTES, HELD_BYTES, PIVOTS = 4 << 20, 256 << 20, 256
#: Rows and columns of a product that is looked at while it is in the caches; what each of them needs besides a vector, in bytes: to itself and for each of its best.
TILE, APIECE, A_BEST = (512, 2048), 40, 16
#: Part of a block's bytes up to which asking vectors are broadcast.
FEW = 4
#: Vectors among which pivots are chosen.
SAMPLED = 1024
#: Largest reference set that is broadcast.
MOST_BYTES = 64 << 20
#: Added to ids of references (from 0 on) where they share a table with rows: they stay in order and are below all others.
LOWEST = -(2**63)
#: Below every similarity: no neighbour.
NONE = -9.0


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


def _stacked(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class _Packed:
    """A block: ids and groups (in the order of groups), which ask, vectors, unit vectors in the same precision, and what the k-th best of each has at least."""

    def __init__(self, number: int, ids: np.ndarray, groups: np.ndarray, asks: np.ndarray, x: np.ndarray, floor: np.ndarray):
        self.number, self.ids, self.groups, self.asks, self.x, self.floor = number, ids, groups, asks, x, floor
        self.size = np.linalg.norm(x.astype(np.float64), axis=1)
        self.size[self.size == 0] = 1
        self.unit = (x / self.size[:, None]).astype(x.dtype)

    def exact(self, at: np.ndarray | slice) -> np.ndarray:
        return self.x[at].astype(np.float64) / self.size[at][:, None]


def _error(x: np.ndarray) -> float:
    """Bound of the error of products of unit vectors in the precision of x."""
    return (x.shape[1] + 8) * float(np.finfo(x.dtype).eps)


def _product(a: _Packed, rows: slice, b: _Packed, columns: slice) -> np.ndarray:
    """Similarities, NONE within a group: as both are in the order of groups, these are rectangles."""
    sim = a.unit[rows] @ b.unit[columns].T
    g, h = a.groups[rows], b.groups[columns]
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    ends = np.r_[starts[1:], len(g)]
    left, right = np.searchsorted(h, g[starts], "left"), np.searchsorted(h, g[starts], "right")
    for n in np.flatnonzero(left < right).tolist():
        sim[starts[n] : ends[n], left[n] : right[n]] = NONE
    return sim


def _ranked(row: np.ndarray, sim: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each of n rows from a list of entries: by falling similarity, then by id."""
    order = np.lexsort((ids, -sim, row))
    row, sim, ids = row[order], sim[order], ids[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out, top = (np.full((n, k), NONE), np.zeros((n, k), np.int64)), place < k
    out[0][row[top], place[top]], out[1][row[top], place[top]] = sim[top], ids[top]
    return out


class _Best:
    """The k best of a block's vectors so far: exact ones, and those found since, until there are as many again."""

    def __init__(self, a: _Packed, k: int):
        self.a, self.k, self.new, self.count, self.error = a, k, [], 0, _error(a.x)
        self.sim, self.ids = np.full((len(a.ids), k), NONE), np.zeros((len(a.ids), k), np.int64)

    def look(self, first: int, b: _Packed, start: int, sim: np.ndarray) -> None:
        """sim: products of vectors from `first` on with those of b from `start` on, whose last digits don't count. What may be among the best is computed again."""
        a, k, slack = self.a, self.k, 2 * self.error + 2 * 10.0**-DECIMALS
        top, low = sim.max(1), a.floor[first : first + len(sim)]
        rows = np.flatnonzero((top >= low - slack) & (top > NONE / 2) & a.asks[first : first + len(sim)])
        if not len(rows):
            return
        if k == 1:
            low[rows] = np.maximum(low[rows], top[rows] - self.error)
        some = sim[rows]
        r, c = np.nonzero(some >= np.maximum(low[rows] - slack, NONE / 2).astype(sim.dtype)[:, None])
        if len(r) <= 8 * k * len(rows) + 64:
            at, other, value, step = rows[r] + first, c + start, np.empty(len(r)), max(1, (1 << 18) // a.x.shape[1])
            for n in range(0, len(r), step):
                value[n : n + step] = np.einsum("ij,ij->i", a.exact(at[n : n + step]), b.exact(other[n : n + step]))
            self._add(at, b.ids[other], np.round(value, DECIMALS))
        else:  # many equal ones
            order = start + np.argsort(b.ids[start : start + sim.shape[1]])
            every = b.exact(order)
            for n in range(0, len(rows), 256):
                at = rows[n : n + 256] + first
                whole = np.where(some[n : n + 256, order - start] > NONE / 2, np.round(a.exact(at) @ every.T, DECIMALS), NONE)
                for _ in range(min(k, len(order))):
                    c = whole.argmax(1)  # of equals the first, which has the least id
                    value = whole[np.arange(len(at)), c]
                    self._add(at[value > NONE / 2], b.ids[order[c]][value > NONE / 2], value[value > NONE / 2])
                    whole[np.arange(len(at)), c] = NONE
        if self.count > self.sim.size:
            self.settle()

    def _add(self, *found: np.ndarray) -> None:
        self.new.append(found)
        self.count += len(found[0])

    def settle(self) -> None:
        if self.new:
            known = np.nonzero(self.sim > NONE / 2)
            row, ids, sim = (np.concatenate(x) for x in zip((known[0], self.ids[known], self.sim[known]), *self.new, strict=True))
            self.sim, self.ids = _ranked(row, sim, ids, len(self.a.ids), self.k)
            self.new, self.count = [], 0
            np.maximum(self.a.floor, self.sim[:, -1], out=self.a.floor)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        r, c = np.nonzero(self.sim > NONE / 2)
        for at in range(0, len(r), 50_000):
            x, y = r[at : at + 50_000], c[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.a.ids[x]), pa.array(self.ids[x, y]), pa.array(self.sim[x, y])], ["query", "match", "similarity"])


class _Nearest:
    """What a cell knows: its blocks and the best for each of their vectors."""

    def __init__(self, k: int, pivots: np.ndarray):
        self.k, self.pivots, self.kept, self.best, self.skipped, self.compared = k, pivots, {}, {}, 0, 0

    def add(self, b: _Packed, radius: float, pivot: int) -> None:
        self.kept[b.number], self.best[b.number] = (b, radius, pivot), _Best(b, self.k)

    def meet(self, one: int, other: int) -> None:
        (a, ra, pa_), (b, rb, pb) = self.kept[one], self.kept[other]
        if one != other:
            apart = np.linalg.norm(self.pivots[pa_] - self.pivots[pb]) - ra - rb
            most = 1 - max(apart - 1e-5, 0) ** 2 / 2 + 1e-5
            # Zero vectors have similarity 0 with any.
            if max(most, 0) < min(a.floor[a.asks].min(initial=9), b.floor[b.asks].min(initial=9)):
                self.skipped += len(a.ids) * len(b.ids)
                return
        self.compared += len(a.ids) * len(b.ids)
        to, back = bool(a.asks.any()), one != other and bool(b.asks.any())
        for i in range(0, len(a.ids), TILE[0]):
            for j in range(0, len(b.ids), TILE[1]):
                sim = _product(a, slice(i, i + TILE[0]), b, slice(j, j + TILE[1]))
                if to:
                    self.best[one].look(i, b, j, sim)
                if back:
                    self.best[other].look(j, a, i, sim.T)

    def leave(self, number: int) -> Iterator[pa.RecordBatch]:
        """Gives a block's results and forgets it."""
        del self.kept[number]
        yield from self.best.pop(number).rows()


def _blocks(rows: DataFrame, kind: type, pivots: np.ndarray, parts: np.ndarray, k: int) -> DataFrame:
    """A row for each block: its number, pivot and radius, and id, g, asks, v and floor as bytes."""
    base = np.r_[0, np.cumsum(parts)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = _assigned(_stacked(batch.column("v")), pivots)
            block = base[near] + batch.column("h").to_numpy().astype(np.uint64) % parts[near].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), pa.array(near.astype(np.int32)), *(batch.column(c) for c in ("id", "g", "asks", "v"))], ["block", "pivot", "id", "g", "asks", "v"])

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["g", "id"])
        x = np.stack(frame["v"].to_numpy()).astype(kind)
        b = _Packed(0, frame["id"].to_numpy(), frame["g"].to_numpy(), frame["asks"].to_numpy(), x, np.full(len(x), NONE))
        pivot = int(frame["pivot"].iloc[0])
        radius = float(np.linalg.norm(b.exact(slice(None)) - pivots[pivot], axis=1).max()) if len(pivots) > 1 else 2.0
        floor, parts = np.full(len(x), NONE), min(len(x), 4 * k)
        for at in range(0, len(x) if len(x) > k else 0, TILE[0]):
            own = _product(b, slice(at, at + TILE[0]), b, slice(0, len(x) // parts * parts))
            best = own.reshape(len(own), parts, -1).max(2)  # the k-th of the parts' best is at most the k-th of all
            floor[at : at + TILE[0]] = np.partition(best, parts - k, 1)[:, parts - k] - 2 * _error(x)
        data = [b.ids.astype(np.int64), b.groups.astype(np.int64), b.asks.astype(bool), x, np.where(floor < NONE / 2, NONE, floor)]
        return pd.DataFrame([[int(frame["block"].iloc[0]), pivot, radius, *(d.tobytes() for d in data)]], columns=["block", "pivot", "radius", "id", "g", "asks", "v", "floor"])

    vector = "array<float>" if kind is np.float32 else "array<double>"
    placed = rows.mapInArrow(place, f"block long, pivot int, id long, g long, asks boolean, v {vector}")
    return placed.groupBy("block").applyInPandas(pack, "block long, pivot int, radius double, id binary, g binary, asks binary, v binary, floor binary")


def bands_of(size: int, blocks: int, held: int, tasks: int) -> int:
    """Bands of a grid whose cells above the diagonal are enough for the tasks, with at most `held` bytes each; a block is dealt out so many times."""
    return max(1, min(blocks, max(-(-size // held), math.ceil((2 * tasks) ** 0.5))))


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """n of these unit vectors, each the farthest from those before."""
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    return x[chosen]


def _assigned(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The nearest pivot of each vector."""
    return (_unit(x.astype(np.float64)) @ pivots.T).argmax(1) if len(pivots) > 1 else np.zeros(len(x), np.int64)


def nearest_other(
    frames: DataFrame, k: int = 1, id_col: str = "vec_id", group_col: str = "video", queries: DataFrame | None = None,
    block_bytes: int = BLOCK_BYTES, held_bytes: int = HELD_BYTES, skipped: Accumulator | None = None, compared: Accumulator | None = None,
) -> DataFrame:
    """query, match, similarity, rank (from 1) of the k nearest vectors of other groups; equal similarities by id. queries: the ids that ask, if not all.

    Vectors must have one length; null vectors neither ask nor answer; rows without a group form one; one group alone gives no
    rows. skipped, compared: get the pairs that were left out and computed. Groups are compared by 64-bit hashes."""
    spark = frames.sparkSession
    kind = np.float64 if isinstance(frames.schema["embedding"].dataType.elementType, DoubleType) else np.float32
    rows = frames.where(F.col("embedding").isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.col(group_col).cast("string"), F.isnull(group_col)).alias("g"), F.xxhash64(id_col).alias("h"), F.col("embedding").alias("v"))
    rows = rows.select("id", "g", "h", F.transform("v", lambda x: x.cast("float" if kind is np.float32 else "double")).alias("v"))
    asking = F.lit(True)
    if queries is not None:
        asked = queries.select(F.col(id_col).alias("id")).distinct()
        first = rows.select(F.size("v")).first()
        most = block_bytes // FEW // (max(first[0], 1) * kind().itemsize) if first else 0
        few = rows.join(asked, "id").select("id", "g", "v").limit(most + 1).collect() if most else []
        if first and most and len(few) <= most:
            return _merged(_among_all(rows if few else rows.where("false"), few, kind, k), k)
        rows = rows.join(asked.withColumn("asked", F.lit(True)), "id", "left")
        asking = F.coalesce("asked", F.lit(False))
    rows = rows.select("id", "g", "h", asking.alias("asks"), "v")
    total = rows.agg(F.sum(F.size("v").cast("long") * kind().itemsize), F.count("*")).first()
    size = total[0] or 0
    pivots = np.zeros((1, 1))
    if size > block_bytes:
        width = rows.select(F.size("v")).first()[0]
        sample = rows.select("h", "v").orderBy("h").limit(max(1, min(SAMPLED, MOST_BYTES // (32 * max(width, 1))))).collect()
        pivots = _spread(_unit(np.array([r.v for r in sample], np.float64)), min(PIVOTS, -(-size // block_bytes)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots), np.int64)
        for batch in batches:
            x = _stacked(batch.column(0))
            total += np.bincount(_assigned(x, pivots), minlength=len(pivots)) * (x.shape[1] * kind().itemsize)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pivots), dtype=np.int32)), pa.array(total)], ["pivot", "bytes"])

    if len(pivots) > 1:
        each = rows.select("v").mapInArrow(count, "pivot int, bytes long").groupBy("pivot").agg(F.sum("bytes").alias("b")).collect()
        parts = np.ones(len(pivots), np.int64)
        for r in each:
            parts[r.pivot] = max(1, -(-r.b // block_bytes))
    else:
        parts = np.array([max(1, -(-size // block_bytes))])
    n = int(parts.sum())
    bands = bands_of(size + total[1] * (APIECE + A_BEST * k), n, held_bytes, spark.sparkContext.defaultParallelism)
    band = F.floor(F.col("block") * bands / n)
    blocks = _blocks(rows, kind, pivots, parts, k).withColumn("band", band)
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bands - 1).cast("long"))))
    low, high = F.least("band", "other"), F.greatest("band", "other")
    # A cell is a partition; those of two bands come first, as they have twice the work of those of one.
    cell = F.when(low == high, bands * (bands - 1) // 2 + low).otherwise(F.floor(low * (2 * bands - low - 1) / 2) + high - low - 1)
    dealt = met.withColumns({"cell": cell.cast("int"), "inner": low == high, "side": (F.col("band") > F.col("other")).cast("int")})
    dealt = dealt.repartitionById(bands * (bands + 1) // 2, F.col("cell")).sortWithinPartitions("cell", "side", "block")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, known = None, None

        def close() -> Iterator[pa.RecordBatch]:
            for number in list(known.kept) if known else []:
                yield from known.leave(number)
            if known and skipped is not None:
                skipped.add(known.skipped)
            if known and compared is not None:
                compared.add(known.compared)

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if r["cell"] != cell:
                    yield from close()
                    cell, known = r["cell"], _Nearest(k, pivots)
                ids = np.frombuffer(r["id"], np.int64)
                b = _Packed(r["block"], ids, np.frombuffer(r["g"], np.int64), np.frombuffer(r["asks"], bool), np.frombuffer(r["v"], kind).reshape(len(ids), -1), np.frombuffer(r["floor"]).copy())
                before = list(known.kept)
                known.add(b, r["radius"], r["pivot"])
                inner = r["inner"]
                if not inner and r["side"] == 0:
                    continue
                near = sorted(before, key=lambda x: float(np.linalg.norm(pivots[known.kept[x][2]] - pivots[r["pivot"]])))
                for other in [*([b.number] if inner else []), *near]:
                    known.meet(b.number, other)
                if not inner:
                    yield from known.leave(b.number)
        yield from close()

    each = dealt.select("cell", "inner", "side", "block", "pivot", "radius", "id", "g", "asks", "v", "floor").mapInArrow(compare, "query long, match long, similarity double")
    return _merged(each, k)


def _merged(each: DataFrame, k: int) -> DataFrame:
    if k == 1:
        top = each.groupBy("query").agg(F.max(F.struct("similarity", F.bitwise_not("match").alias("m"))).alias("b"))  # of equals the least id
        return top.select("query", F.bitwise_not("b.m").alias("match"), F.col("b.similarity").alias("similarity"), F.lit(1).alias("rank"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "match"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k)


def _among_all(rows: DataFrame, few: list, kind: type, k: int) -> DataFrame:
    """query, match, similarity: the k best for each of a few vectors within what a task has of the rows. Only the few are sent around."""
    few = sorted(few, key=lambda r: (r.g, r.id))
    held = [np.array([r.id for r in few], np.int64), np.array([r.g for r in few], np.int64), np.array([r.v for r in few], kind)]
    shared = rows.sparkSession.sparkContext.broadcast(held)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups, x = shared.value
        if not len(ids):
            return
        a = _Packed(0, ids, groups, np.ones(len(ids), bool), x, np.full(len(ids), NONE))
        best = _Best(a, k)
        for batch in batches:
            i, g = (batch.column(c).to_numpy() for c in ("id", "g"))
            order = np.argsort(g, kind="stable")
            b = _Packed(1, i[order], g[order], np.zeros(len(i), bool), _stacked(batch.column("v"))[order], np.zeros(0))
            for s in range(0, len(ids), TILE[0]):
                for t in range(0, len(i), TILE[1]):
                    best.look(s, b, t, _product(a, slice(s, s + TILE[0]), b, slice(t, t + TILE[1])))
        yield from best.rows()

    return rows.select("id", "g", "v").mapInArrow(look, "query long, match long, similarity double")


def next_similarity(frames: DataFrame) -> DataFrame:
    """frames with next_similarity: cosine with the video's next frame, null at its end."""
    order = Window.partitionBy("video").orderBy("sample_idx")
    return frames.withColumn("next_similarity", vectors.cosine(F.col("embedding"), F.lead("embedding").over(order)))


def mined_pairs(frames: DataFrame, factor: float) -> DataFrame:
    """query, match, next_similarity, cross_similarity, is_match: cross > next / factor; a video's last frame never matches."""
    own = next_similarity(frames).select(F.col("vec_id").alias("query"), "video", "next_similarity")
    near = nearest_other(frames).select("query", "match", F.col("similarity").alias("cross_similarity"))
    hit = F.coalesce(F.col("cross_similarity") > F.col("next_similarity") / factor, F.lit(False))
    return own.join(near, "query", "left").select("query", "video", "match", "next_similarity", "cross_similarity", hit.alias("is_match"))


def retrieval(frames: DataFrame) -> DataFrame:
    """One row for each labelled frame (phase not null): its nearest of other videos, whether phase and type agree, next_similarity."""
    labelled = frames.where("phase >= 0")
    kind = F.substring_index("video", "/", 1)
    own = next_similarity(labelled).select(F.col("vec_id").alias("query"), "video", "phase", kind.alias("stype"), "next_similarity")
    other = labelled.select(F.col("vec_id").alias("match"), F.col("phase").alias("match_phase"), kind.alias("match_stype"))
    near = nearest_other(labelled).select("query", "match", "similarity")
    return own.join(near, "query").join(other, "match").withColumns({"phase_ok": (F.col("phase") == F.col("match_phase")).cast("int"), "stype_ok": (F.col("stype") == F.col("match_stype")).cast("int")})


def kept_at(beta: float):
    """Whether a retrieval counts: always at beta 0; else similarity >= next / beta, or no next frame."""
    if not beta:
        return F.lit(True)
    return F.coalesce(F.round("similarity", 6) >= F.round(F.col("next_similarity") / beta, 6), F.lit(True))


def accuracy(rows: DataFrame) -> DataFrame:
    """level, key, n, phase_accuracy, stype_accuracy: over all, by video, by phase and by type, in one pass."""
    sets = rows.groupingSets([[], ["video"], ["phase"], ["stype"]], "video", "phase", "stype").agg(
        F.count("*").alias("n"), F.sum("phase_ok").alias("p"), F.sum("stype_ok").alias("s"), F.grouping_id().alias("g")
    )
    level = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "video").when(F.col("g") == 5, "phase").otherwise("stype")
    key = F.when(F.col("g") == 7, "").otherwise(F.coalesce("video", F.col("phase").cast("string"), "stype"))
    rate = lambda c: F.round(F.when(F.col("n") > 0, F.col(c) / F.col("n")).otherwise(0.0), 6)
    return sets.select(level.alias("level"), key.alias("key"), "n", rate("p").alias("phase_accuracy"), rate("s").alias("stype_accuracy"))


def against_references(rows: DataFrame, references: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """vec_id, ref_id, distance: the nearest reference (cosine distance, least id among equals); null vectors and an empty reference set give no rows.

    References of up to `most` bytes are broadcast, and a batch of rows is one matrix product; larger sets are met block by
    block, as in nearest_other."""
    refs = references.where(F.col("embedding").isNotNull())
    size = refs.agg(F.sum(F.size("embedding").cast("long") * 8).alias("b")).first().b or 0
    if size > most:
        every = rows.select(F.col("vec_id").alias("id"), F.lit("row").alias("side"), "embedding").unionByName(refs.select((F.col("vec_id") + LOWEST).alias("id"), F.lit("reference").alias("side"), "embedding"))
        near = nearest_other(every, k=1, id_col="id", group_col="side", queries=rows.select(F.col("vec_id").alias("id")))
        return near.select(F.col("query").alias("vec_id"), (F.col("match") - LOWEST).alias("ref_id"), F.round(1 - F.col("similarity"), DECIMALS).alias("distance"))
    held = refs.select("vec_id", "embedding").orderBy("vec_id").collect() if size else []
    if not held:
        return rows.select("vec_id", F.lit(0).cast("long").alias("ref_id"), F.lit(0.0).alias("distance")).where("false")
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r.vec_id for r in held]), _unit(np.array([r.embedding for r in held], np.float64))))

    def nearest(frames_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix = shared.value
        for frame in frames_:
            for at in range(0, len(frame), BLOCK):
                part = frame.iloc[at : at + BLOCK]
                d = np.round(1 - np.clip(_unit(np.stack(part["embedding"].to_numpy()).astype(np.float64)) @ matrix.T, -1, 1), DECIMALS)
                best = d.argmin(1)
                yield pd.DataFrame({"vec_id": part["vec_id"], "ref_id": ids[best], "distance": d[np.arange(len(part)), best]})

    return rows.select("vec_id", "embedding").where("embedding is not null").mapInPandas(nearest, "vec_id long, ref_id long, distance double")


def vote(frames: DataFrame, k: int, heat: float = 0.07) -> DataFrame:
    """query, voted: the phase with the largest sum of exp(similarity / heat) among the k nearest of other videos; the least phase among equals."""
    near = nearest_other(frames, k)
    phase = frames.select(F.col("vec_id").alias("match"), F.col("phase").alias("voted"))
    sums = near.join(phase, "match").groupBy("query", "voted").agg(F.round(F.sum(F.exp(F.col("similarity") / heat)), 3).alias("w"))
    return sums.groupBy("query").agg(F.max(F.struct("w", (-F.col("voted")).alias("m")))["m"].alias("m")).select("query", (-F.col("m")).alias("voted"))


def augmentation_pool(frames: DataFrame, pairs: DataFrame, reach: int, most: int = 2) -> DataFrame:
    """anchor, member, kind: neighbours within reach in the video and the first matches that exist. pairs: anchor, member, nth."""
    steps = F.explode(F.expr(f"filter(sequence(-{reach}, {reach}), s -> s <> 0)"))
    near = frames.select(F.col("vec_id").alias("anchor"), "video", "sample_idx", steps.alias("step")).select("anchor", "video", (F.col("sample_idx") + F.col("step")).alias("sample_idx"))
    around = near.join(frames.select("video", "sample_idx", F.col("vec_id").alias("member")), ["video", "sample_idx"]).select("anchor", "member", F.lit("neighbour").alias("kind"))
    crossed = pairs.where(F.col("nth") <= most).join(frames.select(F.col("vec_id").alias("member")), "member").select("anchor", "member", F.lit("pair").alias("kind"))
    own = frames.select(F.col("vec_id").alias("anchor"), F.col("vec_id").alias("member"), F.lit("anchor").alias("kind"))
    return own.unionByName(around).unionByName(crossed)
