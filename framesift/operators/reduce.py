"""Reduction and clustering of embeddings by sums over tasks, and pooling of grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framesift.functions import vectors
from framesift.operators.quantiles import with_quantiles
from framesift.operators.sampling import seeded, uniform

#: Numbers of a partial sum that go to one task; rows that are a matrix at once; further directions and most passes of a PCA.
PIECE, ROWS, EXTRA, PASSES = 65_536, 4096, 24, 40
#: Width up to which a PCA takes all directions at once.
NARROW = 256


def totals(rows: DataFrame, column: str, shapes: list[tuple], of: Callable[[np.ndarray], list[np.ndarray]]) -> list[np.ndarray]:
    """Sums over all rows of what `of` gives for a matrix of vectors (of these shapes); null vectors are left out.

    Each task adds up its own; sums are cut into pieces that are added up in as many tasks. The driver gets only the totals."""
    size = sum(int(np.prod(s)) for s in shapes)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            held = batch.column(0).drop_null()
            for at in range(0, len(held), ROWS):
                some = held.slice(at, ROWS)
                x = some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1).astype(np.float64)
                total += np.concatenate([np.ravel(t) for t in of(x)])
        for k in range(0, size, PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([k // PIECE], pa.int32()), pa.array([total[k : k + PIECE].tobytes()], pa.binary())], ["piece", "data"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        data = np.sum([np.frombuffer(b) for b in frame["data"]], axis=0)
        return pd.DataFrame({"piece": frame["piece"].iloc[:1], "data": [data.tobytes()]})

    got = rows.select(column).mapInArrow(part, "piece int, data binary").groupBy("piece").applyInPandas(add, "piece int, data binary").collect()
    flat = np.concatenate([np.frombuffer(r.data) for r in sorted(got, key=lambda r: r.piece)]) if got else np.zeros(size)
    cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
    return [x.reshape(s) for x, s in zip(np.split(flat, cuts), shapes, strict=True)]


def principal(rows: DataFrame, k: int, extra: int = EXTRA, passes: int = PASSES, narrow: int = NARROW, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """mean, directions (width x k) and shares of variance, by a randomised range finder: no matrix of width x width but for widths up to `narrow`.

    Every pass multiplies the centred rows with k + extra directions and adds up what comes back, width x (k + extra) numbers; passes end when
    the shares move by less than 1e-9, or after `passes` of them. With all directions the first pass is exact. A direction's largest part is positive."""
    width = rows.select(F.size("embedding").alias("n")).where("n >= 0").first().n
    n, mean = totals(rows, "embedding", [(1,), (width,)], lambda x: [np.array([len(x)]), x.sum(0)])
    mean = mean / n
    wide = width if width <= narrow else min(width, k + extra)
    q = np.eye(width) if wide == width else np.linalg.qr(np.random.default_rng(seed).normal(size=(width, wide)))[0]
    shares = np.zeros(k)
    for _ in range(passes):
        held = rows.sparkSession.sparkContext.broadcast(q)

        def step(x: np.ndarray, held=held) -> list[np.ndarray]:
            x = x - mean
            y = x @ held.value
            return [x.T @ y, y.T @ y, np.array([(x * x).sum()])]

        onto, small, whole = totals(rows, "embedding", [(width, wide), (wide, wide), (1,)], step)
        held.destroy()
        value, turn = np.linalg.eigh(small)
        now = np.maximum(value[::-1][:k], 0) / max(float(whole[0]), 1e-300)
        done = wide == width or np.abs(now - shares).max() < 1e-9
        found, shares = q @ turn[:, ::-1][:, :k], now
        if done:
            break
        q = np.linalg.qr(onto)[0]
    return mean, found * np.sign(found[np.abs(found).argmax(0), np.arange(k)]), shares


def pca(rows: DataFrame, k: int, **how) -> tuple[DataFrame, list[float]]:
    """rows with `reduced`, and the share of variance of each component. Embeddings are centred first; k of the full width or more keeps them.

    Vectors have one length; null ones have null `reduced`."""
    width = rows.select(F.size("embedding").alias("n")).where("n >= 0").first()
    if width is None or k >= width.n:
        return rows.withColumn("reduced", rows["embedding"].cast("array<double>")), []
    held = rows.select("embedding").persist()
    try:
        mean, directions, shares = principal(held, k, **how)
    finally:
        held.unpersist()

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        real = np.flatnonzero(v.notna().to_numpy())
        out = np.full(len(v), None, object)
        if len(real):
            for i, y in zip(real, (np.stack(v.iloc[real].to_numpy()).astype(np.float64) - mean) @ directions, strict=True):
                out[i] = y
        return pd.Series(out)

    return rows.withColumn("reduced", project("embedding")), [float(v) for v in shares]


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """rows with `cluster`, the centroid of the largest cosine (the first among equals), and `similarity`; null for null and zero vectors."""
    unit = centroids / np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("cluster int, similarity double")
    def near(v: pd.Series) -> pd.DataFrame:
        label, best, real = np.full(len(v), -1), np.full(len(v), np.nan), np.flatnonzero(v.notna().to_numpy())
        if len(real):
            x = np.stack(v.iloc[real].to_numpy()).astype(np.float64)
            size = np.linalg.norm(x, axis=1)
            sim = np.round(x / np.where(size == 0, 1, size)[:, None] @ unit.T, 12)
            label[real], best[real] = np.where(size > 0, sim.argmax(1), -1), np.where(size > 0, sim.max(1), np.nan)
        return pd.DataFrame({"cluster": label, "similarity": best})

    known = F.col("near.cluster") >= 0
    return rows.withColumn("near", near("embedding")).select("*", F.when(known, F.col("near.cluster")).alias("cluster"), F.when(known, F.col("near.similarity")).alias("similarity")).drop("near")


def lloyd_step(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of the unit vectors of each centroid's members, their number and the sum of cosine distances. centroids: unit vectors (restarts x k x width)."""
    held, (r, k, width) = rows.sparkSession.sparkContext.broadcast(centroids), centroids.shape

    def of(x: np.ndarray) -> list[np.ndarray]:
        size = np.linalg.norm(x, axis=1)
        x = x[size > 0] / size[size > 0][:, None]
        total, count, cost = np.zeros((r, k, width)), np.zeros((r, k)), np.zeros(r)
        for i, c in enumerate(held.value):
            sim = np.round(x @ c.T, 12)
            member = np.zeros((len(x), k))
            member[np.arange(len(x)), sim.argmax(1)] = 1
            total[i], count[i], cost[i] = member.T @ x, member.sum(0), (1 - sim.max(1)).sum() if len(x) else 0
        return [total, count, cost]

    out = totals(rows, "embedding", [(r, k, width), (r, k), (r,)], of)
    held.destroy()
    return out


def _farthest(rows: DataFrame, centroids: np.ndarray, id_col: str) -> np.ndarray | None:
    """The unit vector of the row that is farthest from its nearest centroid, of equals the least id; None if all are at a centroid."""
    r = assigned(rows, centroids).where("similarity < 1 - 1e-9").orderBy("similarity", id_col).select("embedding").first()
    return None if r is None else np.array(r.embedding, np.float64) / np.linalg.norm(np.array(r.embedding, np.float64))


def spherical_model(rows: DataFrame, k: int, restarts: int = 3, passes: int = 50, tol: float = 1e-6, seed: int = 7, id_col: str = "vec_id", start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Centroids (unit vectors) and the mean cosine distance of the best restart of k-means on the unit sphere.

    Starts are rows in the order of a seeded hash (or `start`, one restart). All restarts go on in the same pass. A cluster without members is
    seeded again with the row farthest from all centroids. A restart ends when its members stay or its centroids move by less than tol."""
    if start is None:
        asked = [rows.where(F.coalesce(vectors.norm(F.col("embedding")), F.lit(0.0)) > 0).orderBy(seeded(id_col, seed + i), id_col).limit(k).select("embedding") for i in range(restarts)]
        start = np.array([[r.embedding for r in a.collect()] for a in asked], np.float64)
    now = start / np.linalg.norm(start, axis=2, keepdims=True)
    best, going, last = (None, np.inf), np.arange(len(now)), [None] * len(now)
    for turn in range(passes + 1):
        if not len(going):
            break
        total, count, cost = lloyd_step(rows, now[going])
        n, going_on = max(count[0].sum(), 1), []
        for j, i in enumerate(going):
            if not (count[j] == 0).any() and cost[j] / n < best[1]:
                best = (now[i].copy(), float(cost[j] / n))
            stays = last[i] is not None and np.array_equal(count[j], last[i][0]) and np.abs(total[j] - last[i][1]).max() < 1e-9
            size = np.linalg.norm(total[j], axis=1, keepdims=True)
            moved = np.where(size > 1e-12, total[j] / np.maximum(size, 1e-12), now[i])
            full = np.flatnonzero(count[j] > 0)
            held, empty = moved[full], np.flatnonzero(count[j] == 0)
            for e in empty:
                far = _farthest(rows, held, id_col)
                if far is None:
                    break
                moved[e], held = far, np.vstack([held, far])
            if best[0] is None and turn == passes:
                best = (now[i].copy(), float(cost[j] / n))
            shift, last[i] = np.linalg.norm(moved - now[i]), (count[j], total[j])
            now[i] = moved
            if not stays and shift >= tol:
                going_on.append(i)
            elif best[0] is None:
                best = (moved, float(cost[j] / n))
        going = np.array(going_on, int)
    return best


def spherical_clusters(rows: DataFrame, k: int, restarts: int = 3, seed: int = 7, id_col: str = "vec_id") -> DataFrame:
    """rows with `cluster`: k-means on cosine distance, the restart with the least mean distance. k is cut to 2..rows - 1; zero and null vectors get none (null)."""
    held = rows.select(id_col, "embedding").persist()
    try:
        n = held.where(F.coalesce(vectors.norm(F.col("embedding")), F.lit(0.0)) > 0).count()
        k = min(n, max(2, min(k, n - 1)))
        if not k:
            return rows.withColumn("cluster", F.lit(None).cast("int"))
        centroids, _ = spherical_model(held, k, restarts, seed=seed, id_col=id_col)
    finally:
        held.unpersist()
    return assigned(rows, centroids).drop("similarity")


def strata(videos: DataFrame, columns: list[str], k: int = 4, seed: int = 7) -> DataFrame:
    """videos with `stratum`: k-means over standardised columns."""
    held = VectorAssembler(inputCols=columns, outputCol="raw").transform(videos)
    scaled = StandardScaler(inputCol="raw", outputCol="z", withMean=True, withStd=True).fit(held).transform(held)
    return KMeans(k=k, seed=seed, featuresCol="z", predictionCol="stratum").fit(scaled).transform(scaled).drop("raw", "z")


def pooled(cells: DataFrame, rows: int, cols: int, to_rows: int, to_cols: int) -> DataFrame:
    """r, c, value: adaptive average pooling of a grid with cells (key, y, x, value). A cell lies in every patch whose range floor(i n / m) .. ceil((i + 1) n / m) - 1 holds it."""

    def patches(at, n: int, m: int):
        return F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: (F.floor(i * n / m) <= at) & (at < F.ceil((i + 1) * n / m)))

    each = cells.select("key", "value", F.explode(patches(F.col("y"), rows, to_rows)).alias("r"), "x").select("key", "value", "r", F.explode(patches(F.col("x"), cols, to_cols)).alias("c"))
    return each.groupBy("key", "r", "c").agg(F.avg("value").alias("value"))


def tube_slots(cells: DataFrame, frames: int, tube: int) -> DataFrame:
    """cells (key, t, s, motion) as slots (key, slot, motion): the mean motion of each place s over each tube of frames; a rest of frames is in none."""
    held = cells.where(F.col("t") < frames // tube * tube)
    places = cells.agg((F.max("s") + 1).alias("places"))
    each = held.join(F.broadcast(places)).withColumn("slot", F.floor(F.col("t") / tube) * F.col("places") + F.col("s"))
    return each.groupBy("key", "slot").agg(F.greatest(F.avg("motion"), F.lit(1e-8)).alias("motion"))


def masked_slots(weighted: DataFrame, ratio: float, seed: int) -> DataFrame:
    """key, slot of int(slots x ratio) slots of each key, without replacement, with chances by weight."""
    u = uniform(F.concat_ws("/", "key", "slot"), seed) + F.lit(2.0**-53)
    place = F.row_number().over(Window.partitionBy("key").orderBy(-F.ln(u) / F.col("weight"), "slot"))
    n = F.count("*").over(Window.partitionBy("key"))
    return weighted.select("key", "slot", place.alias("place"), n.alias("n")).where(F.col("place") <= F.floor(F.col("n") * F.lit(ratio))).select("key", "slot")


def token_split(masked: DataFrame, keys: DataFrame, frames: int, places: int, tube: int) -> DataFrame:
    """key, index, is_masked of every token index t x places + s: masked in the frames of its key's masked slots."""
    every = keys.select("key").distinct().withColumn("index", F.explode(F.sequence(F.lit(0), F.lit(frames * places - 1))))
    t, s = F.floor(F.col("index") / places), F.col("index") % places
    slotted = every.withColumn("slot", F.when(t < frames // tube * tube, F.floor(t / tube) * places + s))
    return slotted.join(masked.withColumn("is_masked", F.lit(True)), ["key", "slot"], "left").select("key", "index", F.coalesce("is_masked", F.lit(False)).alias("is_masked"))


def weighted_spread(cells: DataFrame, height: int, width: int, top: float = 0.2) -> DataFrame:
    """key, spread: of the cells (key, y, x, value, edge) in the upper part `top` of values, the deviation in y and in x, as shares of the
    height and width, weighted by edge over the largest edge plus 0.05; added up."""
    ends = with_quantiles(cells.groupBy("key").agg(F.max("edge").alias("most")), cells, "value", {"least": 1 - top}, ["key"])
    held = cells.join(ends, "key").where(F.col("value") >= F.col("least"))
    held = held.select("key", (F.col("y") / height).alias("y"), (F.col("x") / width).alias("x"), (F.col("edge") / (F.col("most") + 1e-8) + 0.05).alias("w"))
    mean = held.groupBy("key").agg(F.sum("w").alias("all"), *((F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(f"m{c}") for c in "yx"))
    square = lambda c: F.sqrt(F.sum(F.col("w") * (F.col(c) - F.col(f"m{c}")) ** 2) / F.first("all"))
    return held.join(mean, "key").groupBy("key").agg((square("y") + square("x")).alias("spread"))


def line_signals(images: DataFrame, most: int = 50) -> DataFrame:
    """key, line, values: how much neighbouring pixels differ along `most` rows, then `most` columns, evenly spread from the first to the last.

    images: key, height, width, gray (array, row by row). Images of under 32 rows or columns, or without all their pixels, give none;
    of fewer than `most` rows and columns all lines are taken. An image is one row and its lines are cut out in place."""
    h, w, n = F.col("height"), F.col("width"), F.least(F.lit(most), F.col("height"), F.col("width"))
    every = lambda size: F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.when(j == n - 1, size - 1).otherwise(F.floor(j * ((size - 1) / (n - 1))).cast("int")))
    pixel = lambda y, x: F.get("gray", y * w + x).cast("double")
    along = F.transform(every(h), lambda y: F.transform(F.sequence(F.lit(1), w - 1), lambda x: F.abs(pixel(y, x) - pixel(y, x - 1))))
    down = F.transform(every(w), lambda x: F.transform(F.sequence(F.lit(1), h - 1), lambda y: F.abs(pixel(y, x) - pixel(y - 1, x))))
    whole = images.where((h >= 32) & (w >= 32) & (F.size("gray") == h * w))
    return whole.select("key", F.concat(along, down).alias("lines")).select("key", F.posexplode("lines").alias("line", "values"))


def block_sizes(signals: DataFrame) -> DataFrame:
    """key, line, peak, size: the lag from 3 up to a third of the signal (79 at most) with the largest autocorrelation, the least among equals.

    signals: key, line, values (array). Signals of under 16 values, without a lag to look at or without variance have size 0."""
    n = F.size("values")
    mean = F.aggregate("values", F.lit(0.0), lambda a, x: a + x) / n
    centred = signals.select("key", "line", n.alias("n"), F.transform("values", lambda x: x - mean).alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, z: acc + z)
    last = F.least(F.floor(F.col("n") / 3), F.lit(80)).cast("int") - 1
    known = centred.withColumns({"norm": dot("v", "v"), "last": last})
    at = lambda k: F.round(dot(F.slice("v", F.lit(1), F.col("n") - k), F.slice("v", k + 1, F.col("n") - k)) / F.col("norm"), 9)
    lags = F.when((F.col("n") >= 16) & (F.col("last") >= 3) & (F.col("norm") >= 1e-10), F.transform(F.sequence(F.lit(3), F.greatest("last", F.lit(3))), at))
    peak = F.array_max("lags")
    return known.withColumn("lags", lags).select("key", "line", F.coalesce(peak, F.lit(0.0)).alias("peak"), F.coalesce(F.array_position("lags", peak).cast("int") + 2, F.lit(0)).alias("size"))


def usual_block_size(sizes: DataFrame) -> DataFrame:
    """key, size: the most frequent size over 0 of each key's lines, the least among equals; 0 if there is none."""
    n = sizes.groupBy("key", "size").agg(F.count("*").alias("n"))
    best = F.max(F.when(F.col("size") > 0, F.struct("n", (-F.col("size")).alias("m"))))["m"]
    return n.groupBy("key").agg(F.coalesce(-best, F.lit(0)).alias("size"))


def mask_weights(cells: DataFrame, sharpness: float, uniform: float = 0.3) -> DataFrame:
    """cells (key, slot, motion) with weight: 1 - uniform of the sharpened motion's share, and uniform of an equal share; equal where nothing moves."""
    total = cells.groupBy("key").agg(F.sum(F.pow("motion", F.lit(sharpness))).alias("t"), F.count("*").alias("n"))
    even = 1 / F.col("n")
    share = F.when(F.col("t") > 0, F.pow("motion", F.lit(sharpness)) / F.col("t")).otherwise(even)
    return cells.join(total, "key").withColumn("weight", (1 - uniform) * share + uniform * even).drop("t", "n")
