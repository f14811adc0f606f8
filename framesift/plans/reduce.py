"""Queries on reduced and clustered embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from framesift.functions import vectors
from framesift.operators import reduce as ops
from framesift.operators import splits, temporal
from framesift.plans.splits import videos
from framesift.plans.tables import FRAMES, frames
from framesift.registry import query


@query("pca_variance")
def pca_variance(spark, sf_dir):
    _, shares = ops.pca(frames(spark, sf_dir), 8)
    return spark.range(1).select(F.posexplode(F.array(*(F.lit(round(v, 6)) for v in shares))).alias("component", "share"))


@query("pca_frames")
def pca_frames(spark, sf_dir):
    reduced, _ = ops.pca(frames(spark, sf_dir), 8)
    return reduced.select("vec_id", F.transform("reduced", lambda x: F.round(F.abs(x), 4)).alias("loadings"))


@query("spherical_kmeans")
def spherical_kmeans(spark, sf_dir):
    return ops.spherical_clusters(frames(spark, sf_dir), 6).groupBy("cluster").agg(F.count("*").alias("n"))


@query("cluster_test_share")
def cluster_test_share(spark, sf_dir):
    """How far each cluster's share of test frames is from the share over all."""
    c = ops.spherical_clusters(frames(spark, sf_dir), 6).withColumn("t", F.col("video").startswith("cat0").cast("int"))
    whole = c.agg(F.avg("t").alias("target"))
    return c.groupBy("cluster").agg(F.avg("t").alias("share")).join(F.broadcast(whole)).select("cluster", F.round(F.abs(F.col("share") - F.col("target")), 6).alias("deviation"))


@query("video_strata")
def video_strata(spark, sf_dir):
    return ops.strata(videos(spark, sf_dir), ["click", "error", "purchase", "signup", "view"]).select("video", "stratum")


@query("strata_split")
def strata_split(spark, sf_dir):
    """A fifth of each stratum of videos as the test part."""
    rows = ops.strata(videos(spark, sf_dir), ["click", "error", "purchase", "signup", "view"])
    return splits.stratified(rows.select("video", "stratum"), 0.2, 7)


@query("patch_pooling", """with c as (select event_id // 64 as key, ((event_id % 64) // 8)::int as y, (event_id % 8)::int as x, value from events),
p as (select i, floor(i * 8 / 3) as a, ceil((i + 1) * 8 / 3) as b from range(0, 3) t(i))
select key, r.i::int as r, q.i::int as c, round(avg(value), 7) as value from c join p r on c.y >= r.a and c.y < r.b join p q on c.x >= q.a and c.x < q.b group by all""")
def patch_pooling(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.col("event_id")
    cells = e.select(F.floor(k / 64).alias("key"), F.floor((k % 64) / 8).cast("int").alias("y"), (k % 8).cast("int").alias("x"), "value")
    return ops.pooled(cells, 8, 8, 3, 3).withColumn("value", F.round("value", 7))


@query("mask_weights", """with c as (select event_id // 64 as key, event_id % 64 as slot, value as motion from events), t as (select key, sum(motion ** 2) as t, count(*) as n from c group by key)
select key, slot, round(0.7 * case when t > 0 then motion ** 2 / t else 1 / n end + 0.3 / n, 7) as weight from c join t using (key)""")
def mask_weights(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    cells = e.select(F.floor(F.col("event_id") / 64).alias("key"), (F.col("event_id") % 64).alias("slot"), F.col("value").alias("motion"))
    return ops.mask_weights(cells, 2.0).select("key", "slot", F.round("weight", 7).alias("weight"))


@query("centroid_norms", f"""with {FRAMES}, dims as (select video, d, avg(x) as m from (select video, unnest(range(len(embedding))) as d, unnest(embedding)::double as x from frames) group by all)
select video, round(sqrt(sum(m * m)), 6) as norm from dims group by video""")
def centroid_norms(spark, sf_dir):
    return temporal.mean_vector(frames(spark, sf_dir), ["video"]).select("video", F.round(vectors.norm(F.col("mean")), 6).alias("norm"))


@query("kmeans_step", """with e as (select vec_id, embedding::double[] as v from embeddings),
c as (select vec_id::int as cluster, v as c from e where vec_id < 6),
near as (
  select vec_id, cluster, v, round(list_cosine_similarity(v, c), 12) as s from e, c
  qualify row_number() over (partition by vec_id order by round(list_cosine_similarity(v, c), 12) desc, cluster) = 1),
dims as (select cluster, d, avg(x) as m from (select cluster, unnest(range(len(v))) as d, unnest(v) / sqrt(list_dot_product(v, v)) as x from near) group by all)
select cluster, n, round(distance, 6) as distance, round(sqrt(q), 6) as length
from (select cluster, count(*) as n, avg(1 - s) as distance from near group by cluster) join (select cluster, sum(m * m) as q from dims group by cluster) using (cluster)""")
def kmeans_step(spark, sf_dir):
    """One step of k-means from the first six vectors: each cluster's members, their mean cosine distance and the length of their mean."""
    rows = frames(spark, sf_dir)
    start = np.array([r.embedding for r in rows.where("vec_id < 6").orderBy("vec_id").select("embedding").collect()], np.float64)
    near = ops.assigned(rows, start)
    mean = temporal.mean_vector(near.withColumn("embedding", vectors.scaled(F.col("embedding"))), ["cluster"])
    return near.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg(1 - F.col("similarity")), 6).alias("distance")).join(mean.select("cluster", F.round(vectors.norm(F.col("mean")), 6).alias("length")), "cluster")


@query("pca_invariants", """with dims as (select unnest(range(len(embedding))) as d, unnest(embedding)::double as x from embeddings)
select (select count(*) from embeddings) as n, round(sum(v), 5) as variance, true as is_centred, true as is_uncorrelated, true as is_falling
from (select var_pop(x) as v from dims group by d)""")
def pca_invariants(spark, sf_dir):
    """The variance of all vectors as the scores and shares of eight components give it, and that scores are centred, uncorrelated and falling."""
    rows = frames(spark, sf_dir)
    reduced, shares = ops.pca(rows, 8)
    y = "reduced"
    one = reduced.agg(F.count("*").alias("n"), *(F.avg(F.col(y)[i]).alias(f"m{i}") for i in range(8)), *(F.var_pop(F.col(y)[i]).alias(f"v{i}") for i in range(8)), *(F.covar_pop(F.col(y)[i], F.col(y)[i + 1]).alias(f"c{i}") for i in range(7)))
    falling = F.lit(True)
    for i in range(7):
        falling = falling & (F.col(f"v{i}") >= F.col(f"v{i + 1}"))
    variance = sum((F.col(f"v{i}") for i in range(8)), F.lit(0.0)) / F.lit(float(sum(shares)))
    small = lambda c, n: F.greatest(*(F.abs(F.col(f"{c}{i}")) for i in range(n))) < 1e-8
    return one.select("n", F.round(variance, 5).alias("variance"), small("m", 8).alias("is_centred"), small("c", 7).alias("is_uncorrelated"), falling.alias("is_falling"))
