"""Queries along videos: change scores, peaks, clips, fills, ranges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framesift.functions import vectors
from framesift.operators import temporal as ops
from framesift.plans.tables import FRAMES, frames
from framesift.registry import query

W, GAP, CLIP = 5, 10, 8

_SCORES = f"""{FRAMES}, unit as (
  select video, sample_idx, i as d, x / case when n > 0 then n else 1 end as x from (
    select video, sample_idx, unnest(range(len(embedding))) as i, unnest(embedding)::double as x, sqrt(list_sum(list_transform(embedding, lambda e: e::double * e::double))) as n from frames)),
means as (
  select video, sample_idx, d, avg(x) over (partition by video, d order by sample_idx rows between {W} preceding and 1 preceding) as b,
         avg(x) over (partition by video, d order by sample_idx rows between current row and {W - 1} following) as a,
         count(*) over (partition by video, d) as n from unit),
scores as (
  select video, sample_idx as position, 1 - sum(a * b) / ((sqrt(sum(a * a)) + 1e-8) * (sqrt(sum(b * b)) + 1e-8)) as score
  from means where sample_idx >= {W} and sample_idx <= n - {W} group by video, sample_idx)"""


def _scores(spark, sf_dir):
    return ops.change_scores(frames(spark, sf_dir), W)


@query("temporal_change", f"with {_SCORES} select video, position, round(score, 6) as score from scores")
def temporal_change(spark, sf_dir):
    return _scores(spark, sf_dir).select("video", "position", F.round("score", 6).alias("score"))


_STATS = ", ".join(["count(score) as n", *(f"round({e}, 5) as {n}" for n, e in (("min", "min(score)"), ("max", "max(score)"), ("mean", "avg(score)"), ("std", "stddev_pop(score)"), *((k, f"quantile_cont(score, {p})") for k, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p995", 0.995)))))])
_STATS6 = ", ".join(["count(score) as n", *(f"round({e}, 6) as {n}" for n, e in (("min", "min(score)"), ("max", "max(score)"), ("mean", "avg(score)"), ("std", "stddev_pop(score)"), *((k, f"quantile_cont(score, {p})") for k, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("p995", 0.995)))))])


@query("temporal_score_stats", f"with {_SCORES} select {_STATS} from scores")
def temporal_score_stats(spark, sf_dir):
    return ops.score_stats(_scores(spark, sf_dir), digits=5)


@query("score_stats_by_video", f"with {_SCORES} select video, {_STATS} from scores group by video")
def score_stats_by_video(spark, sf_dir):
    return ops.score_stats(_scores(spark, sf_dir), ["video"], digits=5)


@query("score_histogram", f"""with {_SCORES}, s as (select round(score, 6) as score from scores), e as (select min(score) as lo, max(score) as hi from s)
select case when hi > lo then least(floor((score - lo) / ((hi - lo) / 20)), 19) else 0 end::bigint as bin, count(*) as n from s, e group by 1""")
def score_histogram(spark, sf_dir):
    return ops.histogram(_scores(spark, sf_dir).select(F.round("score", 6).alias("score")), 20)


@query("score_cdf", f"with {_SCORES}, s as (select round(score, 3) as score, count(*) as n from scores group by 1) select score, round(sum(n) over (order by score) / sum(n) over (), 6) as cdf from s")
def score_cdf(spark, sf_dir):
    """Share of scores up to each rounded value; the window runs over at most 2,001 values."""
    s = _scores(spark, sf_dir).groupBy(F.round("score", 3).alias("score")).agg(F.count("*").alias("n"))
    return s.select("score", F.round(F.sum("n").over(Window.orderBy("score")) / F.sum("n").over(Window.partitionBy()), 6).alias("cdf"))


@query("score_above_threshold", f"with {_SCORES} select video, count(*) as n, round(avg((round(score, 6) >= 0.8)::int) * 100, 4) as pct_above from scores group by video")
def score_above_threshold(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("video").agg(F.count("*").alias("n"), F.round(F.avg((F.round("score", 6) >= 0.8).cast("int")) * 100, 4).alias("pct_above"))


@query("peaks_by_video", f"""with {_SCORES} select video, count(*) as n, round(max(score), 6) as top from scores where round(score, 6) >= 0.7 group by video order by top desc, video limit 20""")
def peaks_by_video(spark, sf_dir):
    """A report of the twenty videos with the largest change."""
    return _scores(spark, sf_dir).where(F.round("score", 6) >= 0.7).groupBy("video").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("top")).orderBy(F.desc("top"), "video").limit(20)


@query("temporal_peaks", f"""with recursive {_SCORES}, r as (select video, position, score, row_number() over (partition by video order by score desc, position) as r from scores),
k as (select distinct video, 0::bigint as r, []::bigint[] as kept from scores union all
  select k.video, r.r, case when len(list_filter(k.kept, lambda p: abs(p - r.position) < {GAP})) = 0 then list_append(k.kept, r.position) else k.kept end from k join r on r.video = k.video and r.r = k.r + 1),
last as (select video, arg_max(kept, r) as kept from k group by video)
select video, position, round(score, 6) as score from (select video, unnest(kept) as position from last) join scores using (video, position)""")
def temporal_peaks(spark, sf_dir):
    return ops.peaks(_scores(spark, sf_dir), GAP).select("video", "position", F.round("score", 6).alias("score"))


_CLIPS = f"""{FRAMES}, cut as (select video, sample_idx // {CLIP} as clip, sample_idx, embedding from frames),
dims as (select video, clip, d, avg(x) as m from (select video, clip, unnest(range(len(embedding))) as d, unnest(embedding)::double as x from cut) group by all),
ends as (select video, clip, min(sample_idx) as start, max(sample_idx) as "end" from cut group by all)"""


@query("clip_means", f"""with {_CLIPS} select video, clip, start, "end", round(n, 5) as norm from ends join (select video, clip, sqrt(sum(m * m)) as n from dims group by all) using (video, clip)""")
def clip_means(spark, sf_dir):
    return ops.clips(frames(spark, sf_dir), CLIP).select("video", "clip", "start", "end", F.round(vectors.norm(F.col("mean")), 5).alias("norm"))


@query("diverse_clips")
def diverse_clips(spark, sf_dir):
    return ops.diverse(ops.clips(frames(spark, sf_dir), CLIP), 0.4, CLIP).withColumn("score", F.round("score", 6))


@query("clip_index", f"with {FRAMES} select video, unnest(range(0, n - 12, 4))::bigint as start from (select video, count(*) as n from frames group by video) where n >= 13")
def clip_index(spark, sf_dir):
    return ops.clip_starts(frames(spark, sf_dir), 4, 4)


@query("clip_frames", f"""with {FRAMES}, n as (select video, count(*) as n from frames group by video), s as (select video, n, unnest(range(0, n, 10))::bigint as start from n)
select video, start, i::int as nth, start + least(i, (n - 1 - start) // 3) * 3 as sample_idx from (select *, unnest(range(5)) as i from s)""")
def clip_frames(spark, sf_dir):
    f = frames(spark, sf_dir)
    starts = f.where("sample_idx % 10 = 0").select("video", F.col("sample_idx").alias("start"))
    return ops.clip_frames(starts, f, 5, 3)


@query("video_centroids", f"""with {FRAMES}, dims as (select video, d, avg(x) as m from (select video, unnest(range(len(embedding))) as d, unnest(embedding)::double as x from frames) group by all),
norms as (select video, sqrt(sum(m * m)) as n from dims group by video)
select video, d::int as dim, round(m / case when n > 0 then n else 1 end, 6) as value from dims join norms using (video)""")
def video_centroids(spark, sf_dir):
    mean = ops.mean_vector(frames(spark, sf_dir), ["video"])
    return mean.select("video", F.posexplode(vectors.scaled(F.col("mean"))).alias("dim", "value")).withColumn("value", F.round("value", 6))


@query("embedding_stats", "select d::int as dim, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std from (select unnest(range(len(embedding))) as d, unnest(embedding)::double as x from embeddings) group by d")
def embedding_stats(spark, sf_dir):
    stats = ops.vector_stats(frames(spark, sf_dir))
    return stats.select(F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "s")).select("dim", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"))


@query("outlier_choice", f"""with {FRAMES}, dims as (select vec_id, video, sample_idx, unnest(range(len(embedding))) as d, unnest(embedding)::double as x from frames),
st as (select d, avg(x) as m, stddev_pop(x) as s from dims group by d),
z as (select vec_id, video, sample_idx, sqrt(sum(((x - m) / case when s > 0 then s else 1 end) ** 2)) as z from dims join st using (d) group by all)
select video, sample_idx as position, case when round(lag(z) over w, 6) > round(z, 6) then 'before' else 'after' end as chosen
from z window w as (partition by video order by sample_idx) qualify lag(z) over w is not null""")
def outlier_choice(spark, sf_dir):
    """Of each frame and the one before it, the one that is farther from the mean in standard deviations; the later one if equal."""
    f = frames(spark, sf_dir)
    stats = ops.vector_stats(f)  # one row, of the width of a vector
    scaled = F.zip_with(F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m), "std", lambda x, s: x / F.when(s > 0, s).otherwise(1.0))
    z = f.join(F.broadcast(stats)).select("video", "sample_idx", F.round(vectors.norm(scaled), 6).alias("z"))
    order = Window.partitionBy("video").orderBy("sample_idx")
    pairs = z.withColumn("was", F.lag("z").over(order)).where("was is not null")
    return pairs.select("video", F.col("sample_idx").alias("position"), ops.outlier_of_pair(pairs, F.col("was"), F.col("z")).alias("chosen"))


_HOLES = f"{FRAMES}, holes as (select video, sample_idx, case when vec_id % 3 = 0 then vec_id end as v from frames)"


@query("nearest_fill", f"""with {_HOLES}, s as (select *,
  last_value(case when v is not null then sample_idx end ignore nulls) over b as pa, last_value(v ignore nulls) over b as va,
  first_value(case when v is not null then sample_idx end ignore nulls) over f as pb, first_value(v ignore nulls) over f as vb from holes
  window b as (partition by video order by sample_idx rows between unbounded preceding and current row), f as (partition by video order by sample_idx rows between current row and unbounded following))
select video, sample_idx, case when pa is null then vb when pb is null then va when sample_idx - pa <= pb - sample_idx then va else vb end as v from s""")
def nearest_fill(spark, sf_dir):
    holes = frames(spark, sf_dir).select("video", "sample_idx", F.when(F.col("vec_id") % 3 == 0, F.col("vec_id")).alias("v"))
    return ops.nearest_fill(holes, "v")


@query("merged_clips", f"""with {FRAMES}, c as (select video, (sample_idx // 7) * 7 as start, (sample_idx // 7) * 7 + 4 + vec_id % 5 as "end" from frames where sample_idx % 7 = 0),
m as (select *, max("end") over (partition by video order by start, "end" rows between unbounded preceding and 1 preceding) as reach from c),
r as (select *, sum(case when start <= reach + 1 then 0 else 1 end) over (partition by video order by start, "end" rows unbounded preceding) as run from m)
select video, min(start) as start, max("end") as "end" from r group by video, run""")
def merged_clips(spark, sf_dir):
    f = frames(spark, sf_dir).where("sample_idx % 7 = 0")
    return ops.merged_clips(f.select("video", F.col("sample_idx").alias("start"), (F.col("sample_idx") + 4 + F.col("vec_id") % 5).alias("end")))
