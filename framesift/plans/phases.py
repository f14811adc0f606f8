"""Queries on phases: intervals to frames, statistics, toggles, completion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framesift.operators import labels, temporal
from framesift.operators import phases as ops
from framesift.plans.tables import INTERVALS, intervals, read
from framesift.registry import query

_CODES = ("click", "error", "purchase", "signup", "view")
_CODE = f"codes(phase_id, code) as (values {', '.join(f'({i}, {c!r})' for i, c in enumerate(_CODES[:4]))})"
_FRAMES = f"""{INTERVALS}, {_CODE},
n as (select video, greatest(max(start_s), max(end_s)) + 1 - 20 as n from intervals group by video),
each as (select video, pos, phase_id, unnest(range(greatest(start_s, 0), least(n - 1, end_s) + 1)) as frame from intervals join codes using (code) join n using (video)),
frames as (select video, frame, arg_max(phase_id, pos) as phase_id from each group by video, frame)"""


def _frames(spark, sf_dir):
    i = intervals(spark, sf_dir)
    codes = spark.range(1).select(F.posexplode(F.array(*map(F.lit, _CODES[:4]))).alias("phase_id", "code"))
    n = i.groupBy("video").agg((F.greatest(F.max("start_s"), F.max("end_s")) + 1 - 20).alias("n"))
    return labels.interval_frames(i, n, codes)


@query("phase_frames", f"with {_FRAMES} select * from frames")
def phase_frames(spark, sf_dir):
    """Each user's log as phases by hour; the last twenty hours are cut off, one event type is an unknown code."""
    return _frames(spark, sf_dir)


@query("phase_distribution", f"with {_FRAMES} select phase_id, count(*) as n, round(count(*) * 100 / sum(count(*)) over (), 4) as pct from frames group by phase_id")
def phase_distribution(spark, sf_dir):
    return ops.distribution(_frames(spark, sf_dir))


@query("phase_transitions", f"""with {_FRAMES}, l as (select *, lag(phase_id) over (partition by video order by frame) as was from frames)
select video, count(*) filter (where was <> phase_id) as n_transitions, count(distinct phase_id) as n_phases from l group by video""")
def phase_transitions(spark, sf_dir):
    return ops.transitions(_frames(spark, sf_dir))


@query("phase_pivot", f"with {_FRAMES} select video, {', '.join(f'count(*) filter (where phase_id = {i}) as phase_{i}' for i in range(4))} from frames group by video")
def phase_pivot(spark, sf_dir):
    return ops.pivot(_frames(spark, sf_dir), [0, 1, 2, 3])


@query("phase_coverage", f"with {_FRAMES} select video, count(*) as n_labelled, round(count(*) / (max(frame) - min(frame) + 1), 6) as coverage from frames group by video")
def phase_coverage(spark, sf_dir):
    return ops.coverage(_frames(spark, sf_dir))


@query("markov_transitions", f"""with {_FRAMES}, l as (select *, lead(phase_id) over (partition by video order by frame) as to_phase from frames)
select phase_id as from_phase, to_phase, count(*) as n, round(count(*) / sum(count(*)) over (partition by phase_id), 6) as share from l where to_phase is not null group by phase_id, to_phase""")
def markov_transitions(spark, sf_dir):
    return ops.markov(_frames(spark, sf_dir))


@query("phase_label_list", "select distinct event_type as code from events")
def phase_label_list(spark, sf_dir):
    return read(spark, sf_dir, "events").select(F.col("event_type").alias("code")).distinct()


@query("video_frame_counts", f"with {INTERVALS} select video, greatest(max(pos) + 1, max(end_s) + 1) as n_frames from intervals group by video")
def video_frame_counts(spark, sf_dir):
    return intervals(spark, sf_dir).groupBy("video").agg(F.greatest(F.max("pos") + 1, F.max("end_s") + 1).alias("n_frames"))


@query("toggle_ranges", """with e as (select user_id as video, event_id as frame, row_number() over w as nth, lead(event_id) over w as nxt from events where event_type = 'click' window w as (partition by user_id order by event_id))
select video, frame as start, nxt as "end" from e where nth % 2 = 1""")
def toggle_ranges(spark, sf_dir):
    clicks = read(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"))
    return temporal.toggles_to_ranges(clicks, ["video"], "frame")


_DONE = f"""{_FRAMES}, seen as (select * from frames where phase_id = 1),
clips as (select video, unnest(range(0, max(frame) + 1, 30)) as start from frames group by video),
done as (select c.video, c.start, exists (select 1 from seen s where s.video = c.video and s.frame between c.start and c.start + 19) as done from clips c)"""


@query("clip_completion", f"with {_DONE} select video, count(*) as n_clips, count(*) filter (where done) as n_done, round(avg(done::int), 6) as completion from done group by video")
def clip_completion(spark, sf_dir):
    f = _frames(spark, sf_dir)
    starts = f.groupBy("video").agg(F.max("frame").alias("m")).select("video", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m"), F.lit(30).cast("long"))).alias("start"))
    done = ops.annotated_clips(starts.withColumn("end", F.col("start") + 19), f.where("phase_id = 1").select("video", "frame"))
    return done.groupBy("video").agg(F.count("*").alias("n_clips"), F.count_if("done").alias("n_done"), F.round(F.avg(F.col("done").cast("int")), 6).alias("completion"))


@query("phase_names_joined", """with names(code, title) as (values ('click', 'Approach'), ('view', 'Treatment'), ('error', 'Closure'))
select event_type as code, coalesce(title, 'unmatched') as title, count(*) as n from events left join names on code = event_type group by all""")
def phase_names_joined(spark, sf_dir):
    """Left join to a small dimension; rows without a match stay."""
    names = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(a).alias("code"), F.lit(b).alias("title")) for a, b in (("click", "Approach"), ("view", "Treatment"), ("error", "Closure"))))))
    e = read(spark, sf_dir, "events").select(F.col("event_type").alias("code"))
    return e.join(F.broadcast(names), "code", "left").groupBy("code", F.coalesce("title", F.lit("unmatched")).alias("title")).agg(F.count("*").alias("n"))


@query("metric_values", "select event_type as metric, count(*) as n, round(avg((props->>'k')::double), 4) as mean_k, max((props->>'k')::int) as max_k from events group by 1")
def metric_values(spark, sf_dir):
    """Metric documents are JSON of varying shape; the value is taken by path."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.count("*").alias("n"), F.round(F.avg(k), 4).alias("mean_k"), F.max(k).cast("int").alias("max_k"))


@query("pearson_stability", """with p as (select user_id as video, value as a, (props->>'k')::double as b from events)
select video, round(coalesce(case when isnan(corr(a, b)) then 0 else corr(a, b) end, 0), 5) as r from p group by video""")
def pearson_stability(spark, sf_dir):
    """Correlation of two values for each video; 0 where it isn't defined."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    r = F.coalesce(F.nanvl(F.corr("value", k), F.lit(0.0)), F.lit(0.0))
    return read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.round(r, 5).alias("r"))


@query("markov_features", """with t as (select unnest(['click', 'error', 'purchase', 'signup', 'view']) as p, unnest([0, 1, 2, 3, 4]) as i),
e as (select user_id as video, event_type as p, (value > 50)::int as a, (event_type in ('view', 'click'))::int as b, lead(event_type) over w as q, lead((value > 50)::int) over w as a2, lead((event_type in ('view', 'click'))::int) over w as b2
  from events window w as (partition by user_id order by event_id)),
v as (select distinct video from e),
steps as (select video, p, q, count(*) as n from e where q is not null group by all),
full_ as (select v.video, x.i as i, y.i as j, coalesce(n, 0) as n from v cross join t x cross join t y left join steps s on s.video = v.video and s.p = x.p and s.q = y.p),
l as (select video, 0 as k, a as f, a2 as g from e union all select video, 1, b, b2 from e),
c as (select unnest([0, 1, 2, 3]) as c),
ls as (select v.video, k.k, c.c, count(l.f) as n from v cross join (select unnest([0, 1]) as k) k cross join c left join l on l.video = v.video and l.k = k.k and l.g is not null and l.f * 2 + l.g = c.c group by all)
select video, 'phase_share' as kind, i as nth, round(count(*) filter (where e.p = t.p) / count(*), 6) as value from e cross join t group by video, i
union all select video, 'phase_steps', i * 5 + j, round(coalesce(n / nullif(sum(n) over (partition by video, i), 0), 0), 6) from full_
union all select video, 'label_share', k, round(avg(f), 6) from l group by video, k
union all select video, 'label_steps', k * 4 + c, round(coalesce(n / nullif(sum(n) over (partition by video, k), 0), 0), 6) from ls""")
def markov_features(spark, sf_dir):
    """Features of each user's events, a row for each number."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), F.col("event_type").alias("phase_id"), (F.col("value") > 50).cast("int").alias("high"), F.col("event_type").isin("view", "click").cast("int").alias("seen"))
    got = ops.markov_features(e, e, ["click", "error", "purchase", "signup", "view"], ["high", "seen"])
    kinds = [c for c in got.columns if c != "video"]
    return got.select("video", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("x")) for k in kinds))).alias("f")).select("video", "f.kind", F.posexplode("f.x").alias("nth", "x")).select("video", "kind", "nth", F.round("x", 6).alias("value"))
