"""Queries on splits: statistics of videos, assignment, quotas, balance, weights, schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.functions import schedules, vectors
from framesift.operators import sampling
from framesift.operators import splits as ops
from framesift.operators import temporal
from framesift.plans.tables import FRAMES, frames, read
from framesift.plans.temporal import _SCORES, _STATS6, _scores
from framesift.registry import query

_TYPES = ("click", "error", "purchase", "signup", "view")
_VIDEOS = f"""videos as (select user_id as video, user_id % 7 as dataset, count(*) as n_frames, {", ".join(f"count(*) filter (where event_type = '{t}') as {t}" for t in _TYPES)}, sum(value) as length from events group by user_id)"""
_RATIOS = (0.7, 0.15, 0.15)
_ASSIGN = f"""{_VIDEOS}, g as (select *, count(*) over (partition by dataset) as n, row_number() over (partition by dataset order by n_frames desc, video) as place from videos),
q as (select *, round_even((n - 3) * 0.7, 0) as a, round_even((n - 3) * 0.15, 0) as b from g),
t as (select *, case when n >= 3 then 1 + a + (n - 3 - a - 2 * b) else n end as tr, case when n >= 3 then 1 + b else 0 end as va from q),
assigned as (select video, dataset, n_frames, case when place <= tr then 'train' when place <= tr + va then 'val' else 'test' end as split from t)"""
_TEST = f"{_VIDEOS}, split as (select *, video % 5 = 0 as is_test from videos)"


def _md5(what: str, seed: str = "7") -> str:
    return f"md5({what} || ':{seed}')"


def _u(what: str, seed: str = "7") -> str:
    return f"('0x' || substr({_md5(what, seed)}, 1, 13))::bigint / 4503599627370496.0"


def videos(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumnRenamed("user_id", "video")
    return e.groupBy("video", (F.col("video") % 7).alias("dataset")).agg(F.count("*").alias("n_frames"), *(F.count_if(F.col("event_type") == t).alias(t) for t in _TYPES), F.sum("value").alias("length"))


@query("video_stats", f"with {_VIDEOS} select video, dataset, n_frames, {', '.join(_TYPES)}, round(length, 3) as length from videos")
def video_stats(spark, sf_dir):
    return videos(spark, sf_dir).withColumn("length", F.round("length", 3))


@query("split_assignment", f"with {_ASSIGN} select * from assigned")
def split_assignment(spark, sf_dir):
    return ops.assign(videos(spark, sf_dir).select("video", "dataset", "n_frames"), _RATIOS)


@query("split_targets", """select o_custkey as dataset, n, case when n >= 3 then 1 + a + (n - 3 - a - 2 * b) else n end::bigint as train, case when n >= 3 then 1 + b else 0 end::bigint as val, case when n >= 3 then 1 + b else 0 end::bigint as test
from (select o_custkey, count(*) as n, round_even((count(*) - 3) * 0.7, 0) as a, round_even((count(*) - 3) * 0.15, 0) as b from orders group by 1)""")
def split_targets(spark, sf_dir):
    """Sizes of the parts of each customer's orders."""
    train, val, test = ops.targets(F.col("n"), _RATIOS)
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("dataset")).agg(F.count("*").alias("n"))
    return n.select("dataset", "n", train.cast("long").alias("train"), val.cast("long").alias("val"), test.cast("long").alias("test"))


@query("split_summary_rollup", f"""with {_ASSIGN} select case when grouping(dataset) = 1 then 'all' else dataset::varchar end as dataset, case when grouping(split) = 1 then 'all' else split end as split,
count(*) as n_videos, sum(n_frames)::bigint as n_frames from assigned group by cube (dataset, split)""")
def split_summary_rollup(spark, sf_dir):
    return ops.summary(ops.assign(videos(spark, sf_dir).select("video", "dataset", "n_frames"), _RATIOS))


_BALANCE = f"""{_TEST}, b as ({" union all ".join(f"select '{t}' as label, sum({t}) filter (where not is_test) / sum(n_frames) filter (where not is_test) as train, sum({t}) filter (where is_test) / sum(n_frames) filter (where is_test) as test from split" for t in _TYPES)})"""


def _split(spark, sf_dir):
    return videos(spark, sf_dir).withColumn("is_test", F.col("video") % 5 == 0)


@query("split_balance", f"with {_BALANCE} select label, round(train, 6) as train, round(test, 6) as test, round(abs(train - test), 6) as diff from b")
def split_balance(spark, sf_dir):
    return ops.balance(_split(spark, sf_dir), list(_TYPES), "n_frames").withColumns({c: F.round(c, 6) for c in ("train", "test", "diff")})


@query("split_error", f"with {_BALANCE} select round(avg(abs(train - test)), 6) as mae, round(max(abs(train - test)), 6) as worst from b")
def split_error(spark, sf_dir):
    return ops.balance(_split(spark, sf_dir), list(_TYPES), "n_frames").agg(F.round(F.avg("diff"), 6).alias("mae"), F.round(F.max("diff"), 6).alias("worst"))


@query("relative_difference", f"""with {_TEST}, m as (select is_test, {", ".join(f"avg({t} / n_frames) as {t}" for t in _TYPES)}, avg(n_frames) as n from split group by is_test),
p as (select {", ".join(f"max({t}) filter (where is_test) as a_{t}, max({t}) filter (where not is_test) as b_{t}" for t in (*_TYPES, "n"))} from m)
select round(0.8 * ({" + ".join(f"abs(a_{t} - b_{t}) / greatest(a_{t}, b_{t}) * 100" for t in _TYPES)}) / 5 + 0.2 * (abs(a_n - b_n) / greatest(a_n, b_n) * 100), 5) as difference from p""")
def relative_difference(spark, sf_dir):
    """Mean relative difference of the label columns, blended with that of the length at 0.2."""
    s = _split(spark, sf_dir)
    parts = {t: F.col(t) / F.col("n_frames") for t in _TYPES} | {"n": F.col("n_frames").cast("double")}
    of = lambda c, t: F.avg(F.when(F.col("is_test") == t, c))
    row = s.agg(*(of(c, t).alias(f"{k}_{t}") for k, c in parts.items() for t in (True, False)))
    gap = {k: ops.relative_difference(F.col(f"{k}_True"), F.col(f"{k}_False")) for k in parts}
    mean = sum((gap[t] for t in _TYPES), F.lit(0.0)) / len(_TYPES)
    return row.select(F.round(0.8 * mean + 0.2 * gap["n"], 5).alias("difference"))


@query("length_gap", f"""with {_TEST} select round(abs(avg(n_frames) filter (where is_test) - avg(n_frames) filter (where not is_test)) / greatest(avg(n_frames) filter (where is_test), avg(n_frames) filter (where not is_test)) * 100, 5) as gap_pct,
case when avg(n_frames) filter (where is_test) > avg(n_frames) filter (where not is_test) then 'test' else 'train' end as longer from split""")
def length_gap(spark, sf_dir):
    a, b = (F.avg(F.when(F.col("is_test") == t, F.col("n_frames"))) for t in (True, False))
    return _split(spark, sf_dir).agg(F.round(ops.relative_difference(a, b), 5).alias("gap_pct"), F.when(a > b, "test").otherwise("train").alias("longer"))


@query("embedding_balance", f"""with {FRAMES}, dims as (select video, d, avg(x) as m from (select video, unnest(range(len(embedding))) as d, unnest(embedding)::double as x from frames) group by all),
unit as (select video, d, m / sqrt(sum(m * m) over (partition by video)) as m, substr(video, 1, 4) = 'cat0' as t from dims),
c as (select d, avg(m) filter (where t) as a, avg(m) filter (where not t) as b from unit group by d),
n as (select video, count(*) as n, substr(video, 1, 4) = 'cat0' as t from frames group by video)
select round(0.9 * (select 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) from c)
  + 0.1 * (select abs(avg(n) filter (where t) - avg(n) filter (where not t)) / greatest(stddev_pop(n), 1e-6) from n), 5) as balance""")
def embedding_balance(spark, sf_dir):
    """0.9 x cosine gap of the parts' mean unit centroids + 0.1 x gap of their lengths in standard deviations."""
    f = frames(spark, sf_dir)
    unit = temporal.mean_vector(f, ["video"]).select("video", vectors.scaled(F.col("mean")).alias("embedding"))
    part = F.col("video").startswith("cat0").alias("part")
    mean = temporal.mean_vector(unit.select("embedding", part), ["part"])
    gap = mean.agg(F.max(F.when(F.col("part"), F.col("mean"))).alias("a"), F.max(F.when(~F.col("part"), F.col("mean"))).alias("b")).select(vectors.distance(F.col("a"), F.col("b")).alias("gap"))
    n = f.groupBy("video").agg(F.count("*").alias("n")).select("n", part)
    side = lambda t: F.avg(F.when(F.col("part") == t, F.col("n")))
    length = n.agg((F.abs(side(True) - side(False)) / F.greatest(F.stddev_pop("n"), F.lit(1e-6))).alias("length"))
    return gap.join(length).select(F.round(0.9 * F.col("gap") + 0.1 * F.col("length"), 5).alias("balance"))


_BINS = f"""{_VIDEOS}, e as (select list_sort(list_distinct(quantile_cont(n_frames, [0, 0.25, 0.5, 0.75, 1.0]))) as e from videos),
binned as (select video, n_frames, case when len(e) <= 2 then 0 else len(list_filter(e[2:len(e) - 1], lambda x: n_frames > x)) end::int as bin from videos, e)"""


def _binned(spark, sf_dir):
    return ops.quantile_bins(videos(spark, sf_dir).select("video", "n_frames"), "n_frames", 4)


@query("quantile_bins", f"with {_BINS} select * from binned")
def quantile_bins(spark, sf_dir):
    return _binned(spark, sf_dir)


@query("stratified_quota", f"""with {_BINS}, n as (select bin as stratum, count(*) as n from binned group by bin),
l as (select *, floor(n * 0.3)::bigint as low, round(n * 0.3 - floor(n * 0.3), 9) as rest from n),
o as (select *, row_number() over (order by rest desc, stratum) as o, round_even(sum(n) over () * 0.3, 0) - sum(low) over () as missing from l)
select stratum, n, low + case when o <= missing then 1 else 0 end as quota from o""")
def stratified_quota(spark, sf_dir):
    return ops.quotas(_binned(spark, sf_dir).select("video", F.col("bin").alias("stratum")), 0.3)


_QUOTA = """n as (select bin as stratum, count(*) as n from binned group by bin),
l as (select *, floor(n * 0.3)::bigint as low, round(n * 0.3 - floor(n * 0.3), 9) as rest from n),
o as (select *, row_number() over (order by rest desc, stratum) as o, round_even(sum(n) over () * 0.3, 0) - sum(low) over () as missing from l),
quota as (select stratum, low + case when o <= missing then 1 else 0 end as quota from o)"""


@query("stratified_split", f"""with {_BINS}, {_QUOTA}, p as (select video, bin as stratum, row_number() over (partition by bin order by {_md5("video::varchar")}, video) as place from binned)
select video, stratum, place <= quota as is_test from p join quota using (stratum)""")
def stratified_split(spark, sf_dir):
    return ops.stratified(_binned(spark, sf_dir).select("video", F.col("bin").alias("stratum")), 0.3, 7)


@query("random_split", f"with {_VIDEOS} select video, row_number() over (order by {_md5('video::varchar')}, video) <= round_even(count(*) over () * 0.2, 0) as is_test from videos")
def random_split(spark, sf_dir):
    return ops.random_choice(videos(spark, sf_dir).select("video"), 0.2, 7)


_TRIALS = f"""{_VIDEOS}, chosen as (select v.*, trial, row_number() over (partition by trial order by {_md5("trial || '/' || video")}, video) <= (select round_even(count(*) * 0.2, 0) from videos) as is_test from videos v, range(0, 200) t(trial)),
trials as (select trial, greatest({", ".join(f"case when sum({t}) > 0 then abs(sum({t}) filter (where is_test) / sum({t}) - 0.2) else 0 end" for t in _TYPES)}) as score from chosen group by trial)"""


@query("best_random_splits", f"with {_TRIALS} select trial, round(score, 9) as score from trials order by 2, 1 limit 10")
def best_random_splits(spark, sf_dir):
    """A report: the ten most even of 200 random splits."""
    return ops.trials(videos(spark, sf_dir), list(_TYPES), 0.2, 200).withColumn("score", F.round("score", 9)).orderBy("score", "trial").limit(10)


@query("random_split_baseline", f"with {_TRIALS} select {_STATS6} from trials")
def random_split_baseline(spark, sf_dir):
    t = ops.trials(videos(spark, sf_dir), list(_TYPES), 0.2, 200)
    return temporal.score_stats(t)


@query("label_vectors", f"""with {_VIDEOS} select video, {", ".join(f"(dataset = {i})::int as ds_{i}" for i in range(7))}, {", ".join(f"round({t} / greatest({' + '.join(_TYPES)}, 1), 6) as {t}" for t in _TYPES)} from videos""")
def label_vectors(spark, sf_dir):
    total = F.greatest(sum((F.col(t) for t in _TYPES), F.lit(0)), F.lit(1))
    return videos(spark, sf_dir).select("video", *((F.col("dataset") == i).cast("int").alias(f"ds_{i}") for i in range(7)), *(F.round(F.col(t) / total, 6).alias(t) for t in _TYPES))


@query("sampling_weights", f"""with {_SCORES}, top as (select video, max(score) as top from scores group by video), raw as (select vec_id, pow(greatest(coalesce(top, 0), 1e-8), 0.5) as raw from frames left join top using (video))
select vec_id, round(raw / sum(raw) over () * 1000, 5) as weight from raw""")
def sampling_weights(spark, sf_dir):
    w = ops.sampling_weights(frames(spark, sf_dir), _scores(spark, sf_dir), 0.5)
    return w.select("vec_id", F.round(F.col("weight") * 1000, 5).alias("weight"))


_WEIGHTS = f"""{_SCORES}, top as (select video, max(score) as top from scores group by video), raw as (select vec_id, video, greatest(coalesce(top, 0), 1e-8) as raw from frames left join top using (video)),
weights as (select vec_id, video, raw / sum(raw) over () as weight from raw)"""


@query("weighted_frames", f"with {_WEIGHTS} select vec_id, video from weights order by -ln({_u('vec_id::varchar')} + 1.1102230246251565e-16) / weight, vec_id limit 100")
def weighted_frames(spark, sf_dir):
    """A sample of a hundred frames without replacement."""
    w = ops.sampling_weights(frames(spark, sf_dir), _scores(spark, sf_dir), 1.0)
    return ops.weighted_choice(w.select("vec_id", "video", "weight"), "weight", "vec_id", 100, 7).select("vec_id", "video")


@query("weighted_draws", f"""with {_WEIGHTS}, r as (select vec_id, sum(weight) over (order by video, vec_id) as hi, sum(weight) over () as t from weights),
p as (select vec_id, hi / t as hi, coalesce(lag(hi / t) over (order by hi), 0) as lo from r), d as (select i as draw, {_u("i::varchar")} as u from range(0, 500) t(i))
select draw, vec_id from d join p on u >= lo and u < hi""")
def weighted_draws(spark, sf_dir):
    """Five hundred draws with replacement."""
    w = ops.sampling_weights(frames(spark, sf_dir), _scores(spark, sf_dir), 1.0)
    return sampling.weighted_draws(w, "weight", "vec_id", "video", 500, 7)


_CHOSEN = f"""{FRAMES}, v as (select video, count(*) as length from frames group by video),
dims as (select video, d, avg(x) as m from (select video, unnest(range(len(embedding))) as d, unnest(embedding)::double as x from frames) group by all),
unit as (select video, d, m / sqrt(sum(m * m) over (partition by video)) as m from dims), s as (select video, length, substr(video, 1, 4) as stratum from v)"""
_BALANCES = f"""{_CHOSEN}, n as (select stratum, count(*) as n from s group by stratum), l as (select *, floor(n * 0.3)::bigint as low, round(n * 0.3 - floor(n * 0.3), 9) as rest from n),
o as (select *, row_number() over (order by rest desc, stratum) as o, round_even(sum(n) over () * 0.3, 0) - sum(low) over () as missing from l),
quota as (select stratum, low + case when o <= missing then 1 else 0 end as quota from o),
c as (select trial, video, length, row_number() over (partition by trial, stratum order by {_md5("trial || '/' || video")}, video) <= quota as is_test from s join quota using (stratum), range(0, 64) t(trial)),
g as (select trial, d, avg(m) filter (where is_test) as a, avg(m) filter (where not is_test) as b from c join unit using (video) group by all),
cosine as (select trial, 1 - sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) as gap from g group by trial),
balances as (select trial, round(0.9 * any_value(gap) + 0.1 * abs(avg(length) filter (where is_test) - avg(length) filter (where not is_test)) / greatest(stddev_pop(length), 1e-6), 6) as score from c join cosine using (trial) group by trial)"""


@query("stratified_trials", f"with {_BALANCES} select trial, score from balances")
def stratified_trials(spark, sf_dir):
    """Stratified splits scored by the balance of embeddings and lengths."""
    f = frames(spark, sf_dir)
    unit = temporal.mean_vector(f, ["video"]).select("video", vectors.scaled(F.col("mean")).alias("unit"))
    strata = f.groupBy("video").agg(F.count("*").alias("length")).withColumn("stratum", F.substring("video", 1, 4)).join(unit, "video")
    scores = ops.embedding_balances(ops.stratified_trials(strata, 0.3, 64))
    return scores.select("trial", F.round("score", 6).alias("score"))


@query("native_split", f"""with {_BALANCES}, b as (select trial, score from balances order by score, trial limit 1)
select 'native' as representation, trial, any_value(score) as score, any_value(score) as base_score, count(*) filter (where not is_test) as n_train, count(*) filter (where is_test) as n_test from b join c using (trial) group by trial""")
def native_split(spark, sf_dir):
    """The best of 64 stratified splits by the embeddings as they are."""
    got = ops.compared_splits({"native": frames(spark, sf_dir)}, F.substring("video", 1, 4), 0.3, 64)
    return got.select("representation", "trial", F.round("score", 6).alias("score"), F.round("base_score", 6).alias("base_score"), "n_train", "n_test")


@query("compressed_splits")
def compressed_splits(spark, sf_dir):
    """The splits chosen before and after eight principal components, and what the whole embeddings say of both."""
    from framesift.operators.reduce import pca

    f = frames(spark, sf_dir)
    reduced = pca(f, 8)[0].select("video", F.col("reduced").alias("embedding"))
    return ops.compared_splits({"native": f, "pca": reduced}, F.substring("video", 1, 4), 0.3, 64)


_CLUSTERED = f"""{FRAMES}, v as (select distinct video from frames), chosen as (select trial, video, row_number() over (partition by trial order by {_md5("trial || '/' || video")}, video) <= (select round_even(count(*) * 0.3, 0) from v) as is_test from v, range(0, 100) t(trial)),
e as (select trial, vec_id * 7 % 11 % 6 as cluster, count(*) as n, count(*) filter (where is_test) as t from frames join chosen using (video) group by all),
scores as (select trial, round(max(abs(t / n - 0.3)), 9) as score from e group by trial),
best as (select *, row_number() over (order by score, trial) as rank from scores order by score, trial limit 5)"""


def _best(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("cluster", F.col("vec_id") * 7 % 11 % 6)
    chosen = ops.random_trials(f.select("video").distinct(), 0.3, 100)
    return ops.best_splits(ops.cluster_deviations(ops.cluster_counts(f), chosen, 0.3), chosen, 5)


@query("best_cluster_splits", f"with {_CLUSTERED} select rank, trial, score, video, is_test from best join chosen using (trial)")
def best_cluster_splits(spark, sf_dir):
    """A report: the five random splits whose test parts are closest to a fixed share of every cluster."""
    return _best(spark, sf_dir)


@query("split_flags", f"with {_CLUSTERED} select video, {', '.join(f'max((rank = {r} and is_test)::int) as rank_{r}' for r in range(1, 6))} from best join chosen using (trial) group by video")
def split_flags(spark, sf_dir):
    from framesift.sinks import split_flags as flags

    return flags(_best(spark, sf_dir))


@query("cluster_video_counts", f"with {FRAMES} select video, vec_id * 7 % 11 % 6 as cluster, count(*) as n from frames group by all")
def cluster_video_counts(spark, sf_dir):
    return ops.cluster_counts(frames(spark, sf_dir).withColumn("cluster", F.col("vec_id") * 7 % 11 % 6))


@query("fast_split")
def fast_split(spark, sf_dir):
    """The pipeline of a balanced split: clusters of the embeddings, random splits, the best three."""
    from framesift.operators.reduce import spherical_clusters

    f = frames(spark, sf_dir)
    return ops.fast_split(f, spherical_clusters(f, 6).select("video", "cluster"), 0.3, 200, 3)


@query("lr_schedule", """with t as (select event_id, event_id % 500 as s from events)
select event_id, s as step, round(case when s < 50 then 0.002 * s / 49 else 1e-6 + 0.5 * (0.002 - 1e-6) * (1 + cos(pi() * (s - 50) / 450)) end, 9) as rate,
round(0.9995 + 0.5 * (0.996 - 0.9995) * (1 + cos(pi() * s / 500)), 9) as momentum, round(case when s < 30 then 0.04 + 0.03 * s / 29 else 0.07 end, 9) as heat from t""")
def lr_schedule(spark, sf_dir):
    """Rates of the logged steps, each run of 500."""
    step = F.col("step")
    rate = schedules.warm_cosine(step, 50, 500, 0.001, 1e-6, 512)
    logged = read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 500).alias("step"))
    return logged.select("event_id", "step", F.round(rate, 9).alias("rate"), F.round(schedules.cosine(step, 500, 0.996, 0.9995), 9).alias("momentum"), F.round(schedules.warm_constant(step, 30, 0.04, 0.07), 9).alias("heat"))


@query("label_aware_split")
def label_aware_split(spark, sf_dir):
    return ops.assign_by_labels(videos(spark, sf_dir), list(_TYPES), _RATIOS)


@query("label_aware_split_sizes", f"with {_ASSIGN} select dataset, split, count(*) as n from assigned group by all")
def label_aware_split_sizes(spark, sf_dir):
    """Its parts have exactly the sizes of the plain assignment."""
    return ops.assign_by_labels(videos(spark, sf_dir), list(_TYPES), _RATIOS).groupBy("dataset", "split").agg(F.count("*").alias("n"))


@query("label_aware_split_evenness", f"""with {_VIDEOS}, each as (select dataset, unnest([{", ".join(f"'{t}'" for t in _TYPES)}]) as label, unnest([{", ".join(_TYPES)}]) as n from videos)
select dataset, label, count(*) filter (where n > 0) as n_videos, true as is_even from each group by all""")
def label_aware_split_evenness(spark, sf_dir):
    """Whether every label's videos lie in the parts as the dataset's videos do, but for two and a half."""
    v = videos(spark, sf_dir)
    each = v.select("video", "dataset", F.explode(F.array(*(F.struct(F.lit(t).alias("label"), F.col(t).alias("n")) for t in _TYPES))).alias("l")).select("video", "dataset", "l.*")
    parts = each.join(ops.assign_by_labels(v, list(_TYPES), _RATIOS).select("video", "split"), "video")
    n = parts.groupBy("dataset", "label", "split").agg(F.count("*").alias("size"), F.count_if(F.col("n") > 0).alias("has"))
    all_ = each.groupBy("dataset", "label").agg(F.count("*").alias("all_size"), F.count_if(F.col("n") > 0).alias("n_videos"))
    gap = F.abs(F.col("has") - F.col("n_videos") * F.col("size") / F.col("all_size"))
    return n.join(all_, ["dataset", "label"]).groupBy("dataset", "label", "n_videos").agg((F.max(gap) < 2.5).alias("is_even"))


@query("positional_join", """with a as (select user_id as video, event_id % 40 as sample_idx from events), f as (select o_custkey % 100 as video, row_number() over (partition by o_custkey % 100 order by o_orderkey) - 1 as sample_idx from orders)
select case when f.sample_idx is not null then 'ok' when a.video in (select video from f) then 'out_of_range' else 'no_video' end as status, count(*) as n from a left join f using (video, sample_idx) group by 1""")
def positional_join(spark, sf_dir):
    from pyspark.sql import Window

    a = read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), (F.col("event_id") % 40).alias("sample_idx"))
    o = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("video"), "o_orderkey")
    f = o.select("video", (F.row_number().over(Window.partitionBy("video").orderBy("o_orderkey")) - 1).alias("sample_idx"), F.col("o_orderkey").cast("string").alias("path"))
    return ops.by_position(a, f).groupBy("status").agg(F.count("*").alias("n"))
