"""Queries on embeddings: retrieval, pair mining, reference sets, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import similarity as ops
from framesift.plans.tables import FRAMES, frames
from framesift.registry import query

FACTOR, BETAS, HEAT = 0.8, (0.0, 0.5, 0.8, 1.0, 1.5), 0.07
_COS = "list_cosine_similarity(a.embedding::double[], b.embedding::double[])"
_NEAR = f"""near as (
  select query, match, similarity from (
    select a.vec_id as query, b.vec_id as match, round({_COS}, 9) as similarity,
           row_number() over (partition by a.vec_id order by round({_COS}, 9) desc, b.vec_id) as rn
    from frames a join frames b on a.video <> b.video) where rn = 1),
nexts as (
  select a.vec_id as query, a.video, a.phase, split_part(a.video, '/', 1) as stype, {_COS} as next_similarity
  from frames a left join frames b on a.video = b.video and b.sample_idx = a.sample_idx + 1)"""
_ROWS = """rows_ as (
  select n.*, r.similarity, (n.phase = m.phase)::int as phase_ok, (n.stype = split_part(m.video, '/', 1))::int as stype_ok
  from nexts n join near r using (query) join frames m on m.vec_id = r.match)"""


@query("cross_video_retrieval", f"""with {FRAMES}, {_NEAR}, {_ROWS}
select case when g = 7 then 'all' when g = 3 then 'video' when g = 5 then 'phase' else 'stype' end as level,
       case when g = 7 then '' else coalesce(video, phase::varchar, stype) end as key, n,
       round(p / n, 6) as phase_accuracy, round(s / n, 6) as stype_accuracy
from (select video, phase, stype, count(*) as n, sum(phase_ok) as p, sum(stype_ok) as s, grouping(video, phase, stype) as g
      from rows_ group by grouping sets ((), (video), (phase), (stype)))""")
def cross_video_retrieval(spark, sf_dir):
    return ops.accuracy(ops.retrieval(frames(spark, sf_dir)))


@query("retrieval_beta_sweep", f"""with {FRAMES}, {_NEAR}, {_ROWS}, betas(beta) as (values {", ".join(f"({b}::double)" for b in BETAS)}),
kept as (select beta, r.*, beta = 0 or next_similarity is null or round(similarity, 6) >= round(next_similarity / nullif(beta, 0), 6) as kept from betas, rows_ r)
select beta, count(*) as n, count(*) filter (where kept) as n_kept, round(count(*) filter (where kept) / count(*), 6) as kept_share,
       round(coalesce(avg(phase_ok) filter (where kept), 0), 6) as phase_accuracy, round(coalesce(avg(stype_ok) filter (where kept), 0), 6) as stype_accuracy
from kept group by beta""")
def retrieval_beta_sweep(spark, sf_dir):
    """All ratios in one pass over the neighbours, which are found once."""
    rows = ops.retrieval(frames(spark, sf_dir))
    flags = F.explode(F.array(*(F.struct(F.lit(b).alias("beta"), ops.kept_at(b).alias("kept")) for b in BETAS)))
    each = rows.select("phase_ok", "stype_ok", flags.alias("f")).select("phase_ok", "stype_ok", "f.*")
    rate = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("kept"), F.col(c))), F.lit(0.0)), 6)
    return each.groupBy("beta").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"), F.round(F.avg(F.col("kept").cast("int")), 6).alias("kept_share"), rate("phase_ok").alias("phase_accuracy"), rate("stype_ok").alias("stype_accuracy"))


@query("retrieval_absolute_floor", f"""with {FRAMES}, {_NEAR}, {_ROWS}
select count(*) as n, count(*) filter (where similarity >= 0.5) as n_kept, round(coalesce(avg(phase_ok) filter (where similarity >= 0.5), 0), 6) as phase_accuracy from rows_""")
def retrieval_absolute_floor(spark, sf_dir):
    """The other mode: a neighbour counts from a cosine of 0.5 on."""
    rows = ops.retrieval(frames(spark, sf_dir))
    ok = F.col("similarity") >= 0.5
    return rows.agg(F.count("*").alias("n"), F.count_if(ok).alias("n_kept"), F.round(F.coalesce(F.avg(F.when(ok, F.col("phase_ok"))), F.lit(0.0)), 6).alias("phase_accuracy"))


_PAIRS = f"""with {FRAMES}, {_NEAR}, pairs as (
  select query, video, match, next_similarity, similarity as cross_similarity, coalesce(similarity > next_similarity / {FACTOR}, false) as is_match
  from nexts left join near using (query))"""


def _pairs(spark, sf_dir):
    return ops.mined_pairs(frames(spark, sf_dir), FACTOR)


@query("pair_mining", _PAIRS + " select query, video, match, round(next_similarity, 6) as next_similarity, round(cross_similarity, 6) as cross_similarity, is_match from pairs")
def pair_mining(spark, sf_dir):
    return _pairs(spark, sf_dir).withColumns({c: F.round(c, 6) for c in ("next_similarity", "cross_similarity")})


@query("pair_match_rate", _PAIRS + f" select {FACTOR}::double as factor, count(*) as n_total, count(*) filter (where is_match) as n_matches, round(coalesce(avg(is_match::int), 0), 6) as match_rate from pairs")
def pair_match_rate(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(F.lit(FACTOR).alias("factor"), F.count("*").alias("n_total"), F.count_if("is_match").alias("n_matches"), F.round(F.coalesce(F.avg(F.col("is_match").cast("int")), F.lit(0.0)), 6).alias("match_rate"))


@query("match_rate_by_video", _PAIRS + " select video, round(avg(is_match::int), 6) as match_rate, count(*) as n from pairs where next_similarity is not null and cross_similarity is not null group by video")
def match_rate_by_video(spark, sf_dir):
    both = _pairs(spark, sf_dir).where("next_similarity is not null and cross_similarity is not null")
    return both.groupBy("video").agg(F.round(F.avg(F.col("is_match").cast("int")), 6).alias("match_rate"), F.count("*").alias("n"))


@query("match_margin", _PAIRS + f" select query, match, round(cross_similarity - next_similarity / {FACTOR}, 6) as margin from pairs where is_match")
def match_margin(spark, sf_dir):
    """How far each match is above what counts as one, all matches; a caller lists the least first."""
    return _pairs(spark, sf_dir).where("is_match").select("query", "match", F.round(F.col("cross_similarity") - F.col("next_similarity") / FACTOR, 6).alias("margin"))


@query("next_frame_similarity", f"with {FRAMES}, {_NEAR} select query as vec_id, video, round(next_similarity, 6) as next_similarity from nexts")
def next_frame_similarity(spark, sf_dir):
    return ops.next_similarity(frames(spark, sf_dir)).select("vec_id", "video", F.round("next_similarity", 6).alias("next_similarity"))


_REF = f"""with {FRAMES}, refs as (select * from frames where vec_id % 50 = 7), best as (
  select vec_id, ref_id, distance from (
    select a.vec_id, b.vec_id as ref_id, round(1 - greatest(-1, least(1, {_COS})), 9) as distance,
           row_number() over (partition by a.vec_id order by round(1 - greatest(-1, least(1, {_COS})), 9), b.vec_id) as rn
    from frames a, refs b where a.vec_id % 50 <> 7) where rn = 1)"""


def _against(spark, sf_dir):
    f = frames(spark, sf_dir)
    return ops.against_references(f.where("vec_id % 50 <> 7"), f.where("vec_id % 50 = 7"))


@query("reference_filter", _REF + " select vec_id, ref_id, round(distance, 6) as distance from best where distance < 0.75")
def reference_filter(spark, sf_dir):
    return _against(spark, sf_dir).where("distance < 0.75").select("vec_id", "ref_id", F.round("distance", 6).alias("distance"))


@query("anti_reference_filter", _REF + " select vec_id from best where distance >= 0.75")
def anti_reference_filter(spark, sf_dir):
    return _against(spark, sf_dir).where("distance >= 0.75").select("vec_id")


@query("knn_vote", f"""with {FRAMES}, ranked as (
  select a.vec_id as query, a.phase, b.phase as voted, round({_COS}, 9) as s, row_number() over (partition by a.vec_id order by round({_COS}, 9) desc, b.vec_id) as rn
  from frames a join frames b on a.video <> b.video),
ks(k) as (values (1), (5), (20)),
sums as (select k, query, phase, voted, round(sum(exp(s / {HEAT})), 3) as w from ranked, ks where rn <= k group by all),
won as (select k, query, phase, voted, row_number() over (partition by k, query order by w desc, voted) as rn from sums)
select k, count(*) as n, round(avg((phase = voted)::int), 6) as accuracy from won where rn = 1 group by k""")
def knn_vote(spark, sf_dir):
    f = frames(spark, sf_dir)
    near = ops.nearest_other(f, 20).join(f.select(F.col("vec_id").alias("match"), F.col("phase").alias("voted")), "match")
    each = near.withColumn("k", F.explode(F.array(*map(F.lit, (1, 5, 20))))).where("rank <= k")
    sums = each.groupBy("k", "query", "voted").agg(F.round(F.sum(F.exp(F.col("similarity") / HEAT)), 3).alias("w"))
    won = sums.groupBy("k", "query").agg(F.max(F.struct("w", (-F.col("voted")).alias("m")))["m"].alias("m"))
    return won.join(f.select(F.col("vec_id").alias("query"), "phase"), "query").groupBy("k").agg(F.count("*").alias("n"), F.round(F.avg((F.col("phase") == -F.col("m")).cast("int")), 6).alias("accuracy"))


@query("augmentation_pool", _PAIRS + """
select vec_id as anchor, vec_id as member, 'anchor' as kind from frames
union all select a.vec_id, b.vec_id, 'neighbour' from frames a join frames b on a.video = b.video and a.vec_id <> b.vec_id and abs(a.sample_idx - b.sample_idx) <= 2
union all select query, match, 'pair' from pairs where is_match""")
def augmentation_pool(spark, sf_dir):
    matches = _pairs(spark, sf_dir).where("is_match").select(F.col("query").alias("anchor"), F.col("match").alias("member"), F.lit(1).alias("nth"))
    return ops.augmentation_pool(frames(spark, sf_dir), matches, 2)
