"""Queries on files, runs, samples and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from framesift.operators import catalog as ops
from framesift.plans.tables import FRAMES, frames, read
from framesift.registry import query


@query("continuous_numbers", """select o_custkey as grp, o_orderkey as name, (o_orderkey % 90)::bigint as n_frames,
coalesce(sum(o_orderkey % 90) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as "offset" from orders""")
def continuous_numbers(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("name"), (F.col("o_orderkey") % 90).alias("n_frames"))
    return ops.continuous_numbers(o)


@query("strided_sample", f"""with {FRAMES}, k as (select vec_id, video, sample_idx // 3 as k, count(*) over (partition by video) as n from frames where sample_idx % 3 = 0)
select vec_id, video from k where n <= 10 or k in (select floor(i * (n - 1) / 9.0)::bigint from range(0, 10) t(i))""")
def strided_sample(spark, sf_dir):
    return ops.strided(frames(spark, sf_dir), 3, 10).select("vec_id", "video")


@query("ranked_weights", """select p_brand as experiment, p_size as run, case p_partkey % 3 when 0 then 'best' when 1 then 'last' else 'epoch' end || p_partkey as file,
row_number() over (partition by p_brand order by p_size desc, case p_partkey % 3 when 0 then 0 when 1 then 1 else 2 end, case p_partkey % 3 when 0 then 'best' when 1 then 'last' else 'epoch' end || p_partkey) as rank from part""")
def ranked_weights(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "best").when(k % 3 == 1, "last").otherwise("epoch")
    p = read(spark, sf_dir, "part").select(F.col("p_brand").alias("experiment"), F.col("p_size").alias("run"), F.concat(kind, k.cast("string")).alias("file"))
    return ops.ranked_weights(p).withColumn("rank", F.col("rank").cast("long"))


@query("latest_config", "select user_id, arg_max(props, event_id) as props from events group by user_id")
def latest_config(spark, sf_dir):
    return ops.latest(read(spark, sf_dir, "events"), ["user_id"], "event_id", "props")


@query("image_paths", """with i as (select p_partkey // 2 as s, case p_partkey % 3 when 0 then 'png' when 1 then 'JPG' else 'tif' end as x from part)
select 's' || s as stem, 's' || s || '.' || coalesce(min(case x when 'png' then 'png' end), min(case x when 'JPG' then 'JPG' end), 'jpg') as path from i group by s""")
def image_paths(spark, sf_dir):
    k = F.col("p_partkey")
    images = read(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.floor(k / 2).cast("string")).alias("stem"), F.when(k % 3 == 0, "png").when(k % 3 == 1, "JPG").otherwise("tif").alias("suffix"))
    return ops.image_paths(images.select("stem").distinct(), images)


@query("labelled_sample", f"""with {FRAMES}, p as (select vec_id, phase, row_number() over (partition by phase order by md5(vec_id || ':7'), vec_id) as place from frames),
k as (select *, count(*) over (partition by phase) as n from p where place <= 50) select vec_id, phase, place <= floor(n * 0.2) as is_val from k""")
def labelled_sample(spark, sf_dir):
    return ops.labelled_sample(frames(spark, sf_dir), "phase", "vec_id", 50, 0.2, 7).select("vec_id", "phase", "is_val")


@query("frame_fingerprints", f"""with {FRAMES}, r as (select video, sample_idx, row_number() over (partition by video order by sample_idx) as up, row_number() over (partition by video order by sample_idx desc) as down from frames)
select video, md5(concat_ws('|', count(*), string_agg(sample_idx::varchar, ',' order by sample_idx) filter (where up <= 5), string_agg(sample_idx::varchar, ',' order by sample_idx) filter (where down <= 5))) as hash from r group by video""")
def frame_fingerprints(spark, sf_dir):
    return ops.fingerprint(frames(spark, sf_dir))


@query("extraction_summary", """with g as (select o_custkey as grp, count(*) as n, sum((o_orderstatus = 'F')::int) as bad, sum(o_orderkey % 90) as frames from orders group by o_custkey)
select count(*) as n_groups, count(*) filter (where bad < n) as n_ok, count(*) filter (where bad = n) as n_failed, sum(frames) filter (where bad < n)::bigint as n_frames from g""")
def extraction_summary(spark, sf_dir):
    """A group fails if all its files do."""
    g = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("bad"), F.sum(F.col("o_orderkey") % 90).alias("frames"))
    ok = F.col("bad") < F.col("n")
    return g.agg(F.count("*").alias("n_groups"), F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_failed"), F.sum(F.when(ok, F.col("frames"))).alias("n_frames"))


@query("failed_groups", "select o_custkey as grp, 'no file could be read' as reason from orders group by o_custkey having bool_and(o_orderstatus = 'F')")
def failed_groups(spark, sf_dir):
    g = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("grp")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("bad"))
    return g.where("bad").select("grp", F.lit("no file could be read").alias("reason"))


@query("block_sizes", "select p_size as block_size, count(*) as n, round(count(*) / (select count(*) from part), 6) as share from part where p_size >= 30 group by p_size")
def block_sizes(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    whole = p.agg(F.count("*").alias("all"))
    return p.where(F.col("p_size") >= 30).groupBy(F.col("p_size").alias("block_size")).agg(F.count("*").alias("n")).join(F.broadcast(whole)).select("block_size", "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query("block_size_mode", "select grp, min(p_size) as mode from (select *, rank() over (partition by grp order by n desc) as r from (select p_brand as grp, p_size, count(*) as n from part group by 1, 2)) where r = 1 group by grp")
def block_size_mode(spark, sf_dir):
    """The most frequent size of each group, the smallest among equals."""
    n = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("p_brand").alias("grp")).agg((-F.max(F.struct("n", (-F.col("p_size")).alias("m")))["m"]).alias("mode"))


@query("source_audit", """with m as (select c.c_nationkey as sheet, c.c_custkey, count(o.o_orderkey) as n from customer c left join orders o on o.o_custkey = c.c_custkey group by all)
select sheet, count(*) as n_total, count(*) filter (where n > 0) as n_matched, sum(n)::bigint as n_frames from m group by sheet""")
def source_audit(spark, sf_dir):
    """Matched and all entries of each sheet, and the frames that they have."""
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    return c.groupBy(F.col("c_nationkey").alias("sheet")).agg(F.count("*").alias("n_total"), F.count("n").alias("n_matched"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_frames"))


@query("comparison_table", """select event_type as config, round(avg(value), 4) as score, round(avg(value) filter (where user_id % 3 = 0), 4) as phase_0, round(avg(value) filter (where user_id % 3 = 1), 4) as phase_1, round(avg(value) filter (where user_id % 3 = 2), 4) as phase_2 from events group by 1""")
def comparison_table(spark, sf_dir):
    e = read(spark, sf_dir, "events").withColumn("phase", F.col("user_id") % 3)
    score = e.groupBy(F.col("event_type").alias("config")).agg(F.round(F.avg("value"), 4).alias("score"))
    wide = e.groupBy(F.col("event_type").alias("config")).pivot("phase", [0, 1, 2]).agg(F.round(F.avg("value"), 4))
    return score.join(wide, "config").select("config", "score", *(F.col(str(i)).alias(f"phase_{i}") for i in range(3))).orderBy(F.desc("score"))


@query("state_transitions", """with s as (select user_id, event_id, (event_type = 'click')::int as a, (event_type in ('view', 'click'))::int as b from events),
t as (select a * 2 + b as f, lead(a * 2 + b) over (partition by user_id order by event_id) as g from s)
select f as from_state, g as to_state, count(*) as n, round(count(*) / sum(count(*)) over (partition by f), 6) as share from t where g is not null group by f, g""")
def state_transitions(spark, sf_dir):
    """On/off states of two labels and the shares of their transitions."""
    from framesift.operators.phases import markov

    state = F.when(F.col("event_type") == "click", 3).when(F.col("event_type") == "view", 1).otherwise(0)
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("video"), F.col("event_id").alias("frame"), state.alias("phase_id"))
    return markov(rows).withColumnsRenamed({"from_phase": "from_state", "to_phase": "to_state"})
