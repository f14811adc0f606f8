"""Chat formatting: a dialogue seen by each of its participants.

For every participant of a conversation each turn is rendered once: the participant's own turns as the assistant's, the
others' as those of a user with that name, with a mask that is 1 where the model learns, so on the assistant's turns.
A rendered dialogue is its messages in the order of `place`; `begin` is where a message starts in it, so spans of the
mask can be moved to the dialogue by adding it.

One row for each message keeps the work free of unbounded groups: a conversation of any length, even a third of the table, is
never gathered into one value or one task. Rows are dealt out by ranges of conversation and order, so a long conversation is
many buckets; places and offsets are counted inside buckets, and the buckets' totals are added up in a small table of one row
for each conversation, bucket and participant.

Defined results: a null or empty role is the participant "unknown"; a null text renders as an empty one and trains
nothing; rows with the same conversation and turn are ordered by participant, then by the MD5 of their text (null turns
first); rows without conv_id form one conversation; equal rows are rendered as often as they occur; in texts, `<|` becomes
`< |`, so that no text can hold a mark; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.storage import saved

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _name(role: Column) -> Column:
    """A participant's name without white space and marks that would end a header early."""
    clean = F.regexp_replace(F.trim(role), r"[\s<|>]+", "_")
    return F.when(clean.isNull() | (clean == ""), "unknown").otherwise(clean)


def _head(speaker: Column, own: Column) -> Column:
    return F.concat(F.lit(BEGIN), F.when(own, "assistant").otherwise(F.concat(F.lit("user name="), speaker)), F.lit("\n"))


def perspectives(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, place, speaker, role, rendered, begin, mask, n_learned_chars: a row for each participant and message.

    place: number of the message in its conversation, from 1; begin: its first character's place in the dialogue; mask: the
    spans [start, end) of the rendered message on which loss is taken, so the assistant's text and its end mark."""
    body = F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |"))
    said = turns.select("conv_id", "turn", _name(F.col("role")).alias("speaker"), body.alias("text")).withColumn("digest", F.md5("text"))
    said = saved(said.repartitionByRange("conv_id", "turn", "speaker", "digest").withColumn("bucket", F.spark_partition_id()), "turns")
    as_user = F.length(_head(F.col("speaker"), F.lit(False))) + F.length("text") + len(END)
    here, before = Window.partitionBy("bucket", "conv_id"), Window.unboundedPreceding
    order = here.orderBy("turn", "speaker", "digest")
    said = said.withColumns({"nth": F.row_number().over(order), "ahead": F.coalesce(F.sum(as_user).over(order.rowsBetween(before, -1)), F.lit(0))})
    own = said.groupBy("conv_id", "bucket", "speaker").agg(F.count("*").alias("n"), F.sum(as_user).alias("chars"))
    past = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(before, -1)
    totals = own.groupBy("conv_id", "bucket").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    totals = totals.select(F.col("conv_id").alias("conv"), F.col("bucket").alias("b"), F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n_past"), F.coalesce(F.sum("chars").over(past), F.lit(0)).alias("chars_past"))
    who = own.select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seats = totals.join(who, F.col("conv").eqNullSafe(F.col("of"))).drop("of")
    mine = own.select(F.col("conv_id").alias("of"), F.col("bucket").alias("at"), "speaker", "n")
    seats = seats.join(mine, F.col("conv").eqNullSafe(F.col("of")) & (F.col("b") == F.col("at")) & (F.col("perspective") == F.col("speaker")), "left").drop("of", "at", "speaker")
    past = Window.partitionBy("conv", "perspective").orderBy("b").rowsBetween(before, -1)
    seats = seats.select("conv", "b", "n_past", "chars_past", "perspective", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("own_past"))
    rows = said.join(seats, F.col("conv_id").eqNullSafe(F.col("conv")) & (F.col("bucket") == F.col("b")))
    is_own = F.col("speaker") == F.col("perspective")
    own_here = F.coalesce(F.sum(is_own.cast("int")).over(Window.partitionBy("bucket", "conv_id", "perspective").orderBy("nth").rowsBetween(before, -1)), F.lit(0))
    # An own message has "assistant" where others see "user name=" and the name: one character and the name less.
    begin = F.col("chars_past") + F.col("ahead") - (1 + F.length("perspective")) * (F.col("own_past") + own_here)
    head = _head(F.col("speaker"), is_own)
    rendered = F.concat(head, F.col("text"), F.lit(END))
    learn = is_own & (F.col("text") != "")
    mask = F.when(learn, F.array(F.struct(F.length(head).cast("long").alias("start"), (F.length(rendered) - 1).cast("long").alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))
    return rows.select(
        "conv_id", "perspective", "turn", (F.col("n_past") + F.col("nth")).alias("place"), "speaker", F.when(is_own, "assistant").otherwise("user").alias("role"),
        rendered.alias("rendered"), begin.cast("long").alias("begin"), mask.alias("mask"), F.when(learn, F.length("text") + len(END) - 1).otherwise(0).cast("long").alias("n_learned_chars"),
    )


def dialogues(turns: DataFrame, size: int = 1 << 20) -> DataFrame:
    """conv_id, perspective, part, begin, text, mask: the rendered dialogue of each perspective in parts, in order from 0.

    A part holds the messages that begin in one stretch of `size` characters, so it is never longer than that and one message; the texts
    of all parts one after another are the dialogue. begin: place of the part's first character; mask: spans [start, end) in
    the dialogue's own characters. A stretch in which no message begins makes no part, so numbers may have gaps."""
    place = F.transform("mask", lambda m: F.struct((m["start"] + F.col("begin")).alias("start"), (m["end"] + F.col("begin")).alias("end")))
    rows = perspectives(turns).select("conv_id", "perspective", F.floor(F.col("begin") / size).alias("part"), F.struct("place", "begin", "rendered", place.alias("mask")).alias("m"))
    parts = rows.groupBy("conv_id", "perspective", "part").agg(F.array_sort(F.collect_list("m")).alias("m"))
    return parts.select("conv_id", "perspective", "part", F.col("m")[0]["begin"].alias("begin"), F.array_join("m.rendered", "").alias("text"), F.flatten("m.mask").alias("mask"))


def op2_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    """One row for each participant and message of the conversations."""
    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select(
        "conv_id", "perspective", "turn", "place", "speaker", "role", F.sha2("rendered", 256).alias("rendered_sha256"), F.length("rendered").cast("long").alias("n_chars"), "begin",
        F.coalesce(F.try_element_at("mask", F.lit(1))["start"], F.lit(-1)).alias("mask_start"), F.coalesce(F.try_element_at("mask", F.lit(1))["end"], F.lit(-1)).alias("mask_end"), "n_learned_chars",
    )


OP2_SQL = r"""
with said as (
  select conv_id, turn,
         case when coalesce(regexp_replace(trim(role), '[\s<|>]+', '_', 'g'), '') = '' then 'unknown'
              else regexp_replace(trim(role), '[\s<|>]+', '_', 'g') end as speaker,
         replace(coalesce(text, ''), '<|', '< |') as body
  from conversations),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, speaker, md5(body)) as place from said),
who as (select distinct conv_id, speaker as perspective from said),
rows_ as (
  select s.*, w.perspective, s.speaker = w.perspective as own,
         '<|im_start|>' || case when s.speaker = w.perspective then 'assistant' else 'user name=' || s.speaker end || chr(10) as head
  from placed s join who w on s.conv_id is not distinct from w.conv_id),
out_ as (select *, head || body || '<|im_end|>' || chr(10) as rendered from rows_)
select conv_id, perspective, turn, place, speaker, case when own then 'assistant' else 'user' end as role,
       sha256(rendered) as rendered_sha256, length(rendered)::bigint as n_chars,
       coalesce(sum(length(rendered)) over (partition by conv_id, perspective order by place rows between unbounded preceding and 1 preceding), 0)::bigint as begin,
       case when own and body <> '' then length(head)::bigint else -1 end as mask_start,
       case when own and body <> '' then length(rendered)::bigint - 1 else -1 end as mask_end,
       case when own and body <> '' then length(body)::bigint + 10 else 0 end as n_learned_chars
from out_
"""
