"""Document fingerprints: SimHash over weighted terms, and a search by permuted block tables.

A document's terms are its runs of five words and its words of seven letters or more; a term weighs as much as it
occurs. Each term's hash votes for or against each of 128 bits with its weight, and the majority makes the fingerprint.
The likeness of two fingerprints is the share of equal bits.

Votes are counted two to a long, 32 bits apart, so 64 sums in generated code count all of them; nothing leaves the JVM.
The search cuts fingerprints into radius + 1 blocks: two fingerprints within the radius agree on a block, so a table
permuted to begin with each block finds them all by equality on it. Equal fingerprints are one entry with a count.

Defined results: null and empty texts, and texts without words, have the fingerprint of all zeros; a text with fewer
than five words is one run; a bit on which votes are even is 0; equal texts have equal fingerprints; rows with equal ids
are kept apart and stand in the order of a hash of their texts, as do rows without an id after all others, which are no
queries of the search; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framesift.llm.columns import let, run_hashes, word_array
from framesift.llm.storage import saved

RUN, LONG = 5, 7
#: Hamming radius of the search, out of 128 bits.
RADIUS = 3
_LANES = 0x100000001


def terms(text: Column) -> Column:
    """Hashes of the terms of a text, with repeats."""

    def of(words: Column) -> Column:
        long_ones = F.transform(F.filter(words, lambda w: F.length(w) >= LONG), lambda w: F.xxhash64(w, F.lit(1)))
        return F.concat(run_hashes(F.transform(words, lambda w: F.xxhash64(w)), RUN), long_ones)

    return let(word_array(text), of)


def _votes() -> list[Column]:
    out = []
    for half, h in (("a", F.col("term")), ("b", F.when(F.col("term").isNotNull(), F.xxhash64("term")))):
        out += [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_LANES))).alias(f"{half}{i}") for i in range(32)]
    return [*out, F.count("term").alias("total")]


def _half(half: str) -> Column:
    def bit(i: int) -> Column:
        votes = F.col(f"{half}{i % 32}")
        votes = F.shiftrightunsigned(votes, 32) if i >= 32 else votes.bitwiseAND(F.lit(0xFFFFFFFF))
        return F.when(votes * 2 > F.col("total"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0))

    out = bit(0)
    for i in range(1, 64):
        out = out.bitwiseOR(bit(i))
    return F.coalesce(out, F.lit(0))


def fingerprints(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key columns, fp_a, fp_b (the two halves) of each row; the key must tell rows apart.

    If the rows are dealt out by some of the key columns already, nothing is shuffled."""
    each = texts.select(*key, F.explode_outer(terms(F.coalesce(text, F.lit("")))).alias("term"))
    return each.groupBy(*key).agg(*_votes()).select(*key, _half("a").alias("fp_a"), _half("b").alias("fp_b"))


def text_of(a: Column, b: Column) -> Column:
    """Both halves as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0")))


def likeness(a: Column, b: Column, c: Column, d: Column) -> Column:
    return 1 - (F.bit_count(a.bitwiseXOR(c)) + F.bit_count(b.bitwiseXOR(d))) / F.lit(128.0)


def _blocks(a: Column, b: Column, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint, each with its number."""
    n, out = radius + 1, []
    for k in range(n):
        lo, hi = 128 * k // n, 128 * (k + 1) // n
        parts = []
        for half, base in ((a, 0), (b, 64)):
            x, y = max(lo, base), min(hi, base + 64)
            if x < y:
                parts.append(F.shiftrightunsigned(F.shiftleft(half, base + 64 - y), 64 - (y - x)))
        out.append(F.struct(F.lit(k).alias("block"), F.xxhash64(*parts).alias("value") if len(parts) > 1 else parts[0].alias("value")))
    return F.explode(F.array(*out))


def within(queries: DataFrame, table: DataFrame, radius: int = RADIUS) -> DataFrame:
    """q_a, q_b, fp_a, fp_b, distance, n of all entries of the table within the radius of each distinct query.

    queries: fp_a, fp_b; table: fp_a, fp_b, n. Both must hold distinct fingerprints."""
    left = queries.select(F.col("fp_a").alias("q_a"), F.col("fp_b").alias("q_b")).select("q_a", "q_b", _blocks(F.col("q_a"), F.col("q_b"), radius).alias("k")).select("q_a", "q_b", "k.*")
    right = table.select("fp_a", "fp_b", "n", _blocks(F.col("fp_a"), F.col("fp_b"), radius).alias("k")).select("fp_a", "fp_b", "n", "k.*")
    distance = (F.bit_count(F.col("q_a").bitwiseXOR(F.col("fp_a"))) + F.bit_count(F.col("q_b").bitwiseXOR(F.col("fp_b")))).cast("int")
    return left.join(right, ["block", "value"]).withColumn("distance", distance).where(F.col("distance") <= radius).select("q_a", "q_b", "fp_a", "fp_b", "distance", "n").distinct()


def with_next(documents: DataFrame, pieces: int) -> DataFrame:
    """bucket, row, ghost, doc_id, text, next_text: rows in descending doc_id, each with the one after; the first follows the last.

    Rows with equal ids, and those without one at the end, are in the order of a hash of their text. Ids are cut at quantiles
    into about `pieces` buckets, null ids by ranges of the hash. In a bucket a window finds the next row; the first row of each
    bucket is also put at the end of the bucket before it, marked as a ghost, so no window spans the table."""
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / pieces for i in range(1, pieces)] or [0.5], 50 * pieces).alias("cuts")).first()
    cuts = sorted(set(found.cuts or [])) or [0.0]
    dealt = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="d", outputCol="bucket", handleInvalid="keep").transform(docs.withColumn("d", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))))).drop("d")
    dealt = dealt.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1 - F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * pieces)).otherwise(F.col("bucket")))
    down = F.bitwise_not("doc_id")  # falls as the id rises
    top = dealt.groupBy("bucket").agg(F.min(F.struct(down.alias("down"), "h")).alias("top"))
    ring = Window.orderBy(F.desc("bucket"))  # over one row for each bucket
    ahead = top.select("top.*", F.col("bucket").alias("of"), F.lag("bucket").over(ring).alias("before"), F.max("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("highest"), F.min("bucket").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("lowest"))
    ahead = F.broadcast(ahead.select("down", F.col("h").alias("head"), F.coalesce("before", "lowest").alias("to")))
    ghosts = docs.join(ahead, (down.eqNullSafe(F.col("down"))) & (F.col("h") == F.col("head"))).groupBy("doc_id", "h", "to").agg(F.min("text").alias("text"))
    both = dealt.select("bucket", F.lit(0).alias("ghost"), "doc_id", "h", "text").unionByName(ghosts.select(F.col("to").alias("bucket"), F.lit(1).alias("ghost"), "doc_id", "h", "text"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "h", "text")
    return both.select("bucket", "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("row"))


def edited(text: Column, following: Column) -> Column:
    """The last half of the text (rounded down) replaced by as many first characters of the following one."""
    n = F.length(text)
    cut = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def compare(documents: DataFrame, pieces: int) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp_a, fp_b, ed_a, ed_b, next_a, next_b: each row, its edited text and the next row."""
    placed = with_next(documents, pieces)
    change = edited(F.col("text"), F.coalesce("next_text", F.lit("")))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), change.alias("text"))))
    key = ["bucket", "row", "ghost", "doc_id", "n_chars", "edited_sha256"]
    each = placed.select("bucket", "row", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(change, 256).alias("edited_sha256"), kinds.alias("k"))
    prints = fingerprints(each.select(*key, "k.kind", "k.text"), [*key, "kind"])
    of = lambda c, k: F.max(F.when(F.col("kind") == k, F.col(c)))
    rows = prints.groupBy(*key).agg(of("fp_a", 0).alias("fp_a"), of("fp_b", 0).alias("fp_b"), of("fp_a", 1).alias("ed_a"), of("fp_b", 1).alias("ed_b"))
    order = Window.partitionBy("bucket").orderBy("row")
    return rows.select("*", F.lead("fp_a").over(order).alias("next_a"), F.lead("fp_b").over(order).alias("next_b")).where("ghost = 0").drop("bucket", "row", "ghost")


def op3_simhash_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and edited text, their likeness, and for ids divisible by 100 how many rows are within the radius."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = saved(compare(docs, max(64, min(2000, 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))), "op3")
    table = rows.groupBy("fp_a", "fp_b").agg(F.count("*").alias("n"))
    asked = rows.where("doc_id % 100 = 0").select("fp_a", "fp_b").distinct()
    found = within(asked, table).groupBy("q_a", "q_b").agg(F.sum("n").alias("n_within"))
    is_asked = F.coalesce(F.col("doc_id") % 100 == 0, F.lit(False))  # the rest doesn't join, as equal nulls would meet in one task
    met = rows.where(is_asked).join(found.select(F.col("q_a").alias("fp_a"), F.col("q_b").alias("fp_b"), "n_within"), ["fp_a", "fp_b"], "left")
    out = met.unionByName(rows.where(~is_asked).withColumn("n_within", F.lit(None).cast("long")))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", text_of(F.col("fp_a"), F.col("fp_b")).alias("fingerprint"), text_of(F.col("ed_a"), F.col("ed_b")).alias("edited_fingerprint"),
        likeness(F.col("fp_a"), F.col("fp_b"), F.col("ed_a"), F.col("ed_b")).alias("near_edited"), likeness(F.col("fp_a"), F.col("fp_b"), F.col("next_a"), F.col("next_b")).alias("near_next"), "n_within",
    )
