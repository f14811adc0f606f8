"""URL filters: rules, and for urls without a rule logistic regression on hashed character n-grams.

The labelled table is small: urls that a rule decides carry the rule's verdict. It trains a logistic regression
on hashed character n-grams of host and path, which judges the rest. Everything is DataFrame work; the model is
Spark ML's, fitted in the JVM.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, and the model's verdict for an
empty url; repeated rows are judged as often as they occur; where no url has a rule, or all labelled urls agree, that
verdict (allow if there is none) is given; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: host, path, verdict. A rule holds for its host and all subdomains if the path starts with its path; the longest wins.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Lengths of the character n-grams, hash buckets, and the most labelled urls that train the model.
GRAMS, BUCKETS, TRAIN_ROWS = (3, 4, 5), 1 << 13, 4000


def parts(url: Column) -> tuple[Column, Column]:
    """host and path of a url."""
    at = F.when(F.instr(url, "://") > 0, F.instr(url, "://") + 3)
    rest = F.coalesce(F.substring(url, at, F.length(url)), F.lit(""))
    size = F.length(F.regexp_extract(rest, r"^[^/?#]*", 0))
    host = F.translate(F.substring(rest, F.lit(1), size), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(F.substring(rest, size + 1, F.length(rest)), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits as text (host and path joined), and its verdict; nulls where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a later, longer rule goes before the earlier ones
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Character n-grams of both parts, each marked with its part and its beginning and end."""

    def of(mark: str, text: Column, k: int) -> Column:
        held = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.length(held) - k + 1
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.concat(F.lit(mark), F.substring(held, i, F.lit(k))))).otherwise(F.array(F.concat(F.lit(mark), held)))

    return F.flatten(F.array(*(of(m, t, k) for m, t in (("h", host), ("p", path)) for k in GRAMS)))


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, and block_probability: the model's, also where a rule decides."""
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = split.select("*", name.alias("rule"), verdict.alias("by_rule"))
    hashed = HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features")
    known = named.where("by_rule is not null").select("host", "path", "by_rule").distinct()
    small = known.orderBy(F.xxhash64("host", "path"), "host", "path").limit(train_rows)
    table = hashed.transform(small.select((F.col("by_rule") == "block").cast("double").alias("label"), grams(F.col("host"), F.col("path")).alias("grams"))).select("label", "features").cache()
    try:
        kinds = [r.label for r in table.select("label").distinct().collect()]
        if len(kinds) < 2:
            blocked = F.lit(kinds[0] if kinds else 0.0)
            return named.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(blocked > 0.5, "block").otherwise("allow")).alias("verdict"), blocked.alias("block_probability"))
        model = LogisticRegression(regParam=1e-3, maxIter=60, aggregationDepth=2).fit(table)
    finally:
        table.unpersist()
    seen = hashed.transform(named.withColumn("grams", grams(F.col("host"), F.col("path")))).drop("grams")
    scored = model.setProbabilityCol("p").setRawPredictionCol("").setPredictionCol("").transform(seen)
    p = vector_to_array("p")[1]
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"), p.alias("block_probability"))


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
