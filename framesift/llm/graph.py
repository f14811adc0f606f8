"""Connected components of a table of links, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framesift.llm.storage import saved, scratch


#: Steps of pointer jumping in a round: a chain of 2 ** JUMPS hooks becomes one.
JUMPS = 4


def components(links: DataFrame) -> DataFrame:
    """id, label (least id of its component) of every id in links(a, b). No links give no rows.

    Each round hooks every id to its least neighbour if that is smaller, shortens the hooks by pointer jumping, and goes on
    with the links between what is left; links inside what has become one are gone. Each round is written."""
    with scratch(links.sparkSession) as keep:
        return keep(_components(links), "labels")


def _components(links: DataFrame) -> DataFrame:
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "edges")
    labels = None
    while labels is None or edges.limit(1).count():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = ends.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("to"))
        hook = saved(hook, "hooks")
        for _ in range(JUMPS):
            further = hook.select(F.col("id").alias("to"), F.col("to").alias("far"))
            hook = saved(hook.join(further, "to").select("id", F.col("far").alias("to")), "hooks")
        moved = hook.select(F.col("id").alias("label"), "to")
        labels = saved(hook.select("id", F.col("to").alias("label")) if labels is None else labels.join(moved, "label", "left").select("id", F.coalesce("to", "label").alias("label")), "labels")
        left, right = (hook.select(F.col("id").alias(c), F.col("to").alias(f"to_{c}")) for c in ("a", "b"))
        between = edges.join(left, "a").join(right, "b").where("to_a <> to_b")
        edges = saved(between.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, label) after links between labels (la, lb): only the graph of labels that the links join is looked at."""
    between = links.where("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct()
    new = components(between).select(F.col("id").alias("label"), F.col("label").alias("least"))
    return saved(labels.join(new, "label", "left").select("id", F.coalesce("least", "label").alias("label")), "labels")
