"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once even where an inner lambda refers to it again and again."""
    return F.get(F.transform(F.array(value), body), 0)


def word_array(text: Column) -> Column:
    """Lower-cased runs of letters and digits of a text, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def run_hashes(hashed: Column, run: int) -> Column:
    """Hashes of the runs of so many elements of an array of hashes; of all together if there are fewer but at least one."""

    def of(h: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(h) - run, F.lit(0)))
        runs = F.transform(at, lambda i: F.xxhash64(*(F.coalesce(F.get(h, i + k), F.lit(0)) for k in range(run))))
        return F.when(F.size(h) > 0, runs).otherwise(F.array().cast("array<bigint>"))

    return let(hashed, of)
