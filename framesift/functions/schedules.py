"""Values by step: cosine, linear warm-up and cosine, warm-up and constant."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(step: Column, steps: int, start: float, end: float) -> Column:
    return F.lit(end) + F.lit(0.5 * (start - end)) * (1 + F.cos(F.lit(math.pi) * step / F.lit(max(1, steps))))


def warm_cosine(step: Column, warm: int, steps: int, rate: float, low: float, batch: int) -> Column:
    """From 0 to the top within the warm-up, then along a cosine to the low end. The rate is for batches of 256."""
    top, warm = rate * batch / 256, min(warm, steps)
    return F.when(step < warm, F.lit(top) * step / F.lit(max(1, warm - 1))).otherwise(cosine(step - warm, steps - warm, top, low))


def warm_constant(step: Column, warm: int, start: float, rate: float) -> Column:
    """From the start to the rate within the warm-up, then constant."""
    return F.when(step < warm, F.lit(start) + F.lit(rate - start) * step / F.lit(max(1, warm - 1))).otherwise(F.lit(rate))
