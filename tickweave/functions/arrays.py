"""Array columns: entropy, argmax, element-wise comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def bind(value: Column, use) -> Column:
    """Evaluate ``value`` once and hand it to ``use``; inside a lambda it would run per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(a: Column) -> Column:
    shifted = bind(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    return bind(shifted, lambda e: bind(array_sum(e), lambda s: F.transform(e, lambda x: x / s)))


def normalised_entropy(probs: Column, n: int) -> Column:
    """Entropy over ``ln n`` after clipping to ``[1e-12, 1]`` and renormalising.

    With ``s`` the clipped sum, ``-sum p/s ln(p/s)`` is ``ln s - sum(p ln p)/s``, so the array is walked once.
    """
    clipped = F.transform(probs, lambda x: F.least(F.greatest(x, F.lit(1e-12)), F.lit(1.0)))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("h"))
    both = F.aggregate(
        clipped, start, lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["h"] + x * F.ln(x)).alias("h")),
        lambda acc: F.ln(acc["s"]) - acc["h"] / acc["s"],
    )
    return both / math.log(n)


def argmax(a: Column) -> Column:
    """Zero-based place of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def abs_differences(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))
