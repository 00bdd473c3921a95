"""Exact quantiles with linear interpolation, for columns of any size."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.operators.prefix import BUCKET_ROWS, running_totals

# Up to this many values the built-in percentile holds them in one task.
SMALL = 200_000
# Beyond this many values the bracket is sketched from a sample of about as many.
SKETCH_ROWS = 100_000_000
_SKETCH_ACCURACY = 10_000


class EmptyColumnError(ValueError):
    """There is no value to take a quantile of."""


def _interpolate(low: float, high: float, part: float) -> float:
    gap = high - low
    return low + gap * part if part < 0.5 else high - gap * (1.0 - part)


def quantile(
    df: DataFrame,
    value: Column | str,
    q: float,
    method: str = "exact",
    small: int = SMALL,
    bucket_rows: int = BUCKET_ROWS,
) -> float:
    """The ``q`` quantile of the non-null values; NaN when any value is NaN.

    ``exact`` sketches a narrow bracket around the wanted ranks, checks with one
    counting pass that they lie inside (and takes all values if not), then orders
    only the distinct values of the bracket, in buckets. The sketch of a very long
    column looks at a sample; the count and the answer never do. ``approx``
    returns the sketch's answer over all values.
    """
    if not 0.0 <= q <= 1.0:
        raise ValueError(f"quantile must be in [0, 1], got {q}")
    if method not in ("exact", "approx"):
        raise ValueError(f"unknown method {method!r}")
    column = F.col(value) if isinstance(value, str) else value
    values = df.select(column.cast("double").alias("v")).where(F.col("v").isNotNull())

    stats = values.agg(F.count("v").alias("n"), F.count_if(F.isnan("v")).alias("bad")).first()
    n = stats["n"]
    if n == 0:
        raise EmptyColumnError("no values to take a quantile of")
    if stats["bad"]:
        return math.nan
    if method == "approx":
        return float(values.agg(F.percentile_approx("v", q, _SKETCH_ACCURACY).alias("p")).first()["p"])
    if n <= small:
        return float(values.agg(F.percentile("v", F.lit(q)).alias("p")).first()["p"])

    looked_at, margin = values, 2.0 / _SKETCH_ACCURACY
    if n > SKETCH_ROWS:
        looked_at = values.sample(SKETCH_ROWS / n, seed=0)
        margin += 6.0 * math.sqrt(q * (1.0 - q) / SKETCH_ROWS)
    ends = [max(0.0, q - margin), min(1.0, q + margin)]
    low, high = looked_at.agg(F.percentile_approx("v", ends, _SKETCH_ACCURACY).alias("p")).first()["p"]

    rank = (n - 1) * q
    first, last = math.floor(rank), math.ceil(rank)
    inside = (F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high))
    seen = values.agg(
        F.count_if(F.col("v") < F.lit(low)).alias("below"), F.count_if(inside).alias("inside")
    ).first()
    below = seen["below"]
    if below <= first and last < below + seen["inside"]:
        values = values.where(inside)
    else:
        below = 0
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    ranked = running_totals(counts, "v", ["k"], bucket_rows=bucket_rows, spool_large=True)
    found = ranked.agg(
        F.min(F.when(F.col("cum_k") > F.lit(first - below), F.col("v"))).alias("a"),
        F.min(F.when(F.col("cum_k") > F.lit(last - below), F.col("v"))).alias("b"),
    ).first()
    return float(_interpolate(found["a"], found["b"], rank - first))
