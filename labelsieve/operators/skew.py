"""Left join to a table of unique keys when a few keys hold most of the left rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.session import spool

# A key is hot above this many rows, and above this share of all rows. The share
# bounds how many hot keys there can be, and with them the broadcast.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 50_000
_SPREAD = 8192


def hot_floor(rows: int, hot_rows: int = HOT_ROWS) -> int:
    """Row count above which a key is hot; fewer than ``MAX_HOT_KEYS`` keys can be."""
    return max(hot_rows, rows // MAX_HOT_KEYS)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    rows: int,
    hot_rows: int = HOT_ROWS,
    key_counts: DataFrame | None = None,
) -> DataFrame:
    """Left join on ``on``; ``right`` has one row per key, ``left`` may be skewed.

    ``rows`` is the number of left rows. Only when it exceeds the floor of a hot
    key are hot keys looked for: in ``key_counts`` (``on`` and ``n``) if the caller
    has them, else by counting ``left``. Their right rows, at most
    ``MAX_HOT_KEYS``, are broadcast; the left rows they serve, and rows with a
    null key, are spread over all tasks by a hash of the ``spread`` columns.
    Other rows meet by a normal shuffle. With hot keys ``right`` serves both ways
    and is written once.
    """
    on = list(on)
    values = [c for c in right.columns if c not in on]
    floor = hot_floor(rows, hot_rows)
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()

    any_hot = False
    if rows > floor:
        if key_counts is None:
            left = spool(left)
            key_counts = left.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
        hot = spool(key_counts.where(F.col("n") > floor).select(*on))
        any_hot = not hot.isEmpty()

    adrift = ~known
    if any_hot:
        right = spool(right)
        served = hot.join(right, on, "left").select(
            *on, F.lit(True).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values]
        )
        left = left.join(F.broadcast(served), on, "left")
        adrift = adrift | F.col("_hot").isNotNull()
    salt = F.when(adrift, F.pmod(F.xxhash64(*spread), F.lit(_SPREAD)) + 1).otherwise(F.lit(0))
    # Always 0, but not a constant: as one it would be folded out of the join key.
    unsalted = F.pmod(F.xxhash64(*on), F.lit(1).cast("long"))
    joined = left.withColumn("_salt", salt.cast("long")).join(
        right.withColumn("_salt", unsalted), [*on, "_salt"], "left"
    )
    if any_hot:
        joined = joined.withColumns(
            {v: F.when(F.col("_hot").isNotNull(), F.col(f"_hot_{v}")).otherwise(F.col(v)) for v in values}
        ).drop("_hot", *[f"_hot_{v}" for v in values])
    return joined.drop("_salt")
