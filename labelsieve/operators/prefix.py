"""Running totals over a global order, without putting the order in one task.

Rows are cut into consecutive buckets of the order (:mod:`order_tree`), of a bounded
number of rows each. A bucket's total is a small partial aggregate; a bucket starts from
the total of the buckets before it and only its own rows are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.operators.order_tree import find_cuts, with_bucket
from labelsieve.session import spool

# A group of at most this many rows is sorted as one window partition, and a larger one is
# cut into buckets of at most so many.
BUCKET_ROWS = 1_000_000

_BUCKET = "_bucket"
_KIND = "_kind"


def running_totals(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    bucket_rows: int = BUCKET_ROWS,
    spool_large: bool = False,
) -> DataFrame:
    """``cum_<v>`` and ``total_<v>`` for each value column, per group of ``by``.

    ``order`` is numeric, a date or a timestamp, and unique within a group.
    ``cum_<v>`` includes the row itself; ``total_<v>`` is the whole group's sum.
    With ``spool_large`` an input with a large group is written once to the
    shared folder first, for inputs that are costly to compute again.
    """
    by = list(by)
    cuts = find_cuts(df, order, by, bucket_rows)

    def sorted_in(*keys: str):
        return F.col(order).desc() if descending else F.col(order).asc()

    if not cuts:
        window = Window.partitionBy(*by)
        running = window.orderBy(sorted_in()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.select(
            "*",
            *[F.sum(v).over(running).alias(f"cum_{v}") for v in values],
            *[F.sum(v).over(window).alias(f"total_{v}") for v in values],
        )

    if spool_large:
        df = spool(df)
    rows = with_bucket(df, order, by, cuts)

    step = F.col(_BUCKET).desc() if descending else F.col(_BUCKET).asc()
    group = Window.partitionBy(*by)
    before = group.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*by, _BUCKET)
        .agg(*[F.sum(v).alias(v) for v in values])
        .select(
            *by,
            _BUCKET,
            F.lit(0).alias(_KIND),
            *[F.coalesce(F.sum(v).over(before), F.lit(0)).alias(v) for v in values],
            *[F.sum(v).over(group).alias(f"total_{v}") for v in values],
        )
    )
    # One starting row per bucket sorts ahead of the bucket's own rows, so the
    # window alone adds the offset: no join, and null group keys need no care.
    running = (
        Window.partitionBy(*by, _BUCKET)
        .orderBy(F.col(_KIND), sorted_in())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn(_KIND, F.lit(1))
        .unionByName(starts, allowMissingColumns=True)
        .select(
            *df.columns,
            _KIND,
            *[F.sum(v).over(running).alias(f"cum_{v}") for v in values],
            *[F.first(f"total_{v}").over(running).alias(f"total_{v}") for v in values],
        )
        .where(F.col(_KIND) == 1)
        .drop(_KIND)
    )


def with_row_id(
    df: DataFrame, order: str | Sequence[str], name: str = "row_id", bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """0-based position of each row in the order of unique columns.

    With several columns, the first is ordered by totals of its distinct values, and
    the others number the rows within one value; each is numeric, a date or a timestamp.
    """
    columns = [order] if isinstance(order, str) else list(order)
    if not columns:
        raise ValueError("no order columns given")
    return _numbered(df, columns, [], bucket_rows, name)


def _numbered(df: DataFrame, columns: Sequence[str], by: Sequence[str], bucket_rows: int, name: str) -> DataFrame:
    first, rest = columns[0], columns[1:]
    if not rest:
        counted = running_totals(df.withColumn("_one", F.lit(1)), first, ["_one"], by, bucket_rows=bucket_rows)
        return counted.withColumn(name, F.col("cum__one") - 1).drop("_one", "cum__one", "total__one")
    values = spool(df.groupBy(*by, first).agg(F.count(F.lit(1)).alias("_rows")))
    before = running_totals(values, first, ["_rows"], by, bucket_rows=bucket_rows).select(
        *by, first, (F.col("cum__rows") - F.col("_rows")).alias("_before")
    )
    inside = _numbered(df, rest, [*by, first], bucket_rows, name)
    keys = [*by, first]
    before = before.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], "_before")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return (
        inside.join(before, same)
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before", *[f"_key{i}" for i in range(len(keys))])
    )
