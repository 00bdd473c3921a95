"""Per-annotator ratings to one row per rated text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.text import number_text
from labelsieve.operators.parts import PIECE_ROWS, join_in_order, with_parts
from labelsieve.session import require_columns

# Names of the rating table and of the columns derived from it.
KEYS = ("text", "target", "title")
RATING = "acceptability"
CLUSTER = "cluster"
JOINED = "concatenated_acceptability"
MEAN = "average_acceptability"
CLUSTER_MODES = ("all", "cluster 0", "cluster 1")


def drop_null(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value. NaN is a value and stays."""
    return df.where(F.col(column).isNotNull())


def other_cluster(mode: str, cluster: str = CLUSTER) -> Column:
    """Rows that ``mode`` leaves out. A null cluster belongs to both sides."""
    if mode == "all":
        return F.lit(False)
    if mode == "cluster 0":
        return F.col(cluster).eqNullSafe(1)
    if mode == "cluster 1":
        return F.col(cluster).eqNullSafe(0)
    raise ValueError(f"cluster mode {mode!r} is none of {CLUSTER_MODES}")


def filter_cluster(df: DataFrame, mode: str = "all", cluster: str = CLUSTER) -> DataFrame:
    return df if mode == "all" else df.where(~other_cluster(mode, cluster))


def filter_counts(df: DataFrame, steps: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows each filter drops when the filters run in the given order, in one pass.

    ``steps`` maps a name to the condition a row must meet to stay; a null
    condition does not meet it.
    """
    counts = []
    alive = F.lit(True)
    for name, keep in steps.items():
        keep = F.coalesce(keep, F.lit(False))
        counts.append(F.count_if(alive & ~keep).alias(f"dropped_{name}"))
        alive = alive & keep
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("input_rows"), *counts, F.count_if(alive).alias("kept_rows")
    )


def aggregate_ratings(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    rating: str = RATING,
    order: str = "row_id",
    split: str | None = None,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """One row per key: first-seen other columns, all ratings as text, mean as float32.

    ``order`` is a unique whole-number column that says which row came first.
    ``split`` keeps the named splits apart. Whatever a group's size, its row holds the
    mean and the whole string; see :func:`labelsieve.operators.parts.join_in_order`
    for how a large group is spread, and :func:`rating_parts` for strings that would
    not fit a row.
    """
    require_columns(df, [*keys, rating, order, *([split] if split else [])], "ratings table")
    group = [*([split] if split else []), *keys]
    rest = [c for c in df.columns if c not in (*group, rating, order)]
    value = F.col(rating).cast("double")
    text = number_text(F.col(rating), df.schema[rating].dataType.typeName())
    counted = {"_total": value, "_count": value.isNotNull().cast("long")}
    joined = join_in_order(df, group, order, text, ", ", JOINED, counted, rest, piece_rows)
    mean = F.try_divide("_total", "_count").cast("float")
    return joined.withColumn(MEAN, mean).drop("_total", "_count")


def rating_parts(
    df: DataFrame,
    part_rows: int,
    keys: Sequence[str] = KEYS,
    rating: str = RATING,
    order: str = "row_id",
) -> DataFrame:
    """The ratings of each key in strings of ``part_rows`` ratings, for keys of any size.

    A row for each key and ``part`` (0, 1, 2, ...): the first ``order`` value, the
    number of ratings and their string. Joined in order of ``part``, the strings are
    that of :func:`aggregate_ratings`.
    """
    require_columns(df, [*keys, rating, order], "ratings table")
    text = number_text(F.col(rating), df.schema[rating].dataType.typeName())
    rated = drop_null(df.select(*keys, rating, order), rating)
    parts = with_parts(rated, keys, order, part_rows).withColumn("_text", text)
    return parts.groupBy(*keys, "part").agg(
        F.min(order).alias(order),
        F.count(F.lit(1)).alias("n_ratings"),
        F.expr(f"listagg(_text, ', ') WITHIN GROUP (ORDER BY `{order}`)").alias(JOINED),
    )


def prepare_ratings(
    df: DataFrame,
    mode: str = "all",
    keys: Sequence[str] = KEYS,
    rating: str = RATING,
    order: str = "row_id",
    split: str | None = None,
) -> DataFrame:
    """Drop unrated rows, apply the cluster filter, aggregate per key."""
    require_columns(df, [rating, *([CLUSTER] if mode != "all" else [])], "ratings table")
    kept = filter_cluster(drop_null(df, rating), mode)
    return aggregate_ratings(kept, keys, rating, order, split)
