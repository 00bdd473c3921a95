"""Texts of a group joined in order, and cut into parts, without one task sorting the group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.operators.prefix import BUCKET_ROWS, running_totals

# Rows of a group that are joined in one task, and pieces that are joined at a time. They
# decide how the work is spread, not what comes out.
PIECE_ROWS = 65_536
PIECES = 64


def _whole_number(df: DataFrame, order: str) -> None:
    if not isinstance(df.schema[order].dataType, T.IntegralType):
        raise ValueError(f"order column {order!r} must be a whole number")


def join_in_order(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    text: Column,
    separator: str,
    name: str,
    sums: Mapping[str, Column] | None = None,
    first: Sequence[str] = (),
    piece_rows: int = PIECE_ROWS,
    pieces: int = PIECES,
) -> DataFrame:
    """One row per group: its texts joined in order, sums, and the first row's columns.

    ``order`` is a whole-number column, unique within a group; its least value comes
    out under its own name. Null texts are left out. Groups of up to ``piece_rows`` rows
    are joined at once. If there is a larger one, rows are numbered by running totals,
    whatever gaps the order has; each ``piece_rows`` rows become a piece, and ``pieces``
    neighbouring ones become one until a group is whole: no task but the last sees more
    than that. A string beyond Spark's row limit fails the job; nothing is ever cut.
    """
    _whole_number(df, order)
    sums = dict(sums or {})
    quoted = separator.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    rest = F.struct(*[F.col(f"`{c}`") for c in first], F.lit(0).alias("_"))
    rows = df.select(
        *group,
        F.col(order).alias("_least"),
        text.alias("_text"),
        rest.alias("_rest"),
        *[c.alias(f"_sum_{n}") for n, c in sums.items()],
    )

    def joined(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*group, *keys).agg(
            F.min_by("_rest", "_least").alias("_rest"),
            F.expr(f"listagg(`_text`, '{quoted}') WITHIN GROUP (ORDER BY `_least`)").alias("_text"),
            *[F.sum(f"_sum_{n}").alias(f"_sum_{n}") for n in sums],
            F.min("_least").alias("_least"),
        )

    most = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    left = -(-most // piece_rows)
    if left > 1:
        numbered = with_parts(rows, group, "_least", piece_rows, bucket_rows=piece_rows)
        rows = joined(numbered.withColumnRenamed("part", "_piece"), "_piece")
        while left > pieces:
            rows = joined(rows.withColumn("_piece", F.expr(f"_piece div {int(pieces)}")), "_piece")
            left = -(-left // pieces)
    return joined(rows).select(
        *group,
        F.col("_least").alias(order),
        *[F.col(f"_rest.`{c}`").alias(c) for c in first],
        F.col("_text").alias(name),
        *[F.col(f"_sum_{n}").alias(n) for n in sums],
    )


def with_parts(
    df: DataFrame, group: Sequence[str], order: str, part_rows: int, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Add ``part``: 0, 1, 2, ... for every ``part_rows`` rows of a group in order.

    The shape is the same for every group, whatever its size. Rows are counted by
    running totals, so no task sorts a large group.
    """
    _whole_number(df, order)
    if part_rows < 1:
        raise ValueError(f"a part needs a row at least, got {part_rows}")
    counted = running_totals(df.withColumn("_one", F.lit(1)), order, ["_one"], group, bucket_rows=bucket_rows)
    part = F.expr(f"(cum__one - 1) div {int(part_rows)}")
    return counted.withColumn("part", part).drop("_one", "cum__one", "total__one")
