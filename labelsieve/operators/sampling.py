"""Exact, repeatable splits of a table.

Rows are ordered by a seeded hash of their key. Only the hash at each cut is
looked for, by counting hash prefixes, so giving rows their split is a plain
projection: no row is shuffled or sorted for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Most hash digits per counting pass: 16**4 prefixes.
_DIGITS = 4
# Below this many candidates the cut is read off a short sorted list.
_SHORT_LIST = 10_000


def hash_order(key: str, seed: int = 42) -> Column:
    """Seeded hash of the key; its order is the shuffled order of the rows."""
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), F.col(key).cast("string")))


def _cells(hashes: DataFrame, rows: int, ranks: list[int], prefix: str = "") -> list:
    """The hash prefix that holds each rank, with its row count and the rows up to it."""
    digits = max(1, min(_DIGITS, math.ceil(math.log(rows / _SHORT_LIST, 16))))
    counted = hashes.groupBy(F.substring("h", 1, len(prefix) + digits).alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = F.sum("n").over(
        Window.orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    holds = F.lit(False)
    for k in ranks:
        holds = holds | ((F.col("upto") >= k) & (F.col("upto") - F.col("n") < k))
    found = counted.withColumn("upto", upto).where(holds).collect()
    return [next(c for c in found if c["upto"] >= k > c["upto"] - c["n"]) for k in ranks]


def _cut_hash(hashes: DataFrame, rows: int, k: int, prefix: str = "") -> str:
    """The ``k``-th smallest hash (1-based) of ``rows`` hashes that share a prefix."""
    while rows > _SHORT_LIST and len(prefix) < 32:
        (cell,) = _cells(hashes, rows, [k], prefix)
        k -= cell["upto"] - cell["n"]
        prefix, rows = cell["p"], cell["n"]
        hashes = hashes.where(F.col("h").startswith(prefix))
    short = [] if len(prefix) >= 32 else [r["h"] for r in hashes.orderBy("h").limit(k + 1).collect()]
    if not short or (len(short) > k and short[k] == short[k - 1]):
        raise ValueError("the split key is not unique")
    return short[k - 1]


def _cut_hashes(hashes: DataFrame, rows: int, ranks: list[int]) -> list[str]:
    """The hash at each rank. The first, widest counting pass serves all of them."""
    if rows <= _SHORT_LIST:
        return [_cut_hash(hashes, rows, k) for k in ranks]
    return [
        _cut_hash(
            hashes.where(F.col("h").startswith(cell["p"])),
            cell["n"],
            k - (cell["upto"] - cell["n"]),
            cell["p"],
        )
        for k, cell in zip(ranks, _cells(hashes, rows, ranks))
    ]


def split_sizes(n: int, test_ratio: float, eval_ratio: float) -> tuple[int, int, int]:
    """Rows in train, eval and test: both cuts round up, eval is cut from what test left."""
    for ratio in (test_ratio, eval_ratio):
        if not 0.0 <= ratio < 1.0:
            raise ValueError(f"a split ratio must be in [0, 1), got {ratio}")
    test = math.ceil(n * test_ratio)
    held = math.ceil((n - test) * eval_ratio)
    return n - test - held, held, test


def assign_split(
    df: DataFrame,
    key: str,
    test_ratio: float = 0.2,
    eval_ratio: float = 0.1,
    seed: int = 42,
    name: str = "split",
) -> DataFrame:
    """Add ``train``, ``eval`` or ``test`` to each row; ``key`` is unique and not null.

    With ``test_ratio=0`` this is the two-way split used for labelled files.
    """
    hashes = df.select(hash_order(key, seed).alias("h"))
    sizes = hashes.agg(F.count(F.lit(1)).alias("n"), F.count("h").alias("keyed")).first()
    n = sizes["n"]
    if n < 2:
        raise ValueError(f"at least 2 rows are needed for a split, got {n}")
    if sizes["keyed"] != n:
        raise ValueError(f"split key {key!r} has nulls")
    train, held, test = split_sizes(n, test_ratio, eval_ratio)
    if train < 1:
        raise ValueError(f"no rows are left for training out of {n}")
    # Nested from the last cut to the first: rows up to the first cut are the test part.
    cuts = [(rank, part) for rank, rows, part in ((test, test, "test"), (test + held, held, "eval")) if rows]
    where = F.lit("train")
    limits = _cut_hashes(hashes, n, [rank for rank, _ in cuts]) if cuts else []
    for limit, (_, part) in reversed(list(zip(limits, cuts))):
        where = F.when(F.col("_h") <= F.lit(limit), part).otherwise(where)
    return df.withColumn("_h", hash_order(key, seed)).withColumn(name, where).drop("_h")


def split_part(df: DataFrame, key: str, part: str, **options) -> DataFrame:
    """One part of :func:`assign_split`, for jobs that score or judge only that part."""
    name = options.get("name", "split")
    return assign_split(df, key, **options).where(F.col(name) == part)
