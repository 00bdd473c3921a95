"""Edges that cut the order of large groups into small buckets, found level by level.

A node is a range of values of one group with too many rows. One pass counts all open
nodes in bins between their least and greatest values; neighbouring bins that are small
together make a bucket, and a bin that is still too large is a node of the next level.
The edges are values that occur, so which bucket a row is in does not depend on how bins
were computed. Rows find their bucket in a tree of short lists of edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Most edges of all groups, so that the driver holds a few megabytes however many rows
# there are; beyond MOST_EDGES * bucket_rows rows the buckets grow.
MOST_EDGES = 1_000_000
# Bins of a node at most, and edges in a node of the tree that rows go down.
MOST_BINS = 1024
FANOUT = 64

_BUCKET = "_bucket"
_GREATEST = 1.7976931348623157e308
# How a node's bins lie: evenly, evenly in the logarithm, or by sign alone.
_EVEN, _LOG, _SIGN = 0, 1, 2


def order_value(df: DataFrame, order: str) -> Column:
    """The order column as a double: nulls least, NaN greatest, as Spark sorts them."""
    dates = isinstance(df.schema[order].dataType, T.DateType)
    v = (F.unix_date(order) if dates else F.col(order)).cast("double")
    clamped = F.when(F.isnan(v), F.lit(_GREATEST)).otherwise(F.greatest(F.least(v, F.lit(_GREATEST)), F.lit(-_GREATEST)))
    return F.when(F.col(order).isNull(), F.lit(-_GREATEST)).otherwise(clamped)


@dataclass
class _Node:
    group: int
    low: float
    high: float
    rows: int
    kind: int = _EVEN
    bins: int = 2


@dataclass
class Cut:
    """A large group's key, and its edges in ascending order."""

    key: tuple
    edges: list[float] = field(default_factory=list)


def _same(by: Sequence[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return same


def _by_schema(df: DataFrame, by: Sequence[str]) -> str:
    return "".join(f"`_by{i}` {df.schema[c].dataType.simpleString()}, " for i, c in enumerate(by))


def _bin(value: Column) -> Column:
    """The bin of a value in its node; never falling as the value rises."""
    low, high, bins = F.col("_low"), F.col("_high"), F.col("_bins").cast("double")
    width = high / bins - low / bins
    even = value / width - low / width
    # Of values of one sign.
    ratio = F.ln(F.abs(high)) - F.ln(F.abs(low))
    log = bins * (F.ln(F.abs(value)) - F.ln(F.abs(low))) / ratio
    sign = F.signum(value) + F.lit(1.0)
    at = F.when(F.col("_kind") == _LOG, log).when(F.col("_kind") == _SIGN, sign).otherwise(even)
    return F.greatest(F.lit(0.0), F.least(F.floor(at).cast("double"), bins - 1)).cast("int")


def _prepared(node: _Node, parent: _Node | None, bucket_rows: int) -> _Node:
    """Choose bins: even ones, unless they parted the parent badly."""
    node.bins = max(3, min(MOST_BINS, math.ceil(4 * node.rows / bucket_rows)))
    if parent is not None and 2 * node.rows > parent.rows:
        if node.low > 0 or node.high < 0:
            node.kind = _LOG if parent.kind != _LOG else _EVEN
        elif parent.kind != _SIGN:
            node.kind, node.bins = _SIGN, 3
    return node


def _close(edges: list[float], found: list[Row], node: _Node, bucket_rows: int) -> list[tuple[int, _Node]]:
    """Add the edges of a node's buckets; the bins that stay open come back."""
    still, held, last = [], 0, None
    for r in found:
        wide = r["n"] > bucket_rows and r["a"] < r["b"]
        if last is not None and (wide or held + r["n"] > bucket_rows):
            edges.append(last)
            held = 0
        if wide:
            still.append((r["bin"], _Node(node.group, r["a"], r["b"], r["n"])))
        held = bucket_rows if wide else held + r["n"]
        last = r["b"]
    return still


def find_cuts(df: DataFrame, order: str, by: Sequence[str], bucket_rows: int) -> list[Cut]:
    """Edges of each group of more than ``bucket_rows`` rows.

    Counting comes first: without such a group nothing else is read. Every level reads
    the group and order columns once. Values are unique within a group, so a bucket ends
    up with at most ``bucket_rows`` rows, save for whole numbers beyond 2^53 that share a
    double, a few thousand at most.
    """
    by = list(by)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    seen = sizes.agg(F.max("_n").alias("most"), F.sum("_n").alias("rows")).first()
    if not seen["rows"] or seen["most"] <= bucket_rows:
        return []
    bucket_rows = max(bucket_rows, math.ceil(4 * seen["rows"] / MOST_EDGES))
    value = order_value(df, order)
    large = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_a"), F.max(value).alias("_b"))
        .where((F.col("_n") > bucket_rows) & (F.col("_a") < F.col("_b")))
        .collect()
    )
    cuts = [Cut(tuple(r[c] for c in by)) for r in large]
    nodes = [_prepared(_Node(g, r["_a"], r["_b"], r["_n"]), None, bucket_rows) for g, r in enumerate(large)]
    if not nodes:
        return []
    spark = df.sparkSession
    shape = "_node int, _low double, _high double, _kind int, _bins int"

    def described(open_: list[_Node], keys: list[tuple], schema: str) -> DataFrame:
        rows = [(*k, i, n.low, n.high, n.kind, n.bins) for i, (k, n) in enumerate(zip(keys, open_))]
        return F.broadcast(spark.createDataFrame(rows, f"{schema}{shape}"))

    rows = df.select(*by, value.alias("_value"))
    first = described(nodes, [cuts[n.group].key for n in nodes], _by_schema(df, by))
    rows = rows.join(first, _same(by)) if by else rows.crossJoin(first)
    rows = rows.select("_value", "_node", _bin(F.col("_value")).alias("_bin"))
    while True:
        counted = rows.groupBy("_node", "_bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("_value").alias("a"), F.max("_value").alias("b")
        )
        by_node: dict[int, list[Row]] = {}
        for r in counted.withColumnRenamed("_bin", "bin").orderBy("_node", "bin").collect():
            by_node.setdefault(r["_node"], []).append(r)
        next_: list[tuple[tuple, _Node]] = []
        for i, node in enumerate(nodes):
            for bin_, child in _close(cuts[node.group].edges, by_node.get(i, []), node, bucket_rows):
                next_.append(((i, bin_), _prepared(child, node, bucket_rows)))
        if not next_:
            break
        nodes = [n for _, n in next_]
        table = described(nodes, [k for k, _ in next_], "_from int, _in int, ")
        rows = (
            rows.withColumnsRenamed({"_node": "_up"})
            .join(table, (F.col("_up") == F.col("_from")) & (F.col("_bin") == F.col("_in")))
            .select("_value", "_node", _bin(F.col("_value")).alias("_bin"))
        )
    for cut in cuts:
        cut.edges.sort()
    return cuts


def _below(edges: Column, value: Column) -> Column:
    """How many of a few sorted edges lie below ``value``: a binary search."""
    steps = [2**k for k in reversed(range(math.ceil(math.log2(FANOUT))))]
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, s: F.when(F.try_element_at(edges, at + s) < value, at + s).otherwise(at),
    )


def _levels(edges: list[float], depth: int) -> Iterator[tuple[int, int, list[float]]]:
    """(level, path, separators) of the tree over a group's edges."""
    for level in range(depth):
        inside, below = FANOUT ** (depth - level), FANOUT ** (depth - level - 1)
        for path in range(-(-(len(edges) + 1) // inside)):
            at = range(path * inside + below, min((path + 1) * inside, len(edges) + 1), below)
            yield level, path, [edges[k - 1] for k in at]


def with_bucket(df: DataFrame, order: str, by: Sequence[str], cuts: list[Cut]) -> DataFrame:
    """Add ``_bucket``, the number of edges below the row's value; 0 in groups that are not cut."""
    by = list(by)
    spark = df.sparkSession
    value = order_value(df, order)
    most = max(len(c.edges) for c in cuts)
    depth = max(1, math.ceil(math.log(most + 1, FANOUT) - 1e-9))
    if depth == 1 and not by:
        return df.withColumn(_BUCKET, _below(F.lit(cuts[0].edges), value))
    trees: list[list[tuple]] = [[] for _ in range(depth)]
    for g, cut in enumerate(cuts):
        for level, path, separators in _levels(cut.edges, depth):
            trees[level].append((*cut.key, g, separators) if level == 0 else (g, path, separators))
    root = F.broadcast(spark.createDataFrame(trees[0], f"{_by_schema(df, by)}_group int, _edges array<double>"))
    rows = df.join(root, _same(by), "left") if by else df.crossJoin(root)
    rows = rows.withColumn("_path", _below(F.col("_edges"), value)).drop("_edges", *[f"_by{i}" for i in range(len(by))])
    for level in range(1, depth):
        table = F.broadcast(spark.createDataFrame(trees[level], "_of int, _at int, _edges array<double>"))
        rows = (
            rows.join(table, (F.col("_group") == F.col("_of")) & (F.col("_path") == F.col("_at")), "left")
            .withColumn("_path", F.col("_path") * FANOUT + _below(F.col("_edges"), value))
            .drop("_of", "_at", "_edges")
        )
    return rows.withColumn(_BUCKET, F.coalesce(F.col("_path"), F.lit(0))).drop("_path", "_group")
