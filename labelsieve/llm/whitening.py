"""Embedding whitening from exact integer cross-products of bit planes.

An entry becomes an integer. A block of rows is shifted to its least value in each
dimension; every bit of every dimension is then a plane of one bit a row, packed into
64-bit words. The population count of two planes' AND, weighted by the two bits, is their
share of the cross-product, so sums and cross-products are exact whatever the order of
rows. They are centred as integers, and only the quotient is rounded before ``eigh``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# An entry c becomes floor(SCALE * c) + OFFSET.
SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
# Rows of a block of bit planes, and words of an intermediate product.
BLOCK_ROWS = 4096
PRODUCT_WORDS = 262_144
# Bits of the parts by which sums travel: parts of many tasks add up within 64 bits.
LIMB = 30
# Components whose eigenvalue is a smaller share of the trace are rounding alone.
LEAST_SHARE = 1e-11
# Entries up to this size are exact in doubles after scaling.
_EXACT = float(1 << 42)


def to_integers(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) + OFFSET of finite doubles, as long or, for huge ones, as Python integers."""
    if not entries.size or np.abs(entries).max() < _EXACT:
        return np.floor(entries * SCALE).astype(np.int64) + OFFSET
    whole = [int(c) * SCALE if abs(c) >= _EXACT else int(np.floor(c * SCALE)) for c in entries.ravel().tolist()]
    return np.array([x + OFFSET for x in whole], dtype=object).reshape(entries.shape)


def bit_planes(values: np.ndarray, bits: int) -> np.ndarray:
    """Planes [bit, dimension, word] of non-negative integers [row, dimension]."""
    rows, dims = values.shape
    padded = -(-rows // 64) * 64
    planes = np.empty((bits, dims, padded // 64), np.uint64)
    for b in range(bits):
        one = np.zeros((dims, padded), bool)
        one[:, :rows] = ((values >> b) & 1).astype(bool).T
        planes[b] = np.packbits(one, axis=1).view(np.uint64)
    return planes


def plane_products(planes: np.ndarray) -> np.ndarray:
    """Sum over bits of 2^(b + c) * popcount(plane b of i AND plane c of j), exact."""
    bits, dims, words = planes.shape
    total = np.zeros((dims, dims), dtype=object)
    step = max(1, PRODUCT_WORDS // max(1, dims * words))
    for b in range(bits):
        for c in range(b, bits):
            counts = np.empty((dims, dims), np.int64)
            for i in range(0, dims, step):
                both = planes[b, i : i + step, None, :] & planes[c, None, :, :]
                counts[i : i + step] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
            if c > b:
                counts = counts + counts.T
            total += counts.astype(object) << (b + c)
    return total


def scatter(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and cross-products of integers [row, dimension], as Python integers."""
    least = values.min(axis=0)
    shifted = values - least
    planes = bit_planes(shifted, int(shifted.max()).bit_length())
    rows, low = len(values), least.astype(object)
    above = shifted.sum(axis=0) if shifted.dtype != object and int(shifted.max()) < 1 << 50 else None
    above = above.astype(object) if above is not None else shifted.astype(object).sum(axis=0)
    mixed = np.outer(low, above)
    return above + low * rows, plane_products(planes) + mixed + mixed.T + np.outer(low, low) * rows


def _limbs(value: int) -> list[int]:
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _sums_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (i, j, limb, value): cross-products of i and j, sums at j = -1, the row count at -1, -1."""
    rows, sums, products = 0, None, None
    for batch in batches:
        lists = batch.column(0)
        if not len(lists):
            continue
        entries = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
        for start in range(0, len(entries), BLOCK_ROWS):
            s, p = scatter(to_integers(entries[start : start + BLOCK_ROWS]))
            rows += len(entries[start : start + BLOCK_ROWS])
            sums, products = (s, p) if sums is None else (sums + s, products + p)
    if not rows:
        return
    found = [(-1, -1, rows), *((i, -1, s) for i, s in enumerate(sums))]
    found += [(i, j, products[i, j]) for i in range(len(sums)) for j in range(i, len(sums))]
    parts = [(i, j, k, part) for i, j, value in found for k, part in enumerate(_limbs(int(value)))]
    columns = list(zip(*parts))
    names, kinds = ("i", "j", "limb", "value"), (pa.int32(), pa.int32(), pa.int32(), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=list(names))


@dataclass
class Whitening:
    """What the fit list gives: its size, sums, and the leading components."""

    n: int
    sums: list[int]
    # Columns: unit eigenvectors over the root of their eigenvalues, by falling eigenvalue.
    axes: np.ndarray
    explained: list[float | None]

    def deviations(self, values: np.ndarray) -> np.ndarray:
        """n * x - S, exact."""
        reach = max(abs(int(values.max())), abs(int(values.min()))) if values.size else 0
        if values.dtype != object and 2 * self.n * (reach + 1) < 1 << 62:
            return values * self.n - np.array(self.sums, np.int64)
        return values.astype(object) * self.n - np.array(self.sums, dtype=object)


def _usable(vector: Column) -> Column:
    """Rows whose vector is there and holds finite numbers only."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _vectors(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Usable rows whose vector has the length that most have (of equal counts the longer)."""
    entries = F.col(vector).cast("array<double>")
    rows = df.where(_usable(entries)).withColumn(vector, entries)
    most = rows.groupBy(F.size(vector).alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = most["dims"] if most else 0
    return rows.where(F.size(vector) == dims), dims


def fit(rows: DataFrame, dims: int, vector: str, components: int = COMPONENTS) -> Whitening | None:
    """Fit on vectors of ``dims`` finite doubles; None without any.

    Each task sends one set of sums; the driver gets dims * (dims + 3) / 2 of them in
    parts, whatever the number of rows.
    """
    parts = rows.select(vector).mapInArrow(_sums_of_task, "i int, j int, limb int, value long")
    found: dict[tuple[int, int], int] = {}
    for r in parts.groupBy("i", "j", "limb").agg(F.sum("value").alias("value")).collect():
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (r["value"] << (LIMB * r["limb"]))
    n = found.get((-1, -1), 0)
    if not n:
        return None
    sums = [found.get((i, -1), 0) for i in range(dims)]
    covariance = np.empty((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            centred = n * found.get((i, j), 0) - sums[i] * sums[j]
            covariance[i, j] = covariance[j, i] = centred / (n * n)
    trace = sum(n * found.get((i, i), 0) - sums[i] * sums[i] for i in range(dims)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    # One sign for all rows: the largest entry of an axis is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    there = values > LEAST_SHARE * trace
    axes = np.full_like(vectors, np.nan)
    axes[:, there] = vectors[:, there] / np.sqrt(values[there])
    return Whitening(n, sums, axes, [float(e / trace) if trace else None for e in values])


def project(model: Whitening, values: np.ndarray) -> np.ndarray:
    """Whitened rows of integers; NaN at components without variance."""
    return (model.deviations(values) / model.n).astype(np.float64) @ model.axes


def _identity_error(rows: DataFrame, model: Whitening, vector: str) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, from the rows themselves."""
    k = model.axes.shape[1]
    n = model.n

    def moments(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        total, square = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if len(batch):
                white = project(model, to_integers(np.stack(batch[vector].to_list())))
                total, square = total + white.sum(axis=0), square + white.T @ white
        yield pd.DataFrame({"s": [total.tolist()], "q": [square.ravel().tolist()]})

    sums = rows.select(vector).mapInPandas(moments, "s array<double>, q array<double>")
    # One row a task: k + k * k numbers, added up by position.
    added = {
        (r["of"], r["at"]): r["v"]
        for name in ("s", "q")
        for r in sums.select(F.lit(name).alias("of"), F.posexplode(name).alias("at", "v"))
        .groupBy("of", "at")
        .agg(F.sum("v").alias("v"))
        .collect()
    }
    mean = np.array([added["s", i] for i in range(k)]) / n
    cov = np.array([added["q", i] for i in range(k * k)]).reshape(k, k) / n - np.outer(mean, mean)
    there = ~np.isnan(model.axes[0])
    off = (np.abs(cov - np.eye(k)))[np.ix_(there, there)]
    return float(off.max()) if off.size else None


_EMPTY = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """A row for each usable vector and leading component of their covariance.

    A row is usable if its vector is there, holds neither null nor NaN nor infinity, and
    has the length that most usable vectors have. Every such row counts, repeated ones
    too, and a null id stays null. ``component`` counts from 1 by falling eigenvalue, up
    to ``components`` or the length of the vectors. ``deviation`` is the exact sum over
    dimensions of (n * x - S)^2: null beyond 64 bits, and ``deviation_digits`` has it as
    text at any size. ``whitened`` is null where a component has no variance (all vectors
    equal, or fewer than components), ``explained`` where none has. Without usable
    vectors there is no row. Other columns are not read, whatever their names.
    """
    rows, dims = _vectors(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v")), "v")
    model = fit(rows, dims, "v", components) if dims else None
    if model is None:
        none = [F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in f"{_EMPTY}, deviation_digits string".split(", ")]
        return rows.where(F.lit(False)).select("vec_id", *none)
    error = _identity_error(rows, model, "v")

    @F.pandas_udf("digits string, white array<double>")
    def whitened(vectors: pd.Series) -> pd.DataFrame:
        values = to_integers(np.stack(vectors.to_list())) if len(vectors) else np.zeros((0, dims), np.int64)
        off = model.deviations(values)
        reach = int(np.abs(off).max()) if off.size else 0
        squares = (off if dims * reach * reach < 1 << 63 else off.astype(object)) ** 2
        digits = [str(d) for d in squares.sum(axis=1).tolist()]
        return pd.DataFrame({"digits": digits, "white": project(model, values).tolist()})

    # The rounding of a quotient that is no number: a component without variance.
    told = F.when(~F.isnan("white"), F.col("white"))
    shares = F.array(*[F.lit(e).cast("double") for e in model.explained])
    return (
        rows.select("vec_id", whitened("v").alias("w"))
        .select("vec_id", F.col("w.digits").alias("digits"), F.posexplode("w.white").alias("at", "white"))
        .select(
            "vec_id",
            (F.col("at") + 1).alias("component"),
            F.lit(model.n).cast("long").alias("n"),
            F.expr("try_cast(digits AS bigint)").alias("deviation"),
            told.alias("whitened"),
            shares[F.col("at")].alias("explained"),
            F.lit(error).cast("double").alias("identity_error"),
            F.col("digits").alias("deviation_digits"),
        )
    )
