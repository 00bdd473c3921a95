"""Column functions over arrays of class scores. All run in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelsieve.functions.once import once


def softmax(logits: Column) -> Column:
    """Probabilities of mutually exclusive classes."""

    def normalise(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return once(total, lambda t: F.transform(exps, lambda x: x / t))

    return once(
        F.array_max(logits),
        lambda top: once(F.transform(logits, lambda x: F.exp(x - top)), normalise),
    )


def sigmoid(logits: Column) -> Column:
    """Independent probabilities, one per label."""
    return F.transform(logits, lambda x: 1.0 / (1.0 + F.exp(-x)))


def argmax(probs: Column) -> Column:
    """0-based index of the largest entry; the first one on ties."""
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def active_labels(probs: Column, threshold: float = 0.5) -> Column:
    """0-based indices with ``p >= threshold``; NaN is never active."""
    marked = F.transform(
        probs, lambda p, i: F.when((p >= F.lit(threshold)) & ~F.isnan(p), i.cast("int"))
    )
    return F.filter(marked, lambda i: i.isNotNull())


def label_map(id2label: Mapping[int, str]) -> Column:
    """Map literal id -> name; the label set is fixed by the model."""
    pairs = [F.lit(v) for k, name in sorted(id2label.items()) for v in (int(k), str(name))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<int,string>)")


def label_name(index: Column, id2label: Mapping[int, str]) -> Column:
    """Name of a label id; an unknown id becomes its own digits."""
    return F.coalesce(F.try_element_at(label_map(id2label), index.cast("int")), index.cast("string"))


def active_label_names(indices: Column, id2label: Mapping[int, str]) -> Column:
    return F.transform(indices, lambda i: label_name(i, id2label))


def confidence_single(probs: Column) -> Column:
    """Certainty of an exclusive-class prediction: the largest probability."""
    return F.array_max(probs)


def confidence_multi(probs: Column) -> Column:
    """Certainty of a multi-label prediction: the largest distance from 0.5, on 0..1."""
    return F.array_max(F.transform(probs, lambda p: F.abs(p - 0.5) * 2.0))


def hard_predict(probs: Column, thresholds: float | Sequence[float] | Column = 0.5) -> Column:
    """0/1 per label with ``p > threshold``, strictly; NaN is never predicted.

    ``thresholds`` is one number, one number per label, or an array column.
    """

    def above(p: Column, t: Column) -> Column:
        return F.when((p > t) & ~F.isnan(p), 1).otherwise(0)

    if isinstance(thresholds, (int, float)):
        return F.transform(probs, lambda p: above(p, F.lit(float(thresholds))))
    if not isinstance(thresholds, Column):
        thresholds = F.array(*[F.lit(float(t)) for t in thresholds])
    return F.zip_with(probs, thresholds, above)


def numeric(column: Column) -> Column:
    """Number in a cell of any type; what cannot be read as one, and NaN, is null."""
    value = column.cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def row_max(columns: Sequence[str]) -> Column:
    """Largest number over a family of columns, unreadable cells skipped."""
    cells = [numeric(F.col(f"`{c}`")) for c in columns]
    return F.greatest(*cells) if len(cells) > 1 else cells[0]
