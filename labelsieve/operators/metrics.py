"""Classification metrics as long tables: slice, total, metric, value.

The slice over all rows is called ``all`` and has ``total`` set.

Every counting metric comes from one pass that combines map-side; what follows
runs on a handful of count rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.probabilities import hard_predict
from labelsieve.operators.curves import area, curve_points, score_counts
from labelsieve.operators.labels import BINARY_LABELS
from labelsieve.operators.prefix import BUCKET_ROWS
from labelsieve.session import spool

# Name of the slice over all rows, epsilons, decision threshold.
ALL = "all"
FPR_EPSILON = 1e-10
LOSS_EPSILON = 1e-12
DECISION = 0.5

# Metric names of the two problem types, in report order.
BINARY_METRICS = (
    "accuracy",
    "unsafe_precision",
    "unsafe_recall",
    "unsafe_f1",
    "unsafe_fpr",
    "unsafe_aucpr",
    "safe_precision",
    "safe_recall",
    "safe_f1",
    "safe_fpr",
    "safe_aucpr",
)
MULTILABEL_METRICS = (
    "accuracy",
    "macro_f1",
    "macro_precision",
    "macro_recall",
    "micro_f1",
    "micro_precision",
    "micro_recall",
    "flagged/accuracy",
    "flagged/precision",
    "flagged/recall",
    "flagged/f1",
    "flagged/aucpr",
    "flagged/fpr",
)
PER_LABEL_METRICS = ("accuracy", "precision", "recall", "f1", "fpr", "threshold")

_CELLS = ("tn", "fp", "fn", "tp")


def ratio(part: Column, whole: Column) -> Column:
    """Zero when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _count_cells(truth: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
        F.count_if(truth & predicted).alias("tp"),
    ]


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp for labels 0 and 1."""
    truth = known(F.col(label).cast("int"), label) == 1
    return df.groupBy(*by).agg(*_count_cells(truth, F.col(predicted) == 1))


def _rates() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in _CELLS)
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2.0 * tp, 2 * tp + fp + fn),
        "fpr": fp / (fp + tn + F.lit(FPR_EPSILON)),
    }


def with_rates(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and false positive rate next to the four counts."""
    return counts.withColumns(_rates())


def known(label: Column, name: str) -> Column:
    """The label; a null one is an error, as it is neither positive nor negative."""
    unknown = F.raise_error(F.lit(f"null in label column {name!r}"))
    return F.when(label.isNotNull(), label).otherwise(unknown.cast("int"))


def _sliced(counts: DataFrame, slice_col: str | None, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Counts per slice, plus their total as slice ``all``.

    ``total`` tells it from a slice of the data that has that name too.
    """
    total = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
    total = total.select(F.lit(ALL).alias("slice"), F.lit(True).alias("total"), *keys, *sums)
    if slice_col is None:
        return total
    name = F.col(slice_col).cast("string").alias("slice")
    return counts.select(name, F.lit(False).alias("total"), *keys, *sums).unionByName(total)


SLICE = ("slice", "total")


def _long(wide: DataFrame, metrics: Mapping[str, Column], keys: Sequence[str] = ("slice", "total")) -> DataFrame:
    """One row per metric out of one column per metric."""
    cells = F.array(
        *[F.struct(F.lit(m).alias("metric"), c.cast("double").alias("value")) for m, c in metrics.items()]
    )
    return wide.select(*keys, F.explode(cells).alias("_m")).select(*keys, "_m.metric", "_m.value")


def binary_metrics(
    df: DataFrame,
    probs: str,
    label: str,
    slice_col: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Eleven metrics per slice for two-class probabilities ``[safe, unsafe]``.

    Scores are compared as float32. Unsafe is predicted at ``p1 >= 0.5``, safe at
    ``p0 > 0.5``: an even split counts as unsafe only.
    """
    slices = [slice_col] if slice_col else []
    truth = known(F.col(label).cast("int"), label) == 1

    def view(side: str, place: int, positive: Column) -> Column:
        score = F.element_at(F.col(probs), place).cast("float")
        return F.struct(
            F.lit(side).alias("side"), score.alias("threshold"), positive.cast("int").alias("truth")
        )

    # Both views of a row meet in one pass over the data. What is predicted follows
    # from the score alone, so counts per distinct score are all that is needed,
    # and only they are read again.
    views = F.array(view("unsafe", 2, truth), view("safe", 1, ~truth))
    rows = df.select(*slices, F.explode(views).alias("_v")).select(*slices, "_v.*")
    at_score = spool(score_counts(rows, "threshold", "truth", [*slices, "side"]))

    chosen = F.when(
        F.col("side") == "unsafe", F.col("threshold") >= F.lit(DECISION)
    ).otherwise(F.col("threshold") > F.lit(DECISION)) & ~F.isnan("threshold")
    neg = F.col("n") - F.col("pos")
    cells = at_score.groupBy(*slices, "side").agg(
        *[
            F.sum(F.when(side, count).otherwise(0)).alias(name)
            for name, side, count in (
                ("tn", ~chosen, neg),
                ("fp", chosen, neg),
                ("fn", ~chosen, F.col("pos")),
                ("tp", chosen, F.col("pos")),
            )
        ]
    )
    rated = with_rates(_sliced(cells, slice_col, ["side"], _CELLS))
    scores = _sliced(at_score, slice_col, ["side", "threshold"], ["pos", "n"])
    areas = area(curve_points(scores, [*SLICE, "side"], bucket_rows), [*SLICE, "side"])

    both = rated.unionByName(areas, allowMissingColumns=True)

    def of(side: str, metric: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(metric)))

    table = both.groupBy(*SLICE).agg(
        of("unsafe", "accuracy").alias("accuracy"),
        *[
            of(side, metric).alias(f"{side}_{metric}")
            for side in BINARY_LABELS
            for metric in ("precision", "recall", "f1", "fpr", "aucpr")
        ],
    )
    return _long(table, {m: F.col(m) for m in BINARY_METRICS})


def label_confusion(
    df: DataFrame,
    probs: str,
    truth: str,
    thresholds: float | Sequence[float] = DECISION,
    slice_col: str | None = None,
) -> DataFrame:
    """Confusion counts per slice and label, ``label_idx`` from 0.

    Two more rows come out of the same pass: index -1 for "any label", and index
    -2 whose ``tp`` counts rows with every label right.
    """
    slices = [slice_col] if slice_col else []
    rows = df.select(
        *slices,
        F.transform(F.col(truth), lambda t: known(t.cast("int"), truth) == 1).alias("_t"),
        F.transform(hard_predict(F.col(probs), thresholds), lambda p: p == 1).alias("_p"),
    )

    def item(index: Column, t: Column, p: Column) -> Column:
        return F.struct(index.alias("label_idx"), t.alias("t"), p.alias("p"))

    pairs = F.arrays_zip(F.col("_t").alias("t"), F.col("_p").alias("p"))
    items = F.concat(
        F.transform(pairs, lambda c, i: item(i.cast("int"), c["t"], c["p"])),
        F.array(
            item(F.lit(-1), F.array_contains("_t", True), F.array_contains("_p", True)),
            item(F.lit(-2), F.lit(True), F.col("_t") == F.col("_p")),
        ),
    )
    counts = (
        rows.select(*slices, F.explode(items).alias("_i"))
        .select(*slices, "_i.*")
        .groupBy(*slices, "label_idx")
        .agg(*_count_cells(F.col("t"), F.col("p")))
    )
    return _sliced(counts, slice_col, ["label_idx"], _CELLS)


def _hard_aucpr() -> Column:
    """Area of the curve of a 0/1 prediction, from its four counts.

    The curve runs from (recall 0, precision 1) over the predicted rows to all
    rows. With no positive recall is 1 throughout.
    """
    tn, fp, fn, tp = (F.col(c) for c in _CELLS)
    positives, rows, chosen = tp + fn, tn + fp + fn + tp, tp + fp
    recall = F.when(positives == 0, F.lit(1.0)).otherwise(F.try_divide(tp, positives))
    precision = F.try_divide(tp, chosen)
    base = F.try_divide(positives, rows)
    full = F.lit(1.0)
    return (
        F.when(chosen == 0, (base + 1.0) / 2.0)
        .when(chosen == rows, recall * (precision + 1.0) / 2.0)
        .otherwise(recall * (precision + 1.0) / 2.0 + (full - recall) * (base + precision) / 2.0)
    )


def multilabel_metrics(
    df: DataFrame,
    probs: str,
    truth: str,
    names: Sequence[str],
    thresholds: float | Sequence[float] = DECISION,
    slice_col: str | None = None,
) -> DataFrame:
    """Subset accuracy, macro and micro scores, the "any label" block, and each label's block.

    The threshold reported for a label is the one that was applied to it.
    """
    names = list(names)
    # A few rows per slice and label; every metric is read off them.
    counts = spool(label_confusion(df, probs, truth, thresholds, slice_col))
    index = F.col("label_idx")
    rated = with_rates(counts)

    def sum_of(cell: str) -> Column:
        return F.sum(F.when(index >= 0, F.col(cell)))

    def mean_of(rate: str) -> Column:
        return F.avg(F.when(index >= 0, F.col(rate)))

    def any_of(expr: Column) -> Column:
        return F.max(F.when(index == -1, expr))

    wide = rated.groupBy(*SLICE).agg(
        F.max(F.when(index == -2, F.col("recall"))).alias("accuracy"),
        *[mean_of(m).alias(f"macro_{m}") for m in ("f1", "precision", "recall")],
        *[sum_of(c).alias(c) for c in _CELLS],
        *[any_of(F.col(m)).alias(f"flagged/{m}") for m in ("accuracy", "precision", "recall", "f1", "fpr")],
        any_of(_hard_aucpr()).alias("flagged/aucpr"),
    )
    rates = _rates()
    wide = wide.withColumns({f"micro_{m}": rates[m] for m in ("f1", "precision", "recall")})
    overall = _long(wide, {m: F.col(f"`{m}`") for m in MULTILABEL_METRICS})

    if isinstance(thresholds, (int, float)):
        thresholds = [float(thresholds)] * len(names)
    name = F.element_at(F.array(*[F.lit(n) for n in names]), index + 1)
    used = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), index + 1)
    labels = (
        rated.where(index >= 0)
        .withColumns({"_name": name, "threshold": used})
    )
    per_label = _long(labels, {m: F.col(m) for m in PER_LABEL_METRICS}, (*SLICE, "_name")).select(
        *SLICE, F.concat_ws("/", "_name", "metric").alias("metric"), "value"
    )
    return overall.unionByName(per_label)


def mean_cross_entropy(df: DataFrame, probs: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss of the true class."""
    p_true = F.element_at(F.col(probs), F.col(label).cast("int") + 1)
    return df.groupBy(*by).agg(F.avg(-F.ln(p_true + F.lit(LOSS_EPSILON))).alias("eval_loss"))
