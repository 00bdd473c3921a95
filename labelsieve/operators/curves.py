"""Precision-recall curves, their area, and the threshold with the best F1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.operators.prefix import BUCKET_ROWS, running_totals
from labelsieve.session import spool

# Fixed value: keeps the F1 denominator above zero while tuning.
F1_EPSILON = 1e-8


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives at each distinct score. Combines before the shuffle.

    A null label is an error: it is neither positive nor negative.
    """
    by = list(by)
    unknown = F.raise_error(F.lit(f"null in label column {label!r}")).cast("long")
    positive = F.when(F.col(label).isNotNull(), F.col(label).cast("long")).otherwise(unknown)
    return df.groupBy(*by, F.col(score).alias("threshold")).agg(
        F.sum(positive).alias("pos"), F.count(F.lit(1)).alias("n")
    )


def cumulative_counts(
    counts: DataFrame, by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Running true and false positives from the highest score down.

    ``counts`` comes from :func:`score_counts` and is read more than once: spool
    it, as the functions below do. Each row holds its own ``pos`` and
    ``n`` as well as ``tp``, ``fp`` up to and including its score, and the
    group's ``positives`` and ``rows``.
    """
    ranked = running_totals(counts, "threshold", ["pos", "n"], by, True, bucket_rows)
    return ranked.select(
        *by,
        "threshold",
        "pos",
        "n",
        F.col("cum_pos").alias("tp"),
        (F.col("cum_n") - F.col("cum_pos")).alias("fp"),
        F.col("total_pos").alias("positives"),
        F.col("total_n").alias("rows"),
    )


def _with_rates(points: DataFrame) -> DataFrame:
    """Precision and recall; without any positive, recall is 1 everywhere."""
    tp, fp, positives = F.col("tp"), F.col("fp"), F.col("positives")
    return points.withColumns(
        {
            "precision": tp / (tp + fp),
            "recall": F.when(positives == 0, F.lit(1.0)).otherwise(F.try_divide(tp, positives)),
        }
    )


def curve_points(counts: DataFrame, by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Curve over prepared :func:`score_counts`."""
    return _with_rates(cumulative_counts(counts, by, bucket_rows))


def pr_curve(
    df: DataFrame,
    score: str,
    label: str,
    by: Sequence[str] = (),
    end_point: bool = True,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per distinct score: threshold, precision, recall, tp, fp.

    A row counts as predicted at ``score >= threshold``. The end point (null
    threshold, precision 1, recall 0) closes each group's curve.
    """
    by = list(by)
    counts = spool(score_counts(df, score, label, by))
    points = curve_points(counts, by, bucket_rows).select(
        *by, "threshold", "precision", "recall", "tp", "fp"
    )
    if not end_point:
        return points
    groups = counts.groupBy(*by).agg(F.sum("n").alias("_n")).where(F.col("_n") > 0)
    ends = groups.select(
        *by,
        F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"),
        F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
        F.lit(0).cast("long").alias("tp"),
        F.lit(0).cast("long").alias("fp"),
    )
    return points.unionByName(ends)


def area(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area over recall of :func:`curve_points`, as column ``aucpr``.

    A point's predecessor follows from its own counts (running minus own), so no
    second pass over the order is needed.
    """
    tp0 = F.col("tp") - F.col("pos")
    fp0 = F.col("fp") - (F.col("n") - F.col("pos"))
    at_start = (tp0 + fp0) == 0
    precision0 = F.when(at_start, F.lit(1.0)).otherwise(F.try_divide(tp0, tp0 + fp0))
    recall0 = (
        F.when(at_start, F.lit(0.0))
        .when(F.col("positives") == 0, F.lit(1.0))
        .otherwise(F.try_divide(tp0, F.col("positives")))
    )
    slab = (F.col("recall") - recall0) * (F.col("precision") + precision0) / 2.0
    return points.groupBy(*by).agg(F.sum(slab).alias("aucpr"))


def auc_pr(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Area under the precision-recall curve per group."""
    counts = spool(score_counts(df, score, label, by))
    return area(curve_points(counts, by, bucket_rows), by)


def tune_threshold(
    df: DataFrame, score: str, label: str, by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Score with the best F1 per group, the lowest one on ties.

    F1 is measured at ``score >= threshold``. Label prediction applies thresholds
    with a strict ``>``, so the row that set a threshold is itself not predicted.
    """
    points = curve_points(spool(score_counts(df, score, label, by)), by, bucket_rows)
    p, r = F.col("precision"), F.col("recall")
    f1 = 2.0 * (p * r) / (p + r + F1_EPSILON)
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("low")))
    return (
        points.groupBy(*by)
        .agg(best.alias("_best"))
        .where(F.col("_best").isNotNull())
        .select(*by, (-F.col("_best.low")).alias("threshold"), F.col("_best.f1").alias("f1"))
    )


def label_scores(df: DataFrame, probs: str, truth: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per row and label: ``label_idx``, ``score``, ``label``."""
    paired = F.arrays_zip(F.col(probs).alias("score"), F.col(truth).alias("label"))
    return df.select(*keep, F.posexplode(paired).alias("label_idx", "_pair")).select(
        *keep,
        "label_idx",
        F.col("_pair.score").cast("double").alias("score"),
        F.col("_pair.label").cast("int").alias("label"),
    )


def tune_label_thresholds(
    df: DataFrame, probs: str, truth: str, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """Best-F1 threshold of each label."""
    return tune_threshold(label_scores(df, probs, truth), "score", "label", ["label_idx"], bucket_rows)
