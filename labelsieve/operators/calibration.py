"""Losses, uncertainty flags, and the thresholds that decide what a person reviews."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions.probabilities import numeric, row_max
from labelsieve.functions.text import json_max
from labelsieve.operators.metrics import LOSS_EPSILON
from labelsieve.operators.quantile import EmptyColumnError, quantile
from labelsieve.session import require_columns

# Defaults of the flagging options.
ALPHA = 0.05
CONFIDENCE_THRESHOLD = 0.60
PPL_PERCENTILE = 95.0

# Columns of prediction tables, and how a threshold's origin is worded.
LOSS_SUFFIX = "_per_item_loss"
CLASS_MARK = "_logit_class_"
PPL_SUFFIX = "_pseudo_perplexity"
CONFIDENCE = "prediction_confidence"
CLASS_PROBABILITIES = "class_probabilities"
SOURCE_FIXED = "fixed"
SOURCE_PREFIX = "reference_csv:"


@dataclass(frozen=True)
class Calibration:
    """A confidence threshold and where it came from."""

    threshold: float
    source: str


def check_alpha(alpha: float) -> None:
    if not 0.0 < alpha < 1.0:
        raise ValueError(f"alpha must lie strictly between 0 and 1, got {alpha}")


def per_item_loss(probs: Column, label: Column) -> Column:
    """Cross-entropy of the true class."""
    return -F.ln(F.element_at(probs, label.cast("int") + 1) + F.lit(LOSS_EPSILON))


def flag_uncertain(
    df: DataFrame, loss: str, alpha: float = ALPHA, name: str = "flag_uncertain", method: str = "exact"
) -> DataFrame:
    """True where the loss lies above its own ``1 - alpha`` quantile.

    The quantile is one number and enters the plan as a literal. Give a frame
    that is cheap to read again, such as a written table.
    """
    check_alpha(alpha)
    return df.withColumn(name, above(F.col(loss), quantile(df, loss, 1.0 - alpha, method)))


def above(value: Column, threshold: float) -> Column:
    """``value > threshold``, where a missing number on either side is not above."""
    if math.isnan(threshold):
        return F.lit(False)
    return F.coalesce((value > F.lit(threshold)) & ~F.isnan(value.cast("double")), F.lit(False))


def below(value: Column, threshold: float) -> Column:
    """``value < threshold``, where a missing number on either side is not below."""
    if math.isnan(threshold):
        return F.lit(False)
    return F.coalesce(value < F.lit(threshold), F.lit(False))


def _confidence_source(
    reference: DataFrame, model: str, confidence_column: str | None
) -> tuple[Column, str]:
    """Confidence per reference row, from the first layout that the table has."""
    if confidence_column is not None:
        require_columns(reference, [confidence_column], "reference table")
        return numeric(F.col(f"`{confidence_column}`")), confidence_column
    if CONFIDENCE in reference.columns:
        return numeric(F.col(CONFIDENCE)), CONFIDENCE
    own = f"{model}{CLASS_MARK}"
    families = (
        ([c for c in reference.columns if c.startswith(own)], f"max({own}*)"),
        ([c for c in reference.columns if CLASS_MARK in c], f"max(*{CLASS_MARK}*)"),
    )
    for columns, wording in families:
        if columns:
            return row_max(columns), wording
    if CLASS_PROBABILITIES in reference.columns:
        return json_max(F.col(CLASS_PROBABILITIES)), CLASS_PROBABILITIES
    raise ValueError(
        f"the reference table has no confidence: name a column, or give {CONFIDENCE!r}, "
        f"'<model>{CLASS_MARK}*' or {CLASS_PROBABILITIES!r}"
    )


def confidence_threshold(
    reference: DataFrame | None,
    model: str,
    alpha: float = ALPHA,
    default: float = CONFIDENCE_THRESHOLD,
    confidence_column: str | None = None,
    method: str = "exact",
) -> Calibration:
    """Confidence below which a row needs review.

    Without reference predictions it is ``default``. A reference with losses of
    this model gives ``exp(-q)`` for the ``1 - alpha`` quantile ``q`` of the loss,
    even when a confidence column is named. Otherwise it is the ``alpha`` quantile
    of the confidence. Cells that are no numbers are left out; a chosen column
    without any number is an error.
    """
    check_alpha(alpha)
    if reference is None:
        return Calibration(default, SOURCE_FIXED)
    loss = f"{model}{LOSS_SUFFIX}"
    if loss in reference.columns:
        try:
            q = quantile(reference, numeric(F.col(f"`{loss}`")), 1.0 - alpha, method)
            return Calibration(math.exp(-q), f"{SOURCE_PREFIX}{loss}->exp(-q_{1 - alpha:.2f})")
        except EmptyColumnError:
            pass
    confidence, wording = _confidence_source(reference, model, confidence_column)
    try:
        return Calibration(quantile(reference, confidence, alpha, method), f"{SOURCE_PREFIX}{wording}")
    except EmptyColumnError as e:
        raise ValueError(f"reference confidence {wording!r} holds no number") from e


def ppl_threshold(
    df: DataFrame,
    column: str,
    absolute: float | None = None,
    percentile: float = PPL_PERCENTILE,
    reference: DataFrame | None = None,
    reference_column: str | None = None,
    model: str | None = None,
    method: str = "exact",
) -> float:
    """Perplexity above which a row is flagged.

    A given number wins, then the percentile of a reference column (by default
    ``<model>_pseudo_perplexity``), then the percentile of ``df``'s own column.
    """
    if absolute is not None:
        return float(absolute)
    if reference is not None:
        wanted = reference_column or f"{model}{PPL_SUFFIX}"
        require_columns(reference, [wanted], "reference table")
        return quantile(reference, F.col(f"`{wanted}`"), percentile / 100.0, method)
    return quantile(df, column, percentile / 100.0, method)
