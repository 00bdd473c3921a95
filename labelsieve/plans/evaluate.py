"""Score a held-out part and judge stored predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.operators.calibration import ALPHA, flag_uncertain, per_item_loss
from labelsieve.operators.curves import tune_label_thresholds
from labelsieve.operators.metrics import DECISION, binary_metrics, multilabel_metrics
from labelsieve.operators.perplexity import MaskedCounts, score_tokens, text_perplexity
from labelsieve.operators.scoring import BATCH_SIZE, Model, score
from labelsieve.plans.predict_and_flag import MULTI_LABEL, SINGLE_LABEL, check_problem_type, probabilities
from labelsieve.functions.text import model_text
from labelsieve.session import require_columns, spool


def tuned_thresholds(df: DataFrame, probs: str, truth: str, n_labels: int) -> list[float]:
    """Best-F1 threshold of every label, in label order; one number per label on the driver."""
    found = {
        r["label_idx"]: r["threshold"]
        for r in tune_label_thresholds(df, probs, truth).collect()
    }
    return [float(found[i]) for i in range(n_labels)]


def evaluate(
    df: DataFrame,
    problem_type: str,
    labels: Sequence[str],
    probs: str = "probs",
    label: str = "label",
    slice_col: str | None = None,
    thresholds: float | Sequence[float] | None = None,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """Metrics that fit the problem type, long.

    With ``fit_on``, multi-label thresholds are tuned on that frame and applied to
    ``df``; tuning and judging on the same rows would flatter the model.
    """
    check_problem_type(problem_type)
    require_columns(df, [probs, label])
    if problem_type == SINGLE_LABEL:
        return binary_metrics(df, probs, label, slice_col)
    if fit_on is not None:
        thresholds = tuned_thresholds(fit_on, probs, label, len(labels))
    return multilabel_metrics(
        df, probs, label, labels, DECISION if thresholds is None else thresholds, slice_col
    )


def score_held_out(
    df: DataFrame,
    load: Callable[[], Model],
    problem_type: str = SINGLE_LABEL,
    key: str = "row_id",
    text: str = "text",
    label: str = "label",
    counts: MaskedCounts | None = None,
    template: str | None = None,
    chat: tuple[str, str] | None = None,
    alpha: float = ALPHA,
    batch_size: int = BATCH_SIZE,
    eos: str | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """Probabilities, loss, uncertainty flag and, with ``counts``, perplexity per row.

    The scored rows are kept in the shared folder: the loss quantile and the
    result both read them, and the model runs once.
    """
    require_columns(df, [key, text, label])
    prompted = df.withColumn(text, model_text(F.col(text), template, chat, eos, max_length))
    scored = score(prompted, text, load, batch_size).withColumn(
        "probs", probabilities(F.col("logits"), problem_type)
    )
    if problem_type == MULTI_LABEL:
        result = spool(scored.drop("logits"))
    else:
        scored = scored.withColumn("per_item_loss", per_item_loss(F.col("probs"), F.col(label)))
        result = flag_uncertain(spool(scored.drop("logits")), "per_item_loss", alpha)
    if counts is not None:
        tokens = score_tokens(result.select(key, text), counts, key, text)
        result = result.join(text_perplexity(tokens, key, with_tokens=True), key, "left")
    return result
