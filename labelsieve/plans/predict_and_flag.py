"""Score unseen text and say which rows a person should look at."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.functions import probabilities as P
from labelsieve.functions.text import json_numbers, json_strings, model_text, present_text
from labelsieve.operators.calibration import (
    ALPHA,
    CONFIDENCE,
    CONFIDENCE_THRESHOLD,
    Calibration,
    confidence_threshold,
)
from labelsieve.operators.review import flag_review, review_summary
from labelsieve.operators.scoring import BATCH_SIZE, Model, remaining, score
from labelsieve.session import GENERATED, read_if_there, require_columns

# Names of the two problem types.
SINGLE_LABEL = "single_label_classification"
MULTI_LABEL = "multi_label_classification"


# Rows that are scored between two commits, and most commits of a run.
COMMIT_ROWS = 1_000_000
MOST_COMMITS = 256


class Classifier(Protocol):
    """A fitted model that scores a frame itself."""

    def logits(self, df: DataFrame, text: str = "text") -> DataFrame: ...


def check_problem_type(problem_type: str) -> None:
    if problem_type not in (SINGLE_LABEL, MULTI_LABEL):
        raise ValueError(f"problem type {problem_type!r} is none of {(SINGLE_LABEL, MULTI_LABEL)}")


def probabilities(logits: Column, problem_type: str) -> Column:
    check_problem_type(problem_type)
    return P.sigmoid(logits) if problem_type == MULTI_LABEL else P.softmax(logits)


def with_predictions(
    df: DataFrame,
    id2label: Mapping[int, str],
    problem_type: str = SINGLE_LABEL,
    multi_label_threshold: float = 0.5,
    logits: str = "logits",
) -> DataFrame:
    """Predicted label, its id, the confidence, and the class probabilities as JSON.

    A multi-label prediction lists all labels at or above the threshold as JSON.
    """
    require_columns(df, [logits])
    scored = df.withColumn("_probs", probabilities(F.col(logits), problem_type))
    probs = F.col("_probs")
    if problem_type == MULTI_LABEL:
        active = P.active_labels(probs, multi_label_threshold)
        columns = {
            "predicted_label": json_strings(P.active_label_names(active, id2label)),
            "predicted_label_id": json_numbers(active, fractions=False),
            CONFIDENCE: P.confidence_multi(probs),
        }
    else:
        best = P.argmax(probs)
        columns = {
            "predicted_label": P.label_name(best, id2label),
            "predicted_label_id": best,
            CONFIDENCE: P.confidence_single(probs),
        }
    columns["class_probabilities"] = json_numbers(probs, fractions=True)
    return scored.withColumns(columns).drop("_probs", logits)


def predict(
    df: DataFrame,
    load: Callable[[], Model] | Classifier,
    id2label: Mapping[int, str],
    text: str = "text",
    problem_type: str = SINGLE_LABEL,
    multi_label_threshold: float = 0.5,
    template: str | None = None,
    chat: tuple[str, str] | None = None,
    batch_size: int = BATCH_SIZE,
    eos: str | None = None,
    max_length: int | None = None,
) -> DataFrame:
    """Prompt, mark the end, cut to ``max_length`` tokens, score and decide. ``text`` in the result is what the model saw.

    ``load`` is the loader of a model, or a fitted classifier (anything with
    ``logits(df, text)``), which then scores in the JVM.
    """
    require_columns(df, [text], "input table")
    check_problem_type(problem_type)
    seen = model_text(present_text(F.col(text)), template, chat, eos, max_length)
    prompted = df.withColumn("text", seen)
    if hasattr(load, "logits"):
        scored = load.logits(prompted, "text")
    else:
        scored = score(prompted, "text", load, batch_size)
    return with_predictions(scored, id2label, problem_type, multi_label_threshold)


def predict_and_flag(
    df: DataFrame,
    load: Callable[[], Model] | Classifier,
    id2label: Mapping[int, str],
    model: str,
    reference: DataFrame | None = None,
    alpha: float = ALPHA,
    default_threshold: float = CONFIDENCE_THRESHOLD,
    confidence_column: str | None = None,
    **options,
) -> tuple[DataFrame, Calibration]:
    """The flagged table and the threshold behind it.

    The threshold comes from the reference alone, so the scored rows are read
    once and the model runs once per row.
    """
    calibration = confidence_threshold(reference, model, alpha, default_threshold, confidence_column)
    return flag_review(predict(df, load, id2label, **options), calibration.threshold), calibration


@dataclass(frozen=True)
class FlaggedTable:
    """Flagged rows as stored, their summary, and the threshold behind both."""

    rows: DataFrame
    summary: DataFrame
    calibration: Calibration


def commit_slice(key: str, slices: int) -> Column:
    """Which of ``slices`` parts of a run a row is scored in, by the digest of its key.

    A power of two of even parts is cut into consecutive slices, so any SQL can tell them.
    Rows without a key are in the first.
    """
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    bucket = F.conv(F.substring(digest, 1, 2), 16, 10).cast("int")
    slice_ = F.floor(bucket * F.lit(slices) / F.lit(MOST_COMMITS)).cast("int")
    return F.when(F.col(key).isNull(), F.lit(0)).otherwise(slice_)


def score_into(
    df: DataFrame,
    out: str,
    load: Callable[[], Model] | Classifier,
    id2label: Mapping[int, str],
    key: str = "row_id",
    resume: bool = True,
    commit_rows: int = COMMIT_ROWS,
    committed: Callable[[int, int], None] | None = None,
    **options,
) -> DataFrame:
    """Score rows into a parquet table, leaving out those it already holds, and read it.

    A repeat after a failure or after new rows scores only what is missing, so the
    model runs once per row. With ``resume=False`` the table must not exist yet. Ids
    that a reader numbered itself (see ``read_labelled_csv``) may move when files are
    added; they are refused for resuming.

    The run is cut by a digest of the key into slices of about ``commit_rows`` rows (at
    most ``MOST_COMMITS``); each is a write of its own, committed before the next begins,
    so a run that ends early keeps its finished slices. ``committed`` is told the slices
    done and their number after each. The input is read once for every slice: against a
    model, reading is cheap.
    """
    require_columns(df, [key], "input table")
    if commit_rows < 1:
        raise ValueError(f"a commit needs a row at least, got {commit_rows}")
    spark = df.sparkSession
    if resume and df.schema[key].metadata.get(GENERATED):
        raise ValueError(f"{key!r} numbers rows as they were read; resume needs ids that stay")
    done = read_if_there(lambda: spark.read.parquet(out)) if resume else None
    rest = df if done is None else remaining(df, done, key)
    slices = max(1, min(MOST_COMMITS, -(-rest.select(key).count() // commit_rows)))
    schema = None
    for k in range(slices):
        # The digest is taken before the join with the finished rows, on both of its sides.
        part = rest.where(commit_slice(key, slices) == k) if slices > 1 else rest
        scored = predict(part, load, id2label, **options)
        scored.write.mode("append" if resume or k else "errorifexists").parquet(out)
        schema = scored.schema
        if committed is not None:
            committed(k + 1, slices)
    return spark.read.schema(schema).parquet(out)


def flag_into(
    df: DataFrame,
    out: str,
    load: Callable[[], Model] | Classifier,
    id2label: Mapping[int, str],
    model: str,
    key: str = "row_id",
    resume: bool = True,
    reference: DataFrame | None = None,
    alpha: float = ALPHA,
    default_threshold: float = CONFIDENCE_THRESHOLD,
    confidence_column: str | None = None,
    **options,
) -> FlaggedTable:
    """Score into ``out``/scores, resuming, and flag all of it into ``out``/flagged.

    Only scoring resumes. The flags of every row, old or new, and the summary come
    from the stored scores under this call's threshold; ``out``/flagged is replaced.
    ``options`` are those of :func:`score_into` and :func:`predict`.
    """
    calibration = confidence_threshold(reference, model, alpha, default_threshold, confidence_column)
    scored = score_into(df, f"{out}/scores", load, id2label, key, resume, **options)
    flag_review(scored, calibration.threshold).write.mode("overwrite").parquet(f"{out}/flagged")
    rows = df.sparkSession.read.parquet(f"{out}/flagged")
    return FlaggedTable(rows, review_summary(rows), calibration)
