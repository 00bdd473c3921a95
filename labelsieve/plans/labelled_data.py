"""From a rated dataset to labelled rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from labelsieve.operators.labels import (
    BINARY_LABELS,
    binarise,
    label_names,
    multi_hot,
    prepare_labelled,
)
from labelsieve.operators.ratings import drop_null, prepare_ratings
from labelsieve.plans.predict_and_flag import MULTI_LABEL, SINGLE_LABEL, check_problem_type
from labelsieve.session import require_columns
from labelsieve.sources.tables import load_splits, read_labelled_csv


@dataclass(frozen=True)
class LabelledData:
    rows: DataFrame
    labels: list[str]

    @property
    def id2label(self) -> dict[int, str]:
        return dict(enumerate(self.labels))

    @property
    def label2id(self) -> dict[str, int]:
        return {name: i for i, name in enumerate(self.labels)}


def label_ratings(
    ratings: DataFrame,
    problem_type: str = MULTI_LABEL,
    rule: str = "",
    label_column: str = "label",
    cluster_mode: str = "all",
    split: str | None = None,
    order: str = "row_id",
) -> LabelledData:
    """Filter and aggregate ratings, drop rows without a label source, label the rest."""
    check_problem_type(problem_type)
    grouped = prepare_ratings(ratings, cluster_mode, order=order, split=split)
    require_columns(grouped, [label_column], "grouped ratings")
    rows = drop_null(grouped, label_column)
    if problem_type == SINGLE_LABEL:
        return LabelledData(binarise(rows, label_column, rule), list(BINARY_LABELS))
    labels = label_names(rows, "label")
    return LabelledData(multi_hot(rows, "label", labels), labels)


def load_labelled(spark: SparkSession, paths: Mapping[str, str], **options) -> LabelledData:
    """Rated splits on disk to labelled rows; every split is aggregated on its own."""
    return label_ratings(load_splits(spark, paths), split="split", **options)


def load_labelled_csv(
    spark: SparkSession,
    path: str,
    text_column: str = "text",
    label_column: str = "label",
    mapping: Mapping[object, int] | None = None,
    literal: bool = False,
) -> LabelledData:
    """A labelled CSV file to rows with ``text`` and a 0/1 ``label``."""
    rows = read_labelled_csv(spark, path, required=[text_column, label_column])
    return LabelledData(
        prepare_labelled(rows, text_column, label_column, mapping, literal), list(BINARY_LABELS)
    )
