"""Model comparison tables out of long metrics (model, slice, metric, value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Slices and metrics of the two report tables.
LANGUAGES = ("all", "english", "italian")
FLAGGED_TABLE = ("flagged/f1", "flagged/aucpr", "flagged/fpr")
AVERAGE_TABLE = ("micro_f1", "macro_f1")
MISSING = 0.0
BEST_TOLERANCE = 1e-3


def single_values(metrics: DataFrame) -> DataFrame:
    """``value`` of each model, slice and metric; one that comes twice is an error."""
    twice = F.raise_error(F.concat(F.lit("measured twice: "), F.concat_ws(", ", "model", "slice", "metric")))
    found = metrics.groupBy("model", "slice", "metric").agg(
        F.any_value("value").alias("value"), F.count(F.lit(1)).alias("_n")
    )
    value = F.when(F.col("_n") == 1, F.col("value")).otherwise(twice.cast("double"))
    return found.withColumn("value", value).drop("_n")


def metric_grid(
    metrics: DataFrame, models: Sequence[str], slices: Sequence[str], names: Sequence[str]
) -> DataFrame:
    """Every model x slice x metric of the report; what was not measured is 0.0.

    The grid is as small as the report, and at most that many measured rows pass
    the filter ahead of the join.
    """
    spark = metrics.sparkSession
    cells = [
        (rank, model, part, name)
        for rank, model in enumerate(models)
        for part in slices
        for name in names
    ]
    grid = spark.createDataFrame(cells, "model_rank int, model string, slice string, metric string")
    wanted = single_values(
        metrics.where(
            F.col("model").isin(*models) & F.col("slice").isin(*slices) & F.col("metric").isin(*names)
        )
    )
    return grid.join(wanted, ["model", "slice", "metric"], "left").withColumn(
        "value", F.coalesce(F.nanvl("value", F.lit(MISSING)), F.lit(MISSING))
    )


def column_name(metric: Column, part: Column) -> Column:
    """``f1_english`` for metric ``flagged/f1`` in slice ``english``."""
    return F.concat_ws("_", F.substring_index(metric, "/", -1), part)


def report_table(
    metrics: DataFrame,
    models: Sequence[str],
    names: Sequence[str] = FLAGGED_TABLE,
    slices: Sequence[str] = LANGUAGES,
    include_all: bool = True,
) -> DataFrame:
    """One row per model in the given order, one column per metric and slice."""
    slices = [s for s in slices if include_all or s != "all"]
    headings = [f"{name.split('/')[-1]}_{part}" for name in names for part in slices]
    return (
        metric_grid(metrics, models, slices, names)
        .withColumn("heading", column_name(F.col("metric"), F.col("slice")))
        .groupBy("model_rank", "model")
        .pivot("heading", headings)
        .agg(F.first("value"))
        .orderBy("model_rank")
    )


def format_cell(value: Column) -> Column:
    return F.format_string("%.3f", value)


def mark_best(
    grid: DataFrame, lower_is_better: Column | None = None, tolerance: float = BEST_TOLERANCE
) -> DataFrame:
    """Mark every value within ``tolerance`` of its column's best.

    The best is the largest, or the smallest where ``lower_is_better`` holds; by
    default that is the false positive rate.
    """
    if lower_is_better is None:
        lower_is_better = F.substring_index("metric", "/", -1) == "fpr"
    column = Window.partitionBy("metric", "slice")
    best = F.when(lower_is_better, F.min("value").over(column)).otherwise(F.max("value").over(column))
    return (
        grid.withColumn("best", best)
        .withColumn("is_best", F.abs(F.col("value") - F.col("best")) < F.lit(tolerance))
        .withColumn("cell", format_cell(F.col("value")))
    )


def best_marks(
    metrics: DataFrame,
    models: Sequence[str],
    names: Sequence[str] = FLAGGED_TABLE,
    slices: Sequence[str] = LANGUAGES,
    include_all: bool = True,
) -> DataFrame:
    """The report in long form with formatted values and the best of each column marked."""
    slices = [s for s in slices if include_all or s != "all"]
    return mark_best(metric_grid(metrics, models, slices, names))
