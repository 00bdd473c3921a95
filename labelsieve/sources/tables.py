"""Reading and writing the tables of the workflow. Local or cluster paths only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.operators.report import MISSING, single_values
from labelsieve.session import GENERATED, read_if_there, require_columns
from labelsieve.sources.split_csv import csv_records

# Cell texts that mean "missing" in a CSV file.
MISSING_CELLS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


_CSV = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"}


def read_labelled_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    types: Mapping[str, str] | None = None,
    required: Sequence[str] = (),
    row_id: str | None = None,
    multi_line: bool = True,
    split: bool = False,
) -> DataFrame:
    """CSV with a header and doubled quotes.

    Cells read as text; missing-cell texts become null; ``types`` names columns
    to read as numbers, where an unreadable cell becomes null. ``row_id`` adds a
    unique id of this reading; the ids move when files are added, so the column is
    marked and cannot be resumed on. A file with quoted line breaks is read by one
    task; without any, ``multi_line=False`` lets Spark split it.

    With ``split`` many tasks read a file though its cells hold line breaks (see
    :mod:`labelsieve.sources.split_csv`); files must not change between its passes. Ids
    are then texts of a row's file and place in it: they stay when files are added, and
    serve for resuming.
    """
    # With split, only the header is read here.
    raw = spark.read.csv(path, header=True, multiLine=multi_line or split, escape='"', quote='"', inferSchema=False)
    require_columns(raw, [*required, *(types or {})], "CSV file")
    typed = types or {}

    def cell(name: str) -> Column:
        value = F.col(f"`{name}`")
        value = F.when(~value.isin(*MISSING_CELLS), value)
        return (value.try_cast(typed[name]) if name in typed else value).alias(name)

    columns = [cell(c) for c in raw.columns]
    if split:
        records = csv_records(spark, path).where(F.col("number") > 0)
        parsed = F.from_csv("record", ", ".join(f"`{c}` STRING" for c in raw.columns), _CSV)
        rows = records.select(F.concat_ws(":", "file", "number").alias("_place"), parsed.alias("_row"))
        rows = rows.select("_place", *[F.col(f"_row.`{c}`").alias(c) for c in raw.columns])
        return rows.select(*([F.col("_place").alias(row_id)] if row_id else []), *columns)
    if row_id:
        columns.insert(0, F.monotonically_increasing_id().alias(row_id, metadata={GENERATED: True}))
    return raw.select(*columns)


def csv_to_parquet(spark: SparkSession, path: str | Sequence[str], out: str, **options) -> DataFrame:
    """Read CSV once, keep it as parquet, and read that from then on."""
    read_labelled_csv(spark, path, **options).write.parquet(out)
    return spark.read.parquet(out)


def load_splits(
    spark: SparkSession,
    paths: Mapping[str, str],
    split: str = "split",
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """All splits of a dataset as one table with a ``split`` column."""
    if not paths:
        raise ValueError("no splits given")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    parts = [reader.parquet(p).withColumn(split, F.lit(name)) for name, p in paths.items()]
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    return table


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Reference predictions for calibration, CSV or parquet."""
    if path.rstrip("/").endswith(".csv"):
        return read_labelled_csv(spark, path)
    return spark.read.parquet(path)


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, the rest unchanged."""

    def flat(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        nested = isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType))
        return (F.to_json(value) if nested else value).alias(field.name)

    return df.select(*[flat(f) for f in df.schema.fields])


def _write(df: DataFrame, path: str, fmt: str, mode: str) -> None:
    if fmt == "csv":
        csv_ready(df).write.mode(mode).csv(path, header=True, escape='"', quote='"')
    elif fmt in ("parquet", "json"):
        getattr(df.write.mode(mode), fmt)(path)
    else:
        raise ValueError(f"format {fmt!r} is none of parquet, csv, json")


def prediction_columns(
    df: DataFrame,
    model: str,
    probs: str = "probs",
    loss: str | None = None,
    uncertain: str | None = None,
    perplexity: str | None = None,
    token_scores: str | None = None,
) -> DataFrame:
    """Dataset columns plus the model's own, named after the model.

    Two classes give two score columns; they hold probabilities.
    """
    require_columns(df, [c for c in (probs, loss, uncertain, perplexity, token_scores) if c])
    named = {
        f"{model}_logit_class_0": F.element_at(F.col(probs), 1),
        f"{model}_logit_class_1": F.element_at(F.col(probs), 2),
    }
    for column, suffix in (
        (loss, "per_item_loss"),
        (uncertain, "flag_uncertain"),
        (perplexity, "pseudo_perplexity"),
        (token_scores, "token_scores"),
    ):
        if column:
            named[f"{model}_{suffix}"] = F.col(column)
    drop = [c for c in (probs, loss, uncertain, perplexity, token_scores) if c]
    return df.withColumns(named).drop(*drop)


def write_predictions(
    df: DataFrame, path: str, model: str, fmt: str = "parquet", mode: str = "errorifexists", **columns
) -> None:
    _write(prediction_columns(df, model, **columns), path, fmt, mode)


def write_flagged(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The flagged table: input columns and results, a result winning on the same name."""
    _write(df, path, fmt, mode)


def write_metrics(metrics: DataFrame, path: str, model: str | None = None) -> None:
    """Long metrics, one folder per model and slice. A few dozen rows each.

    What is already there of the same model and slice is replaced, all else stays.
    """
    if model is not None:
        metrics = metrics.withColumn("model", F.lit(model))
    require_columns(metrics, ["model", "slice", "metric", "value"], "metrics table")
    writer = metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("model", "slice").json(path)


def read_metrics(
    spark: SparkSession,
    path: str,
    models: Sequence[str],
    slices: Sequence[str],
    names: Sequence[str],
    default: float = MISSING,
) -> DataFrame:
    """Every model x slice x metric asked for; what is not on disk has the default.

    So has all of it if nothing was ever written to ``path``. A metric that is there
    twice is an error.
    """
    schema = "metric string, value double, model string, slice string"
    stored = read_if_there(lambda: spark.read.schema(schema).json(path))
    if stored is None:
        stored = spark.createDataFrame([], schema)
    cells = [(m, s, n) for m in models for s in slices for n in names]
    grid = spark.createDataFrame(cells, "model string, slice string, metric string")
    return grid.join(single_values(stored), ["model", "slice", "metric"], "left").withColumn(
        "value", F.coalesce("value", F.lit(float(default)))
    )
