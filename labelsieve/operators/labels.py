"""Labels: from rules, from boolean structs, and from labelled files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.functions.rules import rule_label
from labelsieve.session import require_columns

# Names of the two classes and label pairs that need no mapping.
BINARY_LABELS = ("safe", "unsafe")
KNOWN_PAIRS = (
    {"0": 0, "1": 1},
    {"false": 0, "true": 1},
    {"safe": 0, "unsafe": 1},
    {"healthy": 0, "unhealthy": 1},
)
# The numeric and the true/false pair count only when both values occur.
_BOTH_NEEDED = 2


def binarise(df: DataFrame, column: str, rule: str = "", name: str = "label") -> DataFrame:
    """Label 1 where the rule on ``column`` holds, else 0."""
    require_columns(df, [column])
    return df.withColumn(name, rule_label(F.col(column), df.schema[column].dataType, rule))


def label_names(df: DataFrame, column: str = "label") -> list[str]:
    """Label names of a struct of booleans, in field order, from the schema."""
    dtype = df.schema[column].dataType
    if not isinstance(dtype, T.StructType):
        raise ValueError(f"{column!r} is not a struct of booleans")
    return dtype.fieldNames()


def multi_hot(
    df: DataFrame,
    column: str = "label",
    labels: Sequence[str] | None = None,
    strict: bool = False,
    name: str = "label",
) -> DataFrame:
    """Struct of booleans to an array of 0.0/1.0 in the order of ``labels``.

    Only true counts; null is 0. With ``strict`` a null stops the job, and so
    does a label the struct lacks.
    """
    known = label_names(df, column)
    labels = list(labels) if labels is not None else known
    absent = [k for k in labels if k not in known]
    if absent:
        raise ValueError(f"{column!r} has no labels {absent}")

    def cell(k: str) -> Column:
        flag = F.col(f"`{column}`.`{k}`")
        value = F.when(flag, F.lit(1.0)).otherwise(F.lit(0.0))
        if strict:
            return F.when(flag.isNull(), F.raise_error(F.lit(f"label {k} is null"))).otherwise(value)
        return value

    return df.withColumn(name, F.array(*[cell(k) for k in labels]))


def normalised(column: Column) -> Column:
    return F.lower(F.trim(column.cast("string")))


def distinct_labels(df: DataFrame, column: str = "label") -> DataFrame:
    """Distinct label values as normalised text, sorted."""
    return (
        df.select(normalised(F.col(column)).alias("value"))
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("value")
    )


def infer_label_mapping(df: DataFrame, column: str = "label") -> dict[str, int]:
    """Mapping for the label pairs known by name.

    At most three distinct values reach the driver: a third one already settles
    that there is no known pair.
    """
    seen = {
        r["value"]
        for r in df.select(normalised(F.col(column)).alias("value"))
        .where(F.col("value").isNotNull())
        .distinct()
        .limit(_BOTH_NEEDED + 1)
        .collect()
    }
    numbers, truths, safety, health = KNOWN_PAIRS
    for pair in (numbers, truths):
        if seen == set(pair):
            return dict(pair)
    for pair in (safety, health):
        if seen <= set(pair):
            return dict(pair)
    raise ValueError(f"no known label pair matches {sorted(seen)}; give a mapping such as {safety}")


def map_label_values(
    column: Column, mapping: Mapping[object, int], literal: bool = False
) -> Column:
    """0/1 for each mapped value, null for the others.

    Values and keys meet as trimmed lower-case text, so ``"Safe"``, 1 and true
    find ``safe``, ``"1"`` and ``"true"``. ``literal`` compares text as it stands.
    """

    def key(k: object) -> str:
        return str(k) if literal else str(k).strip().lower()

    pairs = [F.lit(v) for k, n in mapping.items() for v in (key(k), int(n))]
    value = column.cast("string") if literal else normalised(column)
    return F.try_element_at(F.create_map(*pairs), value)


def prepare_labelled(
    df: DataFrame,
    text_column: str = "text",
    label_column: str = "label",
    mapping: Mapping[object, int] | None = None,
    literal: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Columns ``text`` and ``label`` (0/1) of a labelled table.

    Rows without text or label, and rows whose label is not in the mapping, are
    dropped. Without a mapping it is inferred from the labels themselves.
    """
    require_columns(df, [text_column, label_column, *keep], "labelled table")
    rows = df.select(
        *keep, F.col(text_column).alias("text"), F.col(label_column).alias("label")
    ).where(F.col("text").isNotNull() & F.col("label").isNotNull())
    if mapping is None:
        mapping = infer_label_mapping(rows)
    return rows.withColumn("label", map_label_values(F.col("label"), mapping, literal)).where(
        F.col("label").isNotNull()
    )


def label_distribution(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n_rows"))


def append_train(train: DataFrame, extra: DataFrame) -> DataFrame:
    """Extra labelled rows behind the training rows; absent columns become null.

    Extra text is not run through the prompt template, as the training text was.
    """
    return train.unionByName(extra, allowMissingColumns=True)


def check_vocabulary(data_labels: Mapping[int, str], model_labels: Mapping[int, str]) -> None:
    """The model must know the same labels under the same ids as the data."""
    data = {int(k): v for k, v in data_labels.items()}
    model = {int(k): v for k, v in model_labels.items()}
    if set(data.values()) != set(model.values()):
        raise ValueError(
            f"labels differ: data {sorted(data.values())}, model {sorted(model.values())}"
        )
    if data != model:
        raise ValueError(f"label ids differ: data {data}, model {model}")
