"""Where user code meets the data: model scoring, row and batch functions, joins by row id."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from labelsieve.functions.text import present_text
from labelsieve.session import require_columns

# Fixed value: texts per model call.
BATCH_SIZE = 32

# Texts in, one row of class scores per text out.
Model = Callable[[pd.Series], np.ndarray]


# Models that one worker process keeps, so that several in one plan are not loaded in turn.
KEPT_MODELS = 4
_loaded: dict[str, Model] = {}


def _model(key: str, load: Callable[[], Model]) -> Model:
    """The loaded model; of more than ``KEPT_MODELS`` the one unused for longest goes."""
    model = _loaded.pop(key) if key in _loaded else load()
    while len(_loaded) >= KEPT_MODELS:
        del _loaded[next(iter(_loaded))]
    _loaded[key] = model
    return model


def score_column(
    text: Column, load: Callable[[], Model], batch_size: int = BATCH_SIZE
) -> Column:
    """Class scores of each text as ``array<double>``.

    ``load`` runs once per worker process, which Spark uses again for later tasks, and
    returns the model. Only the text crosses into Python, in Arrow batches; within one
    the texts are taken in order of length, so that texts padded together are of
    similar length.
    """
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, load)
        for texts in batches:
            order = np.argsort(texts.str.len().to_numpy(), kind="stable")
            out: list = [None] * len(texts)
            for start in range(0, len(order), batch_size):
                chosen = order[start : start + batch_size]
                scores = np.asarray(model(texts.iloc[chosen]), dtype=np.float64)
                if scores.shape[0] != len(chosen):
                    raise ValueError(f"the model returned {scores.shape[0]} rows for {len(chosen)} texts")
                for at, row in zip(chosen, scores):
                    out[at] = row
            yield pd.Series(out)

    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(present_text(text))


def score(
    df: DataFrame,
    text: str,
    load: Callable[[], Model],
    batch_size: int = BATCH_SIZE,
    name: str = "logits",
) -> DataFrame:
    """Add the model's class scores. Filter rows before this, not after."""
    require_columns(df, [text])
    return df.withColumn(name, score_column(F.col(text), load, batch_size))


def _fields(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


# Whole numbers and booleans with nulls stay what they are.
_NULLABLE = {
    pa.int8(): pd.Int8Dtype(),
    pa.int16(): pd.Int16Dtype(),
    pa.int32(): pd.Int32Dtype(),
    pa.int64(): pd.Int64Dtype(),
    pa.bool_(): pd.BooleanDtype(),
}


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType
) -> DataFrame:
    """User function over Arrow batches of rows, as frames with nullable types."""
    out = to_arrow_schema(_fields(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = fn(batch.to_pandas(types_mapper=_NULLABLE.get))
            yield pa.RecordBatch.from_pandas(frame, schema=out, preserve_index=False)

    return df.mapInArrow(run, _fields(schema))


def map_rows(df: DataFrame, fn: Callable[[dict], dict], schema: str | T.StructType) -> DataFrame:
    """User function over single rows, given and returned as dicts of plain values."""
    out = to_arrow_schema(_fields(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([fn(row) for row in batch.to_pylist()], schema=out)

    return df.mapInArrow(run, _fields(schema))


def filter_rows(
    df: DataFrame, keep: Callable[[pd.DataFrame], Iterable[bool]], columns: Sequence[str] | None = None
) -> DataFrame:
    """Rows that a user function over batches of ``columns`` (all by default) keeps.

    Only these columns are copied to Python, and what comes back is one boolean a row:
    the rows themselves are never converted. Batches have nullable types, as in
    :func:`map_batches`, so a large whole number stays exact beside a null; a row for
    which the answer is missing is not kept.
    """
    names = list(df.columns if columns is None else columns)
    require_columns(df, names)

    def kept(rows: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_struct_array(rows).to_pandas(types_mapper=_NULLABLE.get)
        answer = pd.array(list(keep(batch)), dtype="boolean")
        return pa.array(answer.fillna(False).to_numpy(dtype=bool))

    kept.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return df.where(F.arrow_udf(kept, "boolean")(F.struct(*[F.col(f"`{c}`") for c in names])))


def check_same_keys(left: DataFrame, right: DataFrame, on: str) -> None:
    """Both tables must hold the same keys, each once. Reads only the key columns."""
    sides = left.select(on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    off = (
        sides.groupBy(on)
        .agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
        .agg(
            F.count_if(F.col("l") > F.col("r")).alias("unscored"),
            F.count_if(F.col("r") > F.col("l")).alias("unknown"),
            F.count_if((F.col("l") == F.col("r")) & (F.col("l") > 1)).alias("repeated"),
        )
        .first()
    )
    if off["unscored"] or off["unknown"] or off["repeated"]:
        raise ValueError(f"rows and predictions do not match on {on!r}: {off.asDict()}")


def attach(df: DataFrame, predictions: DataFrame, on: str = "row_id", check: bool = True) -> DataFrame:
    """Predictions next to their rows, by key. ``check`` compares the keys of both first."""
    if check:
        check_same_keys(df, predictions, on)
    return df.join(predictions, on, "inner")


def remaining(df: DataFrame, done: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows that the output does not hold yet."""
    return df.join(done.select(on), on, "left_anti")
