"""Score and flag files as they arrive, picking up after the last finished batch."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from labelsieve.operators.calibration import CONFIDENCE_THRESHOLD
from labelsieve.operators.review import flag_review
from labelsieve.operators.scoring import Model
from labelsieve.plans.predict_and_flag import Classifier, predict


def read_text_stream(
    spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def stream_flags(
    source: DataFrame,
    out: str,
    checkpoint: str,
    load: Callable[[], Model] | Classifier,
    id2label: Mapping[int, str],
    threshold: float = CONFIDENCE_THRESHOLD,
    available_now: bool = True,
    **options,
) -> StreamingQuery:
    """Append flagged rows to a parquet folder.

    The threshold is fixed beforehand (see ``confidence_threshold``): a quantile
    over a stream's own rows would change with every batch. A restart with the
    same ``checkpoint`` adds only files that were not finished. With
    ``available_now`` the query stops once it has caught up.
    """
    flagged = flag_review(predict(source, load, id2label, **options), threshold)
    writer = (
        flagged.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
