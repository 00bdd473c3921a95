"""CSV records out of files that many tasks read, though cells hold line breaks.

Every task counts the quotes of its lines. The parity of all quotes before a block says
whether it begins inside a cell, so a first pass over the lines tells each block its state
and how many records begin before it; a second one numbers the lines' records. Only the
lines of records that span several are brought together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Blocks whose states are sent to every task: 64 TB of files in blocks of 128 MB. Larger
# input is an error, to be read in parts or in larger blocks.
MOST_BLOCKS = 500_000

_State = tuple[int, int]


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Lines as they lie in the files, with their file and the place where their block begins."""
    paths = [path] if isinstance(path, str) else list(path)
    raw = spark.read.option("lineSep", "\n").text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value")
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The batch cut where a new block begins."""
    files, blocks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    start = 0
    for i in range(1, len(files) + 1):
        if i == len(files) or (files[i], blocks[i]) != (files[start], blocks[start]):
            yield (files[start], blocks[start]), batch.slice(start, i - start)
            start = i


def _quotes(values: pa.Array) -> np.ndarray:
    return pc.count_substring(values, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block: the parity of its quotes, and the records that begin in it from either state."""
    totals: dict[tuple[str, int], list[int]] = {}
    for batch in batches:
        for key, part in _runs(batch):
            total = totals.setdefault(key, [0, 0, 0])
            quotes = _quotes(part.column(2))
            inside = (total[0] + np.cumsum(quotes) - quotes) & 1
            total[0] = (total[0] + int(quotes.sum())) & 1
            total[1] += int((inside == 0).sum())
            total[2] += int((inside == 1).sum())
    rows = [(f, b, *t) for (f, b), t in totals.items()]
    columns = list(zip(*rows)) or [[]] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["file", "block", "parity", "starts0", "starts1"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _states(lines: DataFrame) -> dict[tuple[str, int], _State]:
    """Whether each block begins inside a cell, and the records of its file that begin before it."""
    counted = lines.mapInArrow(_count, "file string, block long, parity long, starts0 long, starts1 long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.pmod(F.coalesce(F.sum("parity").over(before), F.lit(0)), F.lit(2))
    known = counted.withColumn("inside", inside)
    starts = F.when(F.col("inside") == 0, F.col("starts0")).otherwise(F.col("starts1"))
    known = known.withColumn("starts", starts)
    known = known.withColumn("before", F.coalesce(F.sum("starts").over(before), F.lit(0)))
    found = known.select("file", "block", "inside", "before").limit(MOST_BLOCKS + 1).collect()
    if len(found) > MOST_BLOCKS:
        raise ValueError(f"over {MOST_BLOCKS} blocks; read the files in parts, or in larger blocks")
    return {(r["file"], r["block"]): (r["inside"], r["before"]) for r in found}


def csv_records(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """``file``, ``number`` (from 0, the header) and ``record``: the text of each record.

    Quotes are doubled inside quoted cells. A quote that is never closed makes the rest of
    its file one record. Blank lines outside of cells are left out but numbered.
    """
    lines = _lines(spark, path)
    states = spark.sparkContext.broadcast(_states(lines))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for key, part in _runs(batch):
                # Inside a cell or not, records begun before in the file, lines of the block so far.
                now = state.setdefault(key, [*states.value[key], 0])
                values = part.column(2)
                quotes = _quotes(values)
                inside = (now[0] + np.cumsum(quotes) - quotes) & 1
                begins = inside == 0
                record = now[1] + np.cumsum(begins) - 1
                line = now[2] + np.arange(len(quotes))
                now[0] = (now[0] + int(quotes.sum())) & 1
                now[1] += int(begins.sum())
                now[2] += len(quotes)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(line, pa.int64()),
                        pa.array(record, pa.int64()),
                        pa.array(begins & (quotes % 2 == 0)),
                        values,
                    ],
                    names=["file", "block", "line", "number", "whole", "record"],
                )

    numbered = lines.mapInArrow(
        number, "file string, block long, line long, number long, whole boolean, record string"
    )
    pieces = F.array_sort(F.collect_list(F.struct("block", "line", "record")))
    stitched = (
        numbered.where(~F.col("whole"))
        .groupBy("file", "number")
        .agg(F.array_join(F.transform(pieces, lambda p: p["record"]), "\n").alias("record"))
    )
    all_ = numbered.where("whole").select("file", "number", "record").unionByName(stitched)
    # The end of a line may be two characters; inside a cell both stay.
    return all_.withColumn("record", F.regexp_replace("record", "\r$", "")).where(F.trim("record") != "")
