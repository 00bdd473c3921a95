"""Session helpers: where intermediate tables go, and column checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH_KEY = "spark.checkpoint.dir"
# Marks a column of ids that a reader numbered itself; they may move when files are added.
GENERATED = "labelsieve.generated_id"
_local_scratch: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local-mode session
    without that setting gets a temporary folder of its own.
    """
    named = spark.conf.get(_SCRATCH_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {_SCRATCH_KEY} to a folder that every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="labelsieve-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    return f"{_own_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{scratch_dir(spark).rstrip('/')}/labelsieve/{spark.sparkContext.applicationId}"


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder.

    Call it when the job is done: results that were not written elsewhere still read
    from there.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spool(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For frames that several later passes read: the passes see the same rows even
    when executors are lost, and the upstream plan (a model, say) runs only once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "spool")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_there(read: Callable[[], DataFrame]) -> DataFrame | None:
    """What ``read`` gives, or None when the folder is absent or has no finished file."""
    try:
        return read()
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def fill_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Spread an input that fills fewer tasks than there are cores.

    For costly work per row on a table of few splits. A table of many splits is
    left as it is, so at scale this adds no shuffle; finding out reads no column.
    Behind a join, where Spark merges partitions that are small without the columns,
    rows are dealt out to the session's shuffle partitions, which grow with the job.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    busy = df.select(F.spark_partition_id().alias("p")).distinct().count()
    tasks = max(cores, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys) if busy < cores else df


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "table") -> None:
    """Fail before any job starts, naming every absent column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
