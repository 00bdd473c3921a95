"""From raw documents to pieces: a training corpus in five stages.

Toxic documents go, then texts of no known language, then all but one document of
each group of near copies, then documents that hold a benchmark item; what is left is
encoded. Each stage is written as Parquet and read again as the next one's input, so a
lost executor costs one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.llm import language, leaks, near, pieces, toxicity
from labelsieve.session import spool

# A document is toxic from this score on.
TOXIC = 0.5
# Phrases a symbol beyond which a text is in none of the learnt languages: its phrases
# are under two letters long.
MOST_PHRASES = 0.6
# Rows that cross into Python at a time: texts may be long, and workers of several stages
# share an executor.
BATCH_ROWS = 2_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, for this session from here on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under ``TOXIC``; null and empty texts stay."""
    _small_batches(spark)
    model = toxicity.fit_on(docs, _table(spark, sf_dir, "labels"))
    return docs.where(toxicity.toxicity(model, F.col("text")) < F.lit(TOXIC))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; null texts and texts without a letter go.

    Without any labelled document nothing can be judged, and all documents stay.
    """
    _small_batches(spark)
    model = language.fit_on(docs)
    if not model.languages:
        return docs
    found: Column = language.language(model, F.col("text"))
    return docs.where((found["lang"] != F.lit(language.UNKNOWN)) & (found["rate"] <= F.lit(MOST_PHRASES)))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies."""
    _small_batches(spark)
    return near.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, exact or near."""
    _small_batches(spark)
    return docs.where(leaks.is_clean(_table(spark, sf_dir, "benchmark"), F.col("text")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of each document, and the text decoded from them."""
    _small_batches(spark)
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_copies", keep_one_of_near_copies),
    ("decontamination", drop_leaks),
    ("pieces", encode),
]

# Models and hashed candidates cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = spool(stage(spark, docs, sf_dir))
    return docs
