"""Stand-in inputs derived from the test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.catalog.registry import table
from labelsieve.functions.probabilities import softmax

# --- ratings: three raters per document, with nulls in rating and cluster ---

RATINGS = """
SELECT d.doc_id * 10 + a AS row_id, d.text, d.lang AS target, d.source AS title,
       CASE WHEN (d.doc_id * 7 + a) % 11 = 0 THEN NULL
            ELSE CAST((d.doc_id * 31 + a * 17) % 5 AS INT) END AS acceptability,
       CASE (d.doc_id + a) % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 END AS cluster,
       CASE WHEN d.doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS split
FROM documents d, (VALUES (1), (2), (3)) t(a)
"""


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, a = F.col("doc_id"), F.col("a")
    return (
        table(spark, sf_dir, "documents")
        .select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("a"))
        .select(
            (doc * 10 + a).alias("row_id"),
            "text",
            F.col("lang").alias("target"),
            F.col("source").alias("title"),
            F.when((doc * 7 + a) % 11 != 0, ((doc * 31 + a * 17) % 5).cast("int")).alias("acceptability"),
            F.when((doc + a) % 3 == 0, 0).when((doc + a) % 3 == 1, 1).alias("cluster"),
            F.when(doc % 2 == 0, "train").otherwise("test").alias("split"),
        )
    )


# --- few keys with many ratings ---

WIDE_RATINGS = """
SELECT event_id AS row_id, event_type AS text, CAST(user_id AS VARCHAR) AS target, '' AS title,
       CAST(event_id % 5 AS INT) AS acceptability, value
FROM events
"""


def wide_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"),
        F.col("event_type").alias("text"),
        F.col("user_id").cast("string").alias("target"),
        F.lit("").alias("title"),
        (F.col("event_id") % 5).cast("int").alias("acceptability"),
        "value",
    )


# --- two logits, their probabilities, a truth and a language ---


def _logit(i: int) -> str:
    return f"CAST(embedding[{i}] AS DOUBLE) * 10"


def softmax_pair_sql(first: str, second: str) -> tuple[str, str]:
    top = f"greatest({first}, {second})"
    e1, e2 = f"exp({first} - {top})", f"exp({second} - {top})"
    return f"({e1} / ({e1} + {e2}))", f"({e2} / ({e1} + {e2}))"


def scores_sql(i: int = 1, j: int = 2) -> str:
    p0, p1 = softmax_pair_sql("l0", "l1")
    return f"""
SELECT row_id, y, lang, l0, l1, {p0} AS p0, {p1} AS p1 FROM (
  SELECT vec_id AS row_id, label % 2 AS y,
         CASE label % 3 WHEN 0 THEN 'english' WHEN 1 THEN 'italian' ELSE 'other' END AS lang,
         {_logit(i)} AS l0, {_logit(j)} AS l1
  FROM embeddings)
"""


SCORES = scores_sql()
TIED_SCORES = f"SELECT row_id, y, lang, round(p0, 1) AS p0, round(p1, 1) AS p1 FROM ({SCORES})"


def _logits(*at: int):
    return F.array(*[F.element_at("embedding", i).cast("double") * 10 for i in at])


def scores(spark: SparkSession, sf_dir: str, i: int = 1, j: int = 2) -> DataFrame:
    label = F.col("label")
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("row_id"),
            (label % 2).alias("y"),
            F.when(label % 3 == 0, "english").when(label % 3 == 1, "italian").otherwise("other").alias("lang"),
            _logits(i, j).alias("logits"),
        )
        .withColumn("probs", softmax(F.col("logits")))
    )


def tied_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).withColumn("probs", F.transform("probs", lambda p: F.round(p, 1)))


# --- four independent labels ---

MULTI_NAMES = ("k0", "k1", "k2", "k3")


def multi_sql(at: tuple[int, ...] = (1, 2, 3, 4)) -> str:
    """One row per row and label: row_id, lang, idx, p, t."""
    cells = " UNION ALL ".join(
        f"SELECT vec_id AS row_id, lang, {k} AS idx, 1 / (1 + exp(-({_logit(i)}))) AS p, "
        f"((label >> {k}) & 1) = 1 AS t FROM e"
        for k, i in enumerate(at)
    )
    return f"""
WITH e AS (SELECT *, CASE label % 3 WHEN 0 THEN 'english' WHEN 1 THEN 'italian' ELSE 'other' END AS lang
           FROM embeddings)
{cells}
"""


def multi(spark: SparkSession, sf_dir: str, at: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """row_id, lang, logits, probs, truth (0.0/1.0 per label) and the same as a struct."""
    label = F.col("label")
    bits = [F.shiftright(label, k).bitwiseAND(1) for k in range(len(at))]
    return (
        table(spark, sf_dir, "embeddings")
        .select(
            F.col("vec_id").alias("row_id"),
            F.when(label % 3 == 0, "english").when(label % 3 == 1, "italian").otherwise("other").alias("lang"),
            _logits(*at).alias("logits"),
            F.array(*[b.cast("double") for b in bits]).alias("truth"),
            F.struct(*[(b == 1).alias(f"k{k}") for k, b in enumerate(bits)]).alias("category"),
            label.alias("label_bits"),
        )
        .withColumn("probs", F.transform("logits", lambda x: 1.0 / (1.0 + F.exp(-x))))
    )


# --- reference predictions for calibration, numbers as CSV text with bad cells ---


def dirty_sql(expr: str) -> str:
    return (
        f"CASE WHEN row_id % 17 = 0 THEN 'abc' WHEN row_id % 19 = 0 THEN 'nan' "
        f"WHEN row_id % 23 = 0 THEN '' ELSE CAST({expr} AS VARCHAR) END"
    )


def clean_sql(column: str) -> str:
    return f"(CASE WHEN isnan(TRY_CAST({column} AS DOUBLE)) THEN NULL ELSE TRY_CAST({column} AS DOUBLE) END)"


def _dirty(value):
    row = F.col("row_id")
    return (
        F.when(row % 17 == 0, "abc")
        .when(row % 19 == 0, "nan")
        .when(row % 23 == 0, "")
        .otherwise(value.cast("string"))
    )


REFERENCE = f"""
SELECT row_id,
       {dirty_sql("-ln(CASE y WHEN 1 THEN p1 ELSE p0 END + 1e-12)")} AS m_per_item_loss,
       {dirty_sql("greatest(p0, p1) * greatest(p0, p1)")} AS my_conf,
       {dirty_sql("greatest(p0, p1)")} AS prediction_confidence,
       {dirty_sql("p0")} AS m_logit_class_0, CAST(p1 AS VARCHAR) AS m_logit_class_1,
       {dirty_sql("p1 * 0.75")} AS other_logit_class_0,
       CASE WHEN row_id % 13 = 0 THEN '[' WHEN row_id % 13 = 1 THEN '[]' WHEN row_id % 13 = 2 THEN '{{}}'
            ELSE '[' || CAST(p0 AS VARCHAR) || ', ' || CAST(p1 AS VARCHAR) || ']' END AS class_probabilities
FROM ({scores_sql(3, 4)})
"""


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p0, p1 = F.element_at("probs", 1), F.element_at("probs", 2)
    top, row = F.greatest(p0, p1), F.col("row_id")
    loss = -F.ln(F.when(F.col("y") == 1, p1).otherwise(p0) + F.lit(1e-12))
    return scores(spark, sf_dir, 3, 4).select(
        "row_id",
        _dirty(loss).alias("m_per_item_loss"),
        _dirty(top * top).alias("my_conf"),
        _dirty(top).alias("prediction_confidence"),
        _dirty(p0).alias("m_logit_class_0"),
        p1.cast("string").alias("m_logit_class_1"),
        _dirty(p1 * F.lit(0.75)).alias("other_logit_class_0"),
        F.when(row % 13 == 0, "[")
        .when(row % 13 == 1, "[]")
        .when(row % 13 == 2, "{}")
        .otherwise(F.concat(F.lit("["), p0.cast("string"), F.lit(", "), p1.cast("string"), F.lit("]")))
        .alias("class_probabilities"),
    )


# --- documents with a human label ---

LABELLED = "SELECT d.doc_id, d.text, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id")
        .select("doc_id", "text", "quality", "toxic")
    )


# --- exact split of a key column ---


def split_sql(source: str, key: str, test: float = 0.2, held: float = 0.1, seed: int = 42) -> str:
    return f"""
SELECT {key}, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + n_eval THEN 'eval' ELSE 'train' END AS split
FROM (SELECT *, CAST(ceil((n - n_test) * CAST({held} AS DOUBLE)) AS BIGINT) AS n_eval
      FROM (SELECT {key}, row_number() OVER (ORDER BY md5('{seed}:' || {key})) AS rn,
                   count(*) OVER () AS n,
                   CAST(ceil(count(*) OVER () * CAST({test} AS DOUBLE)) AS BIGINT) AS n_test
            FROM {source}))
"""
