"""Predictions, losses, thresholds, review flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.catalog import fixtures as fx
from labelsieve.catalog.registry import query, r6, s6, table
from labelsieve.functions import probabilities as P
from labelsieve.functions.text import json_numbers, json_strings
from labelsieve.operators.calibration import (
    Calibration,
    confidence_threshold,
    flag_uncertain,
    per_item_loss,
)
from labelsieve.operators.metrics import mean_cross_entropy
from labelsieve.operators.quantile import quantile
from labelsieve.operators.review import flag_review, review_summary
from labelsieve.operators.scoring import attach
from labelsieve.plans.predict_and_flag import MULTI_LABEL, with_predictions
from labelsieve.session import scratch_path
from labelsieve.sources.tables import read_reference, write_flagged

ID2LABEL = {0: "safe", 1: "unsafe"}

# --- predictions ---


@query(f"""
SELECT row_id, {s6("p0")} AS p_safe, {s6("p1")} AS p_unsafe,
       CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS predicted_label_id,
       CASE WHEN p0 >= p1 THEN 'safe' ELSE '1' END AS predicted_label,
       {s6("greatest(p0, p1)")} AS prediction_confidence
FROM ({fx.SCORES})
""")
def softmax_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Only one id has a name here: the other one shows as its digits.
    probs = P.softmax(F.col("logits"))
    best = P.argmax(F.col("p"))
    return (
        fx.scores(spark, sf_dir)
        .withColumn("p", probs)
        .select(
            "row_id",
            r6(F.element_at("p", 1)).alias("p_safe"),
            r6(F.element_at("p", 2)).alias("p_unsafe"),
            best.alias("predicted_label_id"),
            P.label_name(best, {0: "safe"}).alias("predicted_label"),
            r6(P.confidence_single(F.col("p"))).alias("prediction_confidence"),
        )
    )


_NAMED = "CASE idx WHEN 0 THEN 'k0' WHEN 1 THEN 'k1' WHEN 2 THEN 'ké\"2' ELSE '3' END"


@query(f"""
SELECT row_id,
       '[' || coalesce(string_agg(CAST(idx AS VARCHAR), ', ' ORDER BY idx) FILTER (p >= 0.5), '') || ']'
         AS predicted_label_id,
       '[' || coalesce(string_agg(CAST(to_json({_NAMED}) AS VARCHAR), ', ' ORDER BY idx) FILTER (p >= 0.5), '') || ']'
         AS predicted_label,
       count(*) FILTER (p >= 0.5) AS n_active,
       {s6("max(abs(p - 0.5) * 2)")} AS prediction_confidence
FROM ({fx.multi_sql()}) GROUP BY row_id
""")
def sigmoid_active_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {0: "k0", 1: "k1", 2: 'ké"2'}
    rows = fx.multi(spark, sf_dir).withColumn("p", P.sigmoid(F.col("logits")))
    active = P.active_labels(F.col("p"), 0.5)
    return rows.select(
        "row_id",
        json_numbers(active, fractions=False).alias("predicted_label_id"),
        json_strings(P.active_label_names(active, names)).alias("predicted_label"),
        F.size(active).cast("long").alias("n_active"),
        r6(P.confidence_multi(F.col("p"))).alias("prediction_confidence"),
    )


_CUTS = (0.3, 0.5, 0.6, 0.7)


@query(f"""
SELECT row_id, {", ".join(f"max(CASE WHEN idx = {k} AND p > {c} THEN 1 ELSE 0 END) AS k{k}" for k, c in enumerate(_CUTS))}
FROM ({fx.multi_sql()}) GROUP BY row_id
""")
def hard_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.multi(spark, sf_dir).withColumn("h", P.hard_predict(F.col("probs"), _CUTS))
    return rows.select("row_id", *[F.element_at("h", k + 1).alias(f"k{k}") for k in range(4)])


@query(f"""
SELECT e.vec_id AS row_id, e.label, {s6("s.p1")} AS p_unsafe
FROM embeddings e JOIN ({fx.SCORES}) s ON e.vec_id = s.row_id
""")
def attach_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "label")
    predictions = fx.scores(spark, sf_dir).select("row_id", "probs")
    return attach(rows, predictions).select(
        "row_id", "label", r6(F.element_at("probs", 2)).alias("p_unsafe")
    )


# --- losses ---

_LOSS = "-ln(CASE y WHEN 1 THEN p1 ELSE p0 END + 1e-12)"


def _with_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.scores(spark, sf_dir).withColumn("loss", per_item_loss(F.col("probs"), F.col("y")))


@query(f"SELECT row_id, {s6(_LOSS)} AS per_item_loss FROM ({fx.SCORES})", "per_item_loss")
def per_item_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_loss(spark, sf_dir).select("row_id", r6("loss").alias("per_item_loss"))


@query(f"""
WITH l AS (SELECT row_id, {_LOSS} AS loss FROM ({fx.SCORES}))
SELECT row_id, loss > (SELECT quantile_cont(loss, 0.95) FROM l) AS flag_uncertain FROM l
""")
def conformal_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag_uncertain(_with_loss(spark, sf_dir), "loss").select("row_id", "flag_uncertain")


@query(f"SELECT lang, {s6(f'avg({_LOSS})')} AS eval_loss FROM ({fx.SCORES}) GROUP BY lang")
def eval_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mean_cross_entropy(fx.scores(spark, sf_dir), "probs", "y", ["lang"])
    return rows.select("lang", r6("eval_loss").alias("eval_loss"))


@query(f"""
SELECT {s6("quantile_cont(value, 0.95)")} AS q95, {s6("quantile_cont(value, 0.333)")} AS q333 FROM events
""")
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Limits far below the defaults, so that even this table takes the distributed way.
    values = table(spark, sf_dir, "events")
    found = [quantile(values, "value", q, small=100, bucket_rows=500) for q in (0.95, 0.333)]
    return spark.range(1).select(r6(F.lit(found[0])).alias("q95"), r6(F.lit(found[1])).alias("q333"))


# --- confidence thresholds, one query per layout of the reference table ---


def _threshold_sql(expr: str, source: str, where: str = "true") -> str:
    return f"""
SELECT {s6(expr)} AS threshold, '{source}' AS source FROM ({fx.REFERENCE}) WHERE {where}
"""


def _as_row(spark: SparkSession, found: Calibration) -> DataFrame:
    return spark.range(1).select(
        r6(F.lit(found.threshold)).alias("threshold"), F.lit(found.source).alias("source")
    )


def _calibrate(spark: SparkSession, sf_dir: str, columns: list[str], **options) -> DataFrame:
    reference = fx.reference(spark, sf_dir).select("row_id", *columns)
    return _as_row(spark, confidence_threshold(reference, "m", **options))


@query(
    _threshold_sql(
        f"exp(-quantile_cont({fx.clean_sql('m_per_item_loss')}, 0.95))",
        "reference_csv:m_per_item_loss->exp(-q_0.95)",
    )
)
def threshold_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The loss wins over a named confidence column.
    columns = ["m_per_item_loss", "my_conf", "prediction_confidence"]
    return _calibrate(spark, sf_dir, columns, confidence_column="my_conf")


@query(_threshold_sql(f"quantile_cont({fx.clean_sql('my_conf')}, 0.1)", "reference_csv:my_conf"))
def threshold_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["my_conf", "prediction_confidence"]
    return _calibrate(spark, sf_dir, columns, alpha=0.1, confidence_column="my_conf")


@query(
    _threshold_sql(
        f"quantile_cont({fx.clean_sql('prediction_confidence')}, 0.05)",
        "reference_csv:prediction_confidence",
    )
)
def threshold_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate(spark, sf_dir, ["prediction_confidence", "class_probabilities"])


def _calibrate_from(spark: SparkSession, sf_dir: str, fmt: str, **options) -> DataFrame:
    """Calibrate on a reference that an earlier run has stored."""
    path = f"{scratch_path(spark, 'reference')}.{fmt}"
    write_flagged(fx.reference(spark, sf_dir), path, fmt)
    return _as_row(spark, confidence_threshold(read_reference(spark, path), "m", **options))


@query(
    _threshold_sql(
        f"exp(-quantile_cont({fx.clean_sql('m_per_item_loss')}, 0.95))",
        "reference_csv:m_per_item_loss->exp(-q_0.95)",
    )
)
def threshold_from_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate_from(spark, sf_dir, "csv")


@query(
    _threshold_sql(
        f"exp(-quantile_cont({fx.clean_sql('m_per_item_loss')}, 0.8))",
        "reference_csv:m_per_item_loss->exp(-q_0.80)",
    )
)
def threshold_from_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate_from(spark, sf_dir, "parquet", alpha=0.2)


def _greatest(*columns: str) -> str:
    return f"quantile_cont(greatest({', '.join(fx.clean_sql(c) for c in columns)}), 0.05)"


@query(
    _threshold_sql(
        _greatest("m_logit_class_0", "m_logit_class_1"), "reference_csv:max(m_logit_class_*)"
    )
)
def threshold_class_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate(spark, sf_dir, ["m_logit_class_0", "m_logit_class_1", "other_logit_class_0"])


@query(_threshold_sql(_greatest("other_logit_class_0"), "reference_csv:max(*_logit_class_*)"))
def threshold_any_class_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate(spark, sf_dir, ["other_logit_class_0", "class_probabilities"])


@query(
    _threshold_sql(
        "quantile_cont(list_max(TRY_CAST(class_probabilities AS DOUBLE[])), 0.05)",
        "reference_csv:class_probabilities",
    )
)
def threshold_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrate(spark, sf_dir, ["class_probabilities"])


# --- review flags ---

_CONFIDENCE_CUT = (
    f"(SELECT quantile_cont({fx.clean_sql('prediction_confidence')}, 0.05) FROM ({fx.REFERENCE}))"
)
_FLAGS = f"""
SELECT row_id, lang, CASE WHEN p0 >= p1 THEN 'safe' ELSE 'unsafe' END AS predicted_label,
       CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS predicted_label_id,
       {s6("greatest(p0, p1)")} AS prediction_confidence,
       greatest(p0, p1) < {_CONFIDENCE_CUT} AS flag_low_confidence,
       false AS flag_high_ppl,
       greatest(p0, p1) < {_CONFIDENCE_CUT} AS manual_review,
       CASE WHEN greatest(p0, p1) < {_CONFIDENCE_CUT} THEN 'low_confidence' ELSE '' END AS manual_review_reason
FROM ({fx.SCORES})
"""


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = fx.reference(spark, sf_dir).select("prediction_confidence")
    cut = confidence_threshold(reference, "m").threshold
    rows = fx.scores(spark, sf_dir).select("row_id", "lang", "logits")
    return flag_review(with_predictions(rows, ID2LABEL), cut)


@query(_FLAGS)
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _flagged(spark, sf_dir)
        .drop("class_probabilities")
        .withColumn("prediction_confidence", r6("prediction_confidence"))
    )


@query(f"""
SELECT lang, count(*) FILTER (manual_review) AS flagged, count(*) AS total,
       {s6("100.0 * count(*) FILTER (manual_review) / count(*)")} AS percent
FROM ({_FLAGS}) GROUP BY lang
""", "review_summary")
def review_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review_summary(_flagged(spark, sf_dir), ["lang"]).withColumn("percent", r6("percent"))


@query(f"""
SELECT row_id, '[' || coalesce(string_agg('k' || idx, ', ' ORDER BY idx) FILTER (p >= 0.7), '') || ']' AS labels,
       {s6("max(abs(p - 0.5) * 2)")} AS prediction_confidence,
       max(abs(p - 0.5) * 2) < 0.6 AS manual_review
FROM ({fx.multi_sql()}) GROUP BY row_id
""")
def review_flags_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.multi(spark, sf_dir).select("row_id", "logits")
    predicted = with_predictions(rows, dict(enumerate(fx.MULTI_NAMES)), MULTI_LABEL, 0.7)
    return flag_review(predicted, 0.6).select(
        "row_id",
        F.replace("predicted_label", F.lit('"'), F.lit("")).alias("labels"),
        r6("prediction_confidence").alias("prediction_confidence"),
        "manual_review",
    )
