"""Whole flows: scoring through a model hook, resume, streaming, files, training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.catalog import fixtures as fx
from labelsieve.catalog.registry import query, r6, s6, table
from labelsieve.catalog.text_queries import TOKENS_SQL, masked_sql
from labelsieve.operators import labels as lab
from labelsieve.operators.metrics import confusion
from labelsieve.operators.perplexity import count_tokens
from labelsieve.operators.sampling import assign_split
from labelsieve.operators.scoring import filter_rows, map_batches, map_rows, remaining
from labelsieve.plans.evaluate import score_held_out
from labelsieve.plans.count_classifier import CountClassifier
from labelsieve.plans.predict_and_flag import FlaggedTable, flag_into, predict, predict_and_flag, score_into
from labelsieve.plans.train import COUNTS, TrainingRun, train_text_classifier
from labelsieve.session import scratch_path, spool
from labelsieve.sources.tables import prediction_columns, read_labelled_csv, write_flagged
from labelsieve.streaming.flags import read_text_stream, stream_flags

ID2LABEL = {0: "safe", 1: "unsafe"}


def length_model() -> Callable:
    """Loader of a stand-in model: a text is unsafe by its share of line breaks."""

    def load():
        import numpy as np

        def model(texts):
            lines = texts.str.count("\n").to_numpy(dtype="float64")
            size = texts.str.len().to_numpy(dtype="float64")
            return np.stack([size / 1000.0, lines / 4.0], axis=1)

        return model

    return load


_L0 = "(length(text) / 1000.0::DOUBLE)"
_L1 = "((length(text) - length(replace(text, chr(10), ''))) / 4.0::DOUBLE)"
_P0, _P1 = fx.softmax_pair_sql("l0", "l1")
_SCORED = f"""
SELECT *, {_P0} AS p0, {_P1} AS p1 FROM (SELECT *, {_L0} AS l0, {_L1} AS l1 FROM documents)
"""


def _flag_sql(cut: str) -> str:
    return f"""
SELECT doc_id, lang, md5(text) AS text_md5, CASE WHEN p0 >= p1 THEN 'safe' ELSE 'unsafe' END AS predicted_label,
       {s6("greatest(p0, p1)")} AS prediction_confidence,
       greatest(p0, p1) < {cut} AS manual_review,
       CASE WHEN greatest(p0, p1) < {cut} THEN 'low_confidence' ELSE '' END AS manual_review_reason
FROM ({_SCORED})
"""


def _flag_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        "lang",
        F.md5("text").alias("text_md5"),
        "predicted_label",
        r6("prediction_confidence").alias("prediction_confidence"),
        "manual_review",
        "manual_review_reason",
    )


@query(
    _flag_sql(f"(SELECT quantile_cont({fx.clean_sql('my_conf')}, 0.05) FROM ({fx.REFERENCE}))")
)
def score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged, _ = predict_and_flag(
        table(spark, sf_dir, "documents"),
        length_model(),
        ID2LABEL,
        "stand-in",
        reference=fx.reference(spark, sf_dir).select("my_conf"),
        confidence_column="my_conf",
    )
    return _flag_columns(flagged)


_CUT = 40
_FIRST_TOKENS = r"^[^\p{L}\p{N}]*[\p{L}\p{N}]+([^\p{L}\p{N}]+[\p{L}\p{N}]+)" + f"{{{_CUT - 1}}}"


@query(f"""
SELECT doc_id, md5(CASE WHEN regexp_matches(t, '{_FIRST_TOKENS}') THEN regexp_extract(t, '{_FIRST_TOKENS}') ELSE t END)
         AS seen_md5
FROM (SELECT doc_id, CASE WHEN ends_with(t, '</s>') THEN t ELSE t || '</s>' END AS t
      FROM (SELECT doc_id, 'Text: ' || text AS t FROM documents))
""")
def cut_model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = predict(
        table(spark, sf_dir, "documents"),
        length_model(),
        ID2LABEL,
        template="Text: {text}",
        eos="</s>",
        max_length=_CUT,
    )
    return scored.select("doc_id", F.md5("text").alias("seen_md5"))


@query(_flag_sql("0.6"), "stream_flags")
def stream_review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "stream")
    schema = table(spark, sf_dir, "documents").schema
    # A pattern, because a stream's source is a folder or a pattern, not one file.
    source = read_text_stream(spark, f"{sf_dir}/documents.parquet*", schema)
    run = stream_flags(source, f"{out}/flags", f"{out}/checkpoint", length_model(), ID2LABEL)
    run.awaitTermination()
    return _flag_columns(spark.read.parquet(f"{out}/flags"))


@query("""
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def resume_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, done = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return remaining(rows, done, "doc_id").select("doc_id", "lang", "n_chars")


# Above 2^53, where a detour over doubles would change it, and null in places.
_BIG = "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 9007199254740993 + 2 * doc_id END"


@query(f"""
SELECT doc_id, {_BIG} AS big, reverse(lang) AS lang, CAST(length(text) AS BIGINT) AS size
FROM documents WHERE length(text) >= 500 AND ({_BIG} IS NULL OR ({_BIG}) % 4 = 1)
""")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", F.expr(_BIG).alias("big"))
    long_texts = filter_rows(rows, lambda batch: batch["text"].str.len() >= 500, ["text"])
    long_texts = filter_rows(long_texts, lambda batch: batch["big"].isna() | (batch["big"] % 4 == 1), ["big"])
    sized = map_batches(
        long_texts,
        lambda b: b.assign(size=b["text"].str.len()).drop(columns="text"),
        "doc_id long, lang string, big long, size long",
    )
    return map_rows(
        sized, lambda row: {**row, "lang": row["lang"][::-1]}, "doc_id long, lang string, big long, size long"
    )


def _resumed(spark: SparkSession, sf_dir: str) -> FlaggedTable:
    """Some rows are scored in a first run under another threshold, the rest in a second."""
    docs, out = table(spark, sf_dir, "documents"), scratch_path(spark, "resume")
    early = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    flag_into(early, out, length_model(), ID2LABEL, "m", "doc_id", default_threshold=0.999)
    return flag_into(docs, out, length_model(), ID2LABEL, "m", "doc_id", default_threshold=0.6)


@query(f"""
SELECT doc_id, {s6("greatest(p0, p1)")} AS prediction_confidence, greatest(p0, p1) < 0.6 AS manual_review
FROM ({_SCORED})
""")
def resume_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumed(spark, sf_dir).rows.select(
        "doc_id", r6("prediction_confidence").alias("prediction_confidence"), "manual_review"
    )


@query(f"""
SELECT count(*) FILTER (greatest(p0, p1) < 0.6) AS flagged, count(*) AS total FROM ({_SCORED})
""")
def resume_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resumed(spark, sf_dir).summary.select("flagged", "total")


class _Killed(Exception):
    pass


def _kill_half_way(done: int, slices: int) -> None:
    if done * 2 >= slices:
        raise _Killed


_EARLY = "instr('01234567', substr(md5(CAST(doc_id AS VARCHAR)), 1, 1)) > 0"


@query(f"""
SELECT doc_id, {_EARLY} AS from_first_run, {s6(f"CASE WHEN {_EARLY} THEN l0 ELSE l0 + 7 END")} AS model_saw
FROM ({_SCORED})
""")
def resume_after_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is killed half way; the next keeps what it had committed and scores the rest.

    Each run's model leaves its mark on the rows that it scored.
    """
    docs, out = table(spark, sf_dir, "documents").select("doc_id", "text"), scratch_path(spark, "killed")
    quarter = max(1, -(-docs.count() // 4))

    def marked(more: float) -> Callable:
        def load():
            import numpy as np

            def model(texts):
                size = texts.str.len().to_numpy(dtype="float64") / 1000.0 + more
                return np.stack([size, np.full(len(size), -1000.0)], axis=1)

            return model

        return load

    labels = {0: "first", 1: "never"}
    try:
        score_into(docs, out, marked(0.0), labels, "doc_id", commit_rows=quarter, committed=_kill_half_way)
    except _Killed:
        pass
    first = spark.read.parquet(out).select("doc_id", F.lit(True).alias("from_first_run"))
    # Read now: the second run appends to the same table.
    first = spool(first)
    scored = score_into(docs, out, marked(7.0), {0: "second", 1: "never"}, "doc_id", commit_rows=quarter)
    size = F.length("text") / F.lit(1000.0)
    return scored.join(first, "doc_id", "left").select(
        "doc_id",
        F.coalesce("from_first_run", F.lit(False)).alias("from_first_run"),
        r6(F.when(F.col("predicted_label") == "first", size).otherwise(size + 7)).alias("model_saw"),
    )


_HELD = f"""
SELECT l.*, s.split FROM (
  SELECT doc_id, y, p0, p1, -ln(CASE y WHEN 1 THEN p1 ELSE p0 END + 1e-12) AS loss
  FROM ({_SCORED}) JOIN (SELECT doc_id, toxic AS y FROM labels) USING (doc_id)) l
JOIN ({fx.split_sql(f"({fx.LABELLED})", "doc_id")}) s USING (doc_id) WHERE split = 'test'
"""


@query(f"""
{masked_sql(f"""SELECT d.doc_id, d.text, s.split FROM ({fx.LABELLED}) d
                JOIN ({fx.split_sql(f"({fx.LABELLED})", "doc_id")}) s USING (doc_id)""")},
h AS ({_HELD}),
p AS (SELECT doc_id, exp(-avg(log_prob)) AS ppl, count(*) AS n, sum(position * length(token)) AS mass,
             sum(round(log_prob, 6)) AS log_probs
      FROM tok GROUP BY doc_id)
SELECT doc_id, y AS label, {s6("p0")} AS stand_in_logit_class_0, {s6("p1")} AS stand_in_logit_class_1,
       {s6("loss")} AS stand_in_per_item_loss, loss > (SELECT quantile_cont(loss, 0.95) FROM h) AS stand_in_flag_uncertain,
       round(coalesce(ppl, 'nan'::DOUBLE), 4) AS stand_in_pseudo_perplexity,
       CAST(coalesce(n, 0) AS INT) AS n_token_scores, CAST(coalesce(mass, 0) AS BIGINT) AS token_mass,
       round(coalesce(log_probs, 0), 3) + 0.0 AS sum_log_prob
FROM h LEFT JOIN p USING (doc_id)
""")
def held_out_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lab.prepare_labelled(fx.labelled(spark, sf_dir), "text", "toxic", keep=["doc_id"])
    # Read several times below; as a table, so that texts and labels meet once.
    parts = spool(assign_split(rows, "doc_id"))
    scored = score_held_out(
        parts.where(F.col("split") == "test"),
        length_model(),
        key="doc_id",
        counts=count_tokens(parts.where(F.col("split") == "train")),
    )
    wide = prediction_columns(
        scored,
        "stand_in",
        loss="per_item_loss",
        uncertain="flag_uncertain",
        perplexity="pseudo_perplexity",
        token_scores="token_scores",
    )
    return wide.select(
        "doc_id",
        "label",
        *[
            r6(c).alias(c)
            for c in ("stand_in_logit_class_0", "stand_in_logit_class_1", "stand_in_per_item_loss")
        ],
        "stand_in_flag_uncertain",
        F.round("stand_in_pseudo_perplexity", 4).alias("stand_in_pseudo_perplexity"),
        F.size("stand_in_token_scores").alias("n_token_scores"),
        F.aggregate(
            "stand_in_token_scores",
            F.lit(0).cast("long"),
            lambda sum_, t: sum_ + (t["position"] * F.length(t["token"])).cast("long"),
        ).alias("token_mass"),
        (
            F.round(
                F.aggregate(
                    "stand_in_token_scores", F.lit(0.0), lambda sum_, t: sum_ + F.round(t["log_prob"], 6)
                ),
                3,
            )
            + F.lit(0.0)
        ).alias("sum_log_prob"),
    )


@query("""
SELECT conv_id, turn, role, md5(CASE WHEN text IN ('', 'NA', 'nan', 'null') THEN NULL ELSE text END) AS text_md5
FROM conversations
""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts hold commas, quotes and line breaks.
    path = scratch_path(spark, "csv")
    write_flagged(table(spark, sf_dir, "conversations"), path, "csv")
    back = read_labelled_csv(spark, path, {"conv_id": "bigint", "turn": "bigint"}, ["text"])
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("""
SELECT conv_id, turn, role, md5(CASE WHEN text IN ('', 'NA', 'nan', 'null') THEN NULL ELSE text END) AS text_md5
FROM conversations
""")
def csv_split_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, by a reader that splits files inside quoted cells."""
    path = scratch_path(spark, "csv")
    write_flagged(table(spark, sf_dir, "conversations"), path, "csv")
    back = read_labelled_csv(spark, path, {"conv_id": "bigint", "turn": "bigint"}, ["text"], row_id="place", split=True)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query()
def train_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lab.prepare_labelled(fx.labelled(spark, sf_dir), "text", "quality", keep=["doc_id"])
    run = train_text_classifier(rows, ["low", "good"], key="doc_id", n_features=1 << 16, max_iter=20)
    return run.eval_metrics.withColumn("part", F.lit("eval")).unionByName(
        run.test_metrics.withColumn("part", F.lit("test"))
    )


@query(f"""
WITH l AS (SELECT doc_id, toxic AS label, split FROM ({fx.LABELLED})
           JOIN ({fx.split_sql(f"({fx.LABELLED})", "doc_id")}) USING (doc_id))
SELECT split, label, count(*) AS n_rows FROM l GROUP BY ALL
UNION ALL SELECT 'extra', quality, count(*) FROM ({fx.LABELLED}) GROUP BY quality
UNION ALL SELECT 'train and extra', label, count(*)
FROM (SELECT label FROM l WHERE split = 'train' UNION ALL SELECT quality FROM ({fx.LABELLED})) GROUP BY label
""")
def train_label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lab.prepare_labelled(fx.labelled(spark, sf_dir), "text", "toxic", keep=["doc_id"])
    extra = lab.prepare_labelled(fx.labelled(spark, sf_dir), "text", "quality")
    run = train_text_classifier(
        rows, ["safe", "unsafe"], key="doc_id", extra=extra, n_features=1 << 12, max_iter=2
    )
    return run.label_counts.select("split", "label", "n_rows")


_COUNTED = f"""
WITH d AS (SELECT doc_id, split, quality AS label, {TOKENS_SQL} AS ts FROM ({fx.LABELLED})
           JOIN ({fx.split_sql(f"({fx.LABELLED})", "doc_id")}) USING (doc_id)),
t AS (SELECT label, w, count(*) AS c FROM (SELECT label, unnest(ts) AS w FROM d WHERE split = 'train') GROUP BY ALL),
v AS (SELECT w, coalesce(sum(c) FILTER (label = 0), 0) AS c0, coalesce(sum(c) FILTER (label = 1), 0) AS c1 FROM t GROUP BY w),
n AS (SELECT count(*) AS v, sum(c0) AS t0, sum(c1) AS t1 FROM v),
p AS (SELECT count(*) FILTER (label = 0) AS d0, count(*) FILTER (label = 1) AS d1 FROM d WHERE split = 'train'),
o AS (SELECT doc_id, unnest(ts) AS w FROM d WHERE split <> 'train'),
s AS (SELECT doc_id, sum(ln(c0 + 1.0::DOUBLE) - ln(CAST(t0 + v AS DOUBLE))) AS s0,
             sum(ln(c1 + 1.0::DOUBLE) - ln(CAST(t1 + v AS DOUBLE))) AS s1 FROM o JOIN v USING (w), n GROUP BY doc_id),
r AS (SELECT doc_id, split, label, coalesce(s1, 0) - coalesce(s0, 0) + ln((d1 + 1.0::DOUBLE) / (d0 + 1.0::DOUBLE)) AS gap
      FROM d LEFT JOIN s USING (doc_id), p WHERE split <> 'train')
SELECT doc_id, split, label, CAST(round(gap, 6) > 0 AS INTEGER) AS predicted, round(gap, 4) + 0.0 AS log_odds FROM r
"""


def _counted(spark: SparkSession, sf_dir: str) -> TrainingRun:
    rows = lab.prepare_labelled(fx.labelled(spark, sf_dir), "text", "quality", keep=["doc_id"])
    return train_text_classifier(rows, ["low", "good"], key="doc_id", learner=COUNTS)


def _predicted(scored: DataFrame) -> DataFrame:
    gap = F.col("logits")[1] - F.col("logits")[0]
    return scored.select(
        "doc_id",
        "split",
        "label",
        (F.round(gap, 6) > 0).cast("int").alias("predicted"),
        (F.round(gap, 4) + F.lit(0.0)).alias("log_odds"),
    )


@query(_COUNTED)
def count_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for the held-out parts by a classifier of token counts."""
    return _predicted(_counted(spark, sf_dir).scored)


@query(_COUNTED)
def count_classifier_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same predictions by the classifier as saved and loaded again."""
    run, path = _counted(spark, sf_dir), scratch_path(spark, "counts")
    run.classifier.save(path)
    held = run.parts.where(F.col("split") != "train")
    return _predicted(CountClassifier.load(path).logits(held))


_JUDGED = f"""
{_COUNTED.replace("SELECT doc_id, split, label, CAST", "SELECT split, label, CAST")}
"""


@query(f"""
SELECT split AS part, count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
       count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp
FROM ({_JUDGED}) GROUP BY split
""")
def count_classifier_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts of the held-out parts, by the library's own metric."""
    found = _predicted(_counted(spark, sf_dir).scored)
    return confusion(found, "label", "predicted", by=["split"]).withColumnRenamed("split", "part")
