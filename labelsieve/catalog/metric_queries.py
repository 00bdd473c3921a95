"""Confusion counts, metrics, curves, threshold tuning, report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelsieve.catalog import fixtures as fx
from labelsieve.catalog.registry import query, r6, s6, table
from labelsieve.operators import curves, metrics, report
from labelsieve.operators.sampling import split_part
from labelsieve.plans.evaluate import evaluate
from labelsieve.plans.predict_and_flag import MULTI_LABEL, SINGLE_LABEL
from labelsieve.session import scratch_path, spool
from labelsieve.sources.tables import read_metrics, write_metrics

# --- curves, as SQL over points(grp, score, label) ---


def _curve_sql(points: str) -> str:
    """grp, score, tp, fp, own counts, positives, precision, recall."""
    return f"""
SELECT *, tp / (tp + fp) AS precision, CASE WHEN positives = 0 THEN 1.0::DOUBLE ELSE tp / positives END AS recall
FROM (SELECT grp, score, pos, n,
             sum(pos) OVER w AS tp, sum(n - pos) OVER w AS fp,
             sum(pos) OVER (PARTITION BY grp) AS positives
      FROM (SELECT grp, score, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n
            FROM ({points}) GROUP BY grp, score)
      WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
"""


def _area_sql(points: str) -> str:
    return f"""
SELECT grp, sum((recall - r0) * (precision + p0) / 2) AS aucpr
FROM (SELECT *, lag(recall, 1, 0::DOUBLE) OVER w AS r0, lag(precision, 1, 1::DOUBLE) OVER w AS p0
      FROM ({_curve_sql(points)}) WINDOW w AS (PARTITION BY grp ORDER BY score DESC))
GROUP BY grp
"""


_TIED = f"SELECT lang AS grp, p1 AS score, y AS label FROM ({fx.TIED_SCORES})"
_PLAIN = f"SELECT lang AS grp, p1 AS score, y AS label FROM ({fx.SCORES})"


def _score_rows(df: DataFrame) -> DataFrame:
    return df.select("lang", F.element_at("probs", 2).alias("score"), "y")


def _curve_query(points: str) -> str:
    return f"""
SELECT grp AS lang, {s6("score")} AS threshold, {s6("precision")} AS precision, {s6("recall")} AS recall,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp
FROM ({_curve_sql(points)})
UNION ALL
SELECT DISTINCT grp, NULL, 1.0, 0.0, 0, 0 FROM ({points})
"""


@query(_curve_query(_PLAIN))
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = curves.pr_curve(_score_rows(fx.scores(spark, sf_dir)), "score", "y", ["lang"], bucket_rows=50)
    return points.withColumns({c: r6(c) for c in ("threshold", "precision", "recall")})


@query(_curve_query(_TIED))
def pr_curve_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = curves.pr_curve(_score_rows(fx.tied_scores(spark, sf_dir)), "score", "y", ["lang"])
    return points.withColumns({c: r6(c) for c in ("threshold", "precision", "recall")})


_EVENTS = """
SELECT CAST(user_id % 4 AS VARCHAR) AS grp, value AS score, CAST(event_type = 'error' AS INT) AS label FROM events
"""


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("string").alias("grp"),
        "value",
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


@query(f"""
SELECT grp, {s6("score")} AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(positives AS BIGINT) AS positives
FROM ({_curve_sql(_EVENTS)})
""")
def cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spool(curves.score_counts(_event_rows(spark, sf_dir), "value", "label", ["grp"]))
    # A low bucket limit, so that each group is cut into several buckets here too.
    return curves.cumulative_counts(counts, ["grp"], bucket_rows=100).select(
        "grp", r6("threshold").alias("threshold"), "tp", "fp", "positives"
    )


@query(f"SELECT grp, {s6('aucpr')} AS aucpr FROM ({_area_sql(_EVENTS)})")
def auc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = curves.auc_pr(_event_rows(spark, sf_dir), "value", "label", ["grp"])
    return areas.select("grp", r6("aucpr").alias("aucpr"))


def _tuned_sql(points: str) -> str:
    return f"""
SELECT grp, score, f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY f1 DESC, score) AS best
  FROM (SELECT *, 2.0::DOUBLE * (precision * recall) / (precision + recall + 1e-8::DOUBLE) AS f1
        FROM ({_curve_sql(points)})))
WHERE best = 1
"""


_LABEL_POINTS = f"SELECT idx AS grp, p AS score, CAST(t AS INT) AS label FROM ({fx.multi_sql()})"


@query(f"""
SELECT CAST(grp AS INT) AS label_idx, {s6("score")} AS threshold, {s6("f1")} AS f1 FROM ({_tuned_sql(_LABEL_POINTS)})
""")
def tuned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curves.tune_label_thresholds(fx.multi(spark, sf_dir), "probs", "truth")
    return found.select("label_idx", r6("threshold").alias("threshold"), r6("f1").alias("f1"))


@query(f"""
SELECT {s6("score")} AS threshold, {s6("f1")} AS f1
FROM ({_tuned_sql(f"SELECT 0 AS grp, p1 AS score, y AS label FROM ({fx.TIED_SCORES})")})
""")
def tuned_binary_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = curves.tune_threshold(_score_rows(fx.tied_scores(spark, sf_dir)), "score", "y")
    return found.select(r6("threshold").alias("threshold"), r6("f1").alias("f1"))


# --- metrics, as SQL over cells(..., tn, fp, fn, tp) ---

_CELLS = """
CAST(count(*) FILTER (NOT t AND NOT p) AS BIGINT) AS tn, CAST(count(*) FILTER (NOT t AND p) AS BIGINT) AS fp,
CAST(count(*) FILTER (t AND NOT p) AS BIGINT) AS fn, CAST(count(*) FILTER (t AND p) AS BIGINT) AS tp
"""
_RATES = """
(tp + tn) / (tp + tn + fp + fn) AS accuracy,
CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
fp / (fp + tn + 1e-10) AS fpr
"""


@query(f"""
SELECT lang, {_CELLS} FROM (SELECT lang, y = 1 AS t, CAST(p1 AS FLOAT) >= 0.5 AS p FROM ({fx.TIED_SCORES}))
GROUP BY lang
""")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tied_scores(spark, sf_dir).withColumn(
        "predicted", (F.element_at("probs", 2).cast("float") >= 0.5).cast("int")
    )
    return metrics.confusion(rows, "y", "predicted", ["lang"])


def _binary_sql(scores: str, slices: bool) -> str:
    every = f"SELECT 'all' AS slice, y, p0, p1 FROM ({scores})"
    rows = f"SELECT lang AS slice, y, p0, p1 FROM ({scores}) UNION ALL {every}" if slices else every
    return f"""
WITH s AS (SELECT slice, y, CAST(p0 AS FLOAT) AS p0, CAST(p1 AS FLOAT) AS p1 FROM ({rows})),
v AS (SELECT slice, 'unsafe' AS side, y = 1 AS t, p1 >= 0.5 AS p, p1 AS score FROM s
      UNION ALL SELECT slice, 'safe', y = 0, p0 > 0.5, p0 FROM s),
r AS (SELECT *, {_RATES} FROM (SELECT slice, side, {_CELLS} FROM v GROUP BY slice, side)),
a AS ({_area_sql("SELECT slice || '/' || side AS grp, score, CAST(t AS INT) AS label FROM v")}),
m AS (SELECT slice, 'accuracy' AS metric, accuracy AS value FROM r WHERE side = 'unsafe'
      UNION ALL SELECT slice, side || '_precision', precision FROM r
      UNION ALL SELECT slice, side || '_recall', recall FROM r
      UNION ALL SELECT slice, side || '_f1', f1 FROM r
      UNION ALL SELECT slice, side || '_fpr', fpr FROM r
      UNION ALL SELECT split_part(grp, '/', 1), split_part(grp, '/', 2) || '_aucpr', aucpr FROM a)
SELECT slice, metric, {s6("value")} AS value FROM m
"""


def _rounded(df: DataFrame) -> DataFrame:
    """No slice of these queries has the total's name, so the name tells them apart."""
    return df.drop("total").withColumn("value", r6("value"))


@query(_binary_sql(fx.SCORES, slices=False))
def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(fx.scores(spark, sf_dir), "probs", "y"))


@query(_binary_sql(fx.SCORES, slices=True))
def binary_metrics_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.binary_metrics(fx.scores(spark, sf_dir), "probs", "y", "lang"))


_NAMED_ALL = f"SELECT * REPLACE (CASE lang WHEN 'english' THEN 'all' ELSE lang END AS lang) FROM ({fx.SCORES})"


@query(f"""
SELECT CASE slice WHEN 'total' THEN 'all' ELSE slice END AS slice, slice = 'total' AS total, metric, value
FROM ({_binary_sql(_NAMED_ALL, slices=True).replace("'all' AS slice", "'total' AS slice")})
""")
def binary_metrics_slice_named_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.scores(spark, sf_dir)
    named = F.when(F.col("lang") == "english", "all").otherwise(F.col("lang"))
    found = metrics.binary_metrics(rows.withColumn("lang", named), "probs", "y", "lang")
    return found.select("slice", "total", "metric", r6("value").alias("value"))


@query(_binary_sql(fx.TIED_SCORES, slices=True))
def binary_metrics_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.tied_scores(spark, sf_dir)
    return _rounded(evaluate(rows, SINGLE_LABEL, ["safe", "unsafe"], label="y", slice_col="lang"))


def _hard_area(prefix: str = "") -> str:
    tn, fp, fn, tp = (f"{prefix}{c}" for c in ("tn", "fp", "fn", "tp"))
    n, pos, chosen = f"({tn}+{fp}+{fn}+{tp})", f"({tp}+{fn})", f"({tp}+{fp})"
    rec = f"(CASE WHEN {pos} = 0 THEN 1 ELSE {tp} / {pos} END)"
    step = f"({rec} * (1 + {tp} / {chosen}) / 2)"
    return (
        f"CASE WHEN {chosen} = 0 THEN (1 + {pos} / {n}) / 2 WHEN {chosen} = {n} THEN {step} "
        f"ELSE {step} + (1 - {rec}) * ({pos} / {n} + {tp} / {chosen}) / 2 END"
    )


def _multi_sql(items: str, names: tuple[str, ...], cuts: str) -> str:
    """Metrics over items(slice, row_id, idx, t, p): per label, any label, all labels right."""
    per_label = " UNION ALL ".join(
        f"SELECT slice, name || '/{m}', {m} FROM named" for m in metrics.PER_LABEL_METRICS
    )
    flagged = " UNION ALL ".join(
        f"SELECT slice, 'flagged/{m}', {m} FROM anyone" for m in ("accuracy", "precision", "recall", "f1", "fpr")
    )
    macro = " UNION ALL ".join(
        f"SELECT slice, 'macro_{m}', avg({m}) FROM rated GROUP BY slice" for m in ("precision", "recall", "f1")
    )
    micro = " UNION ALL ".join(f"SELECT slice, 'micro_{m}', {m} FROM pooled" for m in ("precision", "recall", "f1"))
    name = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"""
items AS ({items}),
cells AS (SELECT slice, idx, {_CELLS} FROM items GROUP BY slice, idx),
rated AS (SELECT *, {_RATES} FROM cells),
named AS (SELECT rated.*, CASE idx {name} END AS name, ({cuts}) AS threshold FROM rated),
pooled AS (SELECT *, {_RATES} FROM (SELECT slice, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp,
           sum(fn)::BIGINT AS fn, sum(tp)::BIGINT AS tp FROM cells GROUP BY slice)),
by_row AS (SELECT slice, row_id, bool_or(t) AS t, bool_or(p) AS p, bool_and(t = p) AS same
           FROM items GROUP BY slice, row_id),
anyone AS (SELECT *, {_RATES}, {_hard_area()} AS aucpr
           FROM (SELECT slice, {_CELLS} FROM by_row GROUP BY slice)),
long AS (SELECT slice, 'accuracy' AS metric, avg(CAST(same AS INT)) AS value FROM by_row GROUP BY slice
         UNION ALL {macro} UNION ALL {micro} UNION ALL {flagged}
         UNION ALL SELECT slice, 'flagged/aucpr', aucpr FROM anyone
         UNION ALL {per_label})
"""


def _sliced_items(multi: str, cut: str) -> str:
    return f"""
SELECT lang AS slice, row_id, idx, t, p > ({cut}) AS p FROM ({multi})
UNION ALL SELECT 'all', row_id, idx, t, p > ({cut}) FROM ({multi})
"""


@query(f"""
WITH {_multi_sql(_sliced_items(fx.multi_sql(), "0.5"), fx.MULTI_NAMES, "0.5")}
SELECT slice, metric, {s6("value")} AS value FROM long
""")
def multilabel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.multi(spark, sf_dir)
    return _rounded(
        metrics.multilabel_metrics(rows, "probs", "truth", fx.MULTI_NAMES, slice_col="lang")
    )


_CUT_BY_LABEL = "CASE idx WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 WHEN 2 THEN 0.6 ELSE 0.7 END"


@query(f"""
WITH {_multi_sql(_sliced_items(fx.multi_sql(), _CUT_BY_LABEL), fx.MULTI_NAMES, _CUT_BY_LABEL)}
SELECT slice, metric, {s6("value")} AS value FROM long WHERE metric LIKE 'k%'
""")
def per_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.multi(spark, sf_dir)
    judged = evaluate(
        rows, MULTI_LABEL, fx.MULTI_NAMES, label="truth", slice_col="lang", thresholds=[0.3, 0.5, 0.6, 0.7]
    )
    return _rounded(judged).where(F.col("metric").startswith("k"))


_PARTS = fx.split_sql("embeddings", "vec_id")
_HELD = f"SELECT m.*, split FROM ({fx.multi_sql()}) m JOIN ({_PARTS}) s ON s.vec_id = m.row_id"


@query(f"""
WITH held AS ({_HELD}),
tuned AS ({_tuned_sql("SELECT idx AS grp, p AS score, CAST(t AS INT) AS label FROM held WHERE split = 'eval'")}),
test AS (SELECT held.*, tuned.score AS cut FROM held JOIN tuned ON tuned.grp = held.idx WHERE split = 'test'),
{_multi_sql("SELECT 'all' AS slice, row_id, idx, t, p > cut AS p FROM test", fx.MULTI_NAMES,
            "SELECT score FROM tuned WHERE grp = rated.idx")}
SELECT slice, metric, {s6("value")} AS value FROM long
""")
def tuned_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.multi(spark, sf_dir)
    return _rounded(
        evaluate(
            split_part(rows, "row_id", "test"),
            MULTI_LABEL,
            fx.MULTI_NAMES,
            label="truth",
            fit_on=split_part(rows, "row_id", "eval"),
        )
    )


# --- reports: two measured models and one without results ---

_MODELS = ("model a", "missing", "model b")
_PAIRS = {"model a": (1, 2), "model b": (5, 6)}
_TWO = ("k0", "k1")


def _model_sql(model: str) -> str:
    items = _sliced_items(fx.multi_sql(_PAIRS[model]), "0.5")
    return f"""
SELECT '{model}' AS model, slice, metric, value
FROM (WITH {_multi_sql(items, _TWO, "0.5")} SELECT * FROM long)
"""


_METRICS = " UNION ALL ".join(_model_sql(m) for m in _PAIRS)


def _model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for model, pair in _PAIRS.items():
        part = metrics.multilabel_metrics(
            fx.multi(spark, sf_dir, pair), "probs", "truth", _TWO, slice_col="lang"
        ).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


_GRID = f"""
SELECT g.model, g.slice, g.metric, coalesce(v.value, 0) AS value
FROM (SELECT * FROM (VALUES ('model a'), ('missing'), ('model b')) a(model),
                    (VALUES ('all'), ('english'), ('italian')) b(slice),
                    (VALUES ('flagged/f1'), ('flagged/aucpr'), ('flagged/fpr')) c(metric)) g
LEFT JOIN ({_METRICS}) v USING (model, slice, metric)
"""

_HEADINGS = [f"{m}_{s}" for m in ("f1", "aucpr", "fpr") for s in report.LANGUAGES]


@query(f"""
SELECT model, {", ".join(
    f"{s6(f'''max(value) FILTER (metric = 'flagged/{h.split('_')[0]}' AND slice = '{h.split('_')[1]}')''')} AS {h}"
    for h in _HEADINGS)}
FROM ({_GRID}) GROUP BY model
""")
def report_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = report.report_table(_model_metrics(spark, sf_dir), _MODELS)
    return wide.select("model", *[r6(h).alias(h) for h in _HEADINGS])


@query(f"""
SELECT model, slice, metric, printf('%.3f', round(value, 6)) AS cell,
       abs(value - CASE WHEN metric = 'flagged/fpr' THEN min(value) OVER w ELSE max(value) OVER w END) < 1e-3 AS is_best
FROM ({_GRID}) WHERE slice != 'all' WINDOW w AS (PARTITION BY metric, slice)
""")
def report_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = report.best_marks(
        _rounded(_model_metrics(spark, sf_dir)), _MODELS, include_all=False
    )
    return marked.select("model", "slice", "metric", "cell", "is_best")


@query(f"""
SELECT 'written' AS part, model, slice, metric, {s6('value')} AS value FROM ({_GRID})
UNION ALL SELECT 'never written', model, slice, metric, 0.0 FROM ({_GRID})
""")
def stored_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written per model and slice, then read back with a default for what is absent.
    path = scratch_path(spark, "metrics")
    measured = _model_metrics(spark, sf_dir)
    # An earlier run whose every value was higher; the later one replaces it.
    write_metrics(measured.withColumn("value", F.col("value") + 1.0), path)
    write_metrics(measured, path)
    wanted = (_MODELS, report.LANGUAGES, report.FLAGGED_TABLE)
    read = _rounded(read_metrics(spark, path, *wanted)).withColumn("part", F.lit("written"))
    absent = read_metrics(spark, scratch_path(spark, "metrics"), *wanted)
    return read.unionByName(absent.withColumn("part", F.lit("never written"))).select(
        "part", "model", "slice", "metric", "value"
    )
