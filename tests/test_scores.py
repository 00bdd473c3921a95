"""Scores, metrics, calibration, review and reports on hand-made rows."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsieve.functions import probabilities as P
from labelsieve.operators import calibration as cal
from labelsieve.operators import curves, metrics, report
from labelsieve.operators.review import flag_review, flag_tokens, review_summary
from labelsieve.plans.evaluate import evaluate
from labelsieve.plans.predict_and_flag import MULTI_LABEL, SINGLE_LABEL, predict_and_flag, with_predictions

NAN = float("nan")


def arrays(spark, rows, name="p"):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} array<double>")


def values(df):
    return {(r["slice"], r["metric"]): r["value"] for r in df.collect()}


# --- array functions ---


def test_softmax_and_sigmoid(spark):
    logits = [[1.0, 2.0, 3.0], [1000.0, 0.0], [-5.0, -5.0], [0.25]]
    df = arrays(spark, logits, "l").select("i", P.softmax(F.col("l")).alias("s"), P.sigmoid(F.col("l")).alias("g"))
    for r in df.collect():
        x = np.array(logits[r["i"]])
        e = np.exp(x - x.max())
        assert r["s"] == pytest.approx(list(e / e.sum()))
        with np.errstate(over="ignore"):
            assert r["g"] == pytest.approx(list(1 / (1 + np.exp(-x))))


def test_choices(spark):
    df = arrays(spark, [[0.5, 0.5], [0.2, 0.8], [NAN, 0.7]])
    got = df.select(
        P.argmax(F.col("p")).alias("best"),
        P.active_labels(F.col("p"), 0.5).alias("active"),
        P.hard_predict(F.col("p"), 0.5).alias("hard"),
        P.hard_predict(F.col("p"), [0.1, 0.9]).alias("each"),
        P.confidence_multi(F.col("p")).alias("far"),
    ).collect()
    assert got[0]["best"] == 0 and got[1]["best"] == 1
    assert [r["active"] for r in got] == [[0, 1], [1], [1]]
    assert [r["hard"] for r in got] == [[0, 0], [0, 1], [0, 1]]
    assert [r["each"] for r in got] == [[1, 0], [1, 0], [0, 0]]
    assert got[1]["far"] == pytest.approx(0.6)


def test_unknown_label_shows_its_id(spark):
    df = spark.createDataFrame([(0,), (7,)], "i int")
    assert [r[0] for r in df.select(P.label_name(F.col("i"), {0: "safe"})).collect()] == ["safe", "7"]


# --- binary metrics ---


def test_even_split_counts_as_unsafe_only(spark):
    rows = [(1, [0.5, 0.5]), (0, [0.5, 0.5]), (0, [0.9, 0.1])]
    got = values(metrics.binary_metrics(spark.createDataFrame(rows, "y int, p array<double>"), "p", "y"))
    assert got[("all", "unsafe_recall")] == 1.0
    assert got[("all", "unsafe_precision")] == 0.5
    assert got[("all", "safe_recall")] == 0.5
    assert got[("all", "safe_precision")] == 1.0
    assert got[("all", "accuracy")] == pytest.approx(2 / 3)
    assert set(m for _, m in got) == set(metrics.BINARY_METRICS)


def test_one_class_only(spark):
    df = spark.createDataFrame([(0, [0.9, 0.1], "it"), (0, [0.8, 0.2], None)], "y int, p array<double>, g string")
    got = values(evaluate(df, SINGLE_LABEL, ["safe", "unsafe"], "p", "y", "g"))
    assert got[("all", "unsafe_recall")] == got[("all", "unsafe_f1")] == 0.0
    assert got[("all", "unsafe_aucpr")] == 0.5
    assert got[("it", "accuracy")] == got[(None, "accuracy")] == 1.0
    assert got[(None, "safe_aucpr")] == 1.0


def test_counting_metrics_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), [1 - p, p]) for p in (rng.random() for _ in range(400))]
    df = spark.createDataFrame(rows, "y int, p array<double>")
    one = values(metrics.binary_metrics(df.coalesce(1), "p", "y"))
    many = values(metrics.binary_metrics(df.repartition(7), "p", "y", bucket_rows=20))
    assert many == pytest.approx(one)


# --- multi-label metrics ---


def hard_area(t, p):
    levels = sorted(set(p), reverse=True)
    at, area = (0.0, 1.0), 0.0
    for level in levels:
        picked = [a for a, b in zip(t, p) if b >= level]
        point = (sum(picked) / sum(t) if sum(t) else 1.0, sum(picked) / len(picked))
        area += (point[0] - at[0]) * (point[1] + at[1]) / 2
        at = point
    return area


@pytest.mark.parametrize(
    ("truth", "probs"),
    [
        ([[1, 0], [0, 1], [0, 0], [1, 1]], [[0.9, 0.6], [0.1, 0.7], [0.2, 0.3], [0.8, 0.2]]),
        ([[0, 0], [0, 0]], [[0.1, 0.2], [0.9, 0.1]]),
        ([[1, 0], [1, 0]], [[0.1, 0.2], [0.3, 0.1]]),
        ([[1, 1], [1, 0]], [[0.9, 0.9], [0.9, 0.9]]),
    ],
)
def test_multilabel_metrics(spark, truth, probs):
    df = spark.createDataFrame(list(zip(truth, probs)), "t array<int>, p array<double>")
    got = values(metrics.multilabel_metrics(df, "p", "t", ["a", "b"]))
    t, p = np.array(truth), (np.array(probs) > 0.5).astype(int)
    assert got[("all", "accuracy")] == pytest.approx(float((t == p).all(axis=1).mean()))

    def f1(a, b):
        tp, fp, fn = (a & b).sum(), ((1 - a) & b).sum(), (a & (1 - b)).sum()
        return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0

    assert got[("all", "macro_f1")] == pytest.approx(np.mean([f1(t[:, k], p[:, k]) for k in (0, 1)]))
    assert got[("all", "micro_f1")] == pytest.approx(f1(t.ravel(), p.ravel()))
    any_t, any_p = t.any(axis=1).astype(int), p.any(axis=1).astype(int)
    assert got[("all", "flagged/f1")] == pytest.approx(f1(any_t, any_p))
    assert got[("all", "flagged/aucpr")] == pytest.approx(hard_area(list(any_t), list(any_p)))
    assert got[("all", "a/threshold")] == 0.5
    assert {m for _, m in got} == set(metrics.MULTILABEL_METRICS) | {
        f"{n}/{m}" for n in "ab" for m in metrics.PER_LABEL_METRICS
    }


def test_list_thresholds_are_applied_and_reported(spark):
    df = spark.createDataFrame([([1, 0], [0.4, 0.6])], "t array<int>, p array<double>")
    got = values(evaluate(df, MULTI_LABEL, ["a", "b"], "p", "t", thresholds=[0.3, 0.7]))
    assert got[("all", "accuracy")] == 1.0
    assert (got[("all", "a/threshold")], got[("all", "b/threshold")]) == (0.3, 0.7)


def test_tuned_threshold_is_applied_strictly(spark):
    rows = [([1], [0.8]), ([1], [0.6]), ([0], [0.3])]
    df = spark.createDataFrame(rows, "t array<int>, p array<double>")
    got = values(evaluate(df, MULTI_LABEL, ["a"], "p", "t", fit_on=df))
    assert got[("all", "a/threshold")] == 0.6
    assert got[("all", "a/recall")] == 0.5


def test_unknown_problem_type(spark):
    with pytest.raises(ValueError):
        evaluate(arrays(spark, [[0.5, 0.5]]), "single_label_multiclass_classification", [], "p", "i")


# --- calibration ---


def reference(spark, **columns):
    names = [n.replace("__", "_") for n in columns]
    rows = list(zip(*columns.values()))
    schema = ", ".join(f"`{n}` {'string' if isinstance(v[0], str) else 'double'}" for n, v in zip(names, columns.values()))
    return spark.createDataFrame(rows, schema)


LOSSES = ["0.5", "abc", "0.1", "nan", "", "0.9"]
CONFIDENCES = [0.9, 0.6, 0.7, 0.95, NAN, 0.5]
REAL = [0.9, 0.6, 0.7, 0.95, 0.5]


def test_fixed_threshold():
    assert cal.confidence_threshold(None, "m") == cal.Calibration(0.6, "fixed")
    for alpha in (0.0, 1.0, -1.0):
        with pytest.raises(ValueError):
            cal.confidence_threshold(None, "m", alpha)


def test_loss_wins(spark):
    ref = reference(spark, m_per_item_loss=LOSSES, prediction_confidence=CONFIDENCES)
    got = cal.confidence_threshold(ref, "m", confidence_column="prediction_confidence")
    assert got.threshold == pytest.approx(math.exp(-np.quantile([0.5, 0.1, 0.9], 0.95)))
    assert got.source == "reference_csv:m_per_item_loss->exp(-q_0.95)"
    other = cal.confidence_threshold(ref, "another")
    assert other.source == "reference_csv:prediction_confidence"


def test_loss_without_numbers_falls_through(spark):
    ref = reference(spark, m_per_item_loss=["x"] * 6, prediction_confidence=CONFIDENCES)
    got = cal.confidence_threshold(ref, "m", 0.1)
    assert got.threshold == pytest.approx(np.quantile(REAL, 0.1))


def test_explicit_column(spark):
    ref = reference(spark, conf=CONFIDENCES, prediction_confidence=[0.1] * 6)
    got = cal.confidence_threshold(ref, "m", confidence_column="conf")
    assert (got.threshold, got.source) == (pytest.approx(np.quantile(REAL, 0.05)), "reference_csv:conf")
    with pytest.raises(ValueError, match="nope"):
        cal.confidence_threshold(ref, "m", confidence_column="nope")
    with pytest.raises(ValueError, match="no number"):
        cal.confidence_threshold(reference(spark, conf=["x", "y"]), "m", confidence_column="conf")


def test_class_columns(spark):
    ref = reference(spark, m_logit_class_0=[0.2, NAN], m_logit_class_1=[0.8, 0.4], o_logit_class_0=[0.99, 0.99])
    own = cal.confidence_threshold(ref, "m", 0.5)
    assert (own.threshold, own.source) == (pytest.approx(0.6), "reference_csv:max(m_logit_class_*)")
    anyone = cal.confidence_threshold(ref, "z", 0.5)
    assert (anyone.threshold, anyone.source) == (pytest.approx(0.99), "reference_csv:max(*_logit_class_*)")


def test_json_probabilities(spark):
    ref = reference(spark, class_probabilities=["[0.1, 0.9]", "[0.6, 0.4]", "[]", "{}", "oops", "[0.7,"])
    got = cal.confidence_threshold(ref, "m", 0.5)
    assert (got.threshold, got.source) == (pytest.approx(0.75), "reference_csv:class_probabilities")
    with pytest.raises(ValueError, match="no confidence"):
        cal.confidence_threshold(reference(spark, x=[1.0]), "m")


def test_ppl_threshold(spark):
    df = reference(spark, ppl=[1.0, 2.0, 3.0])
    ref = reference(spark, m_pseudo_perplexity=[10.0, 20.0])
    assert cal.ppl_threshold(df, "ppl", absolute=5) == 5.0
    assert cal.ppl_threshold(df, "ppl", percentile=50) == 2.0
    assert cal.ppl_threshold(df, "ppl", percentile=50, reference=ref, model="m") == 15.0
    with pytest.raises(ValueError):
        cal.ppl_threshold(df, "ppl", reference=ref, reference_column="none")


def test_flag_uncertain(spark):
    losses = [float(i) for i in range(21)]
    df = spark.createDataFrame([(v,) for v in losses], "loss double")
    got = {r["loss"]: r["flag_uncertain"] for r in cal.flag_uncertain(df, "loss", 0.1).collect()}
    assert [v for v, f in got.items() if f] == [19.0, 20.0]
    odd = spark.createDataFrame([(1.0,), (NAN,)], "loss double")
    assert not any(r["flag_uncertain"] for r in cal.flag_uncertain(odd, "loss").collect())


# --- review ---


def test_review_reasons(spark):
    rows = [(0.5, 9.0), (0.6, 9.0), (0.5, 1.0), (0.9, NAN), (None, 1.0), (NAN, 1.0)]
    df = spark.createDataFrame(rows, "prediction_confidence double, ppl double")
    got = flag_review(df, 0.6, perplexity="ppl", ppl_threshold=5.0).collect()
    assert [r["manual_review_reason"] for r in got] == [
        "low_confidence,high_pseudo_perplexity",
        "high_pseudo_perplexity",
        "low_confidence",
        "",
        "",
        "",
    ]
    off = flag_review(df, 0.6).collect()
    assert [r["manual_review"] for r in off] == [True, False, True, False, False, False]
    assert not any(r["flag_high_ppl"] for r in off)


def test_token_rule(spark):
    df = spark.createDataFrame(
        [([(1, 9.0), (2, 9.0), (3, NAN)],), ([(1, 9.0)],), (None,)], "t array<struct<position:int,token_ppl:double>>"
    )
    assert [r[0] for r in df.select(flag_tokens(F.col("t"), 5.0, 2)).collect()] == [True, False, False]
    flagged = flag_review(
        df.withColumn("prediction_confidence", F.lit(1.0)), 0.6, many_tokens=flag_tokens(F.col("t"), 5.0, 2)
    )
    assert [r["manual_review_reason"] for r in flagged.collect()] == ["many_high_ppl_tokens", "", ""]


def test_summary(spark):
    df = spark.createDataFrame([(True,), (False,), (False,), (True,)], "manual_review boolean")
    assert tuple(review_summary(df).first()) == (2, 4, 50.0)
    assert tuple(review_summary(df.limit(0)).first()) == (0, 0, None)


def test_prediction_columns_match_json(spark):
    df = arrays(spark, [[0.0, 3.0, -2.0], [-9.0, -9.0, -9.0]], "logits")
    rows = with_predictions(df, {0: "a", 1: 'b"é'}, MULTI_LABEL).orderBy("i").collect()
    assert json.loads(rows[0]["predicted_label"]) == ["a", 'b"é']
    assert rows[0]["predicted_label_id"] == "[0, 1]" and rows[1]["predicted_label_id"] == "[]"
    assert rows[0]["predicted_label"] == json.dumps(["a", 'b"é'], ensure_ascii=False)
    probs = json.loads(rows[1]["class_probabilities"])
    assert rows[1]["class_probabilities"] == json.dumps(probs)
    one = with_predictions(df, {0: "a", 1: "b", 2: "c"}).orderBy("i").collect()
    assert [r["predicted_label"] for r in one] == ["b", "a"]


def loader():
    def load():
        return lambda texts: np.array([[len(t), 2.0] for t in texts])

    return load


def test_predict_and_flag(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None), (3, "abcdefgh")], "id int, body string")
    flagged, found = predict_and_flag(df, loader(), {0: "safe", 1: "unsafe"}, "m", text="body", template="<{text}>")
    rows = flagged.orderBy("id").collect()
    assert found.source == "fixed"
    assert [r["text"] for r in rows] == ["<ab>", "<nan>", "<abcdefgh>"]
    assert [r["body"] for r in rows] == ["ab", None, "abcdefgh"]
    assert [r["predicted_label"] for r in rows] == ["safe", "safe", "safe"]
    with pytest.raises(ValueError, match="missing"):
        predict_and_flag(df, loader(), {}, "m", text="missing")


# --- reports ---


def test_report(spark):
    rows = [
        ("a", "english", "flagged/f1", 0.9),
        ("a", "english", "flagged/fpr", 0.2),
        ("b", "english", "flagged/f1", 0.8995),
        ("b", "english", "flagged/fpr", 0.1),
        ("b", "italian", "flagged/f1", None),
    ]
    df = spark.createDataFrame(rows, "model string, slice string, metric string, value double")
    names = ["flagged/f1", "flagged/fpr"]
    table = report.report_table(df, ["b", "a", "c"], names, include_all=False).collect()
    assert [r["model"] for r in table] == ["b", "a", "c"]
    assert table[0]["f1_italian"] == 0.0 and table[2]["f1_english"] == 0.0
    best = {
        (r["model"], r["metric"]): (r["cell"], r["is_best"])
        for r in report.best_marks(df, ["a", "b"], names, ["english"]).collect()
    }
    assert best == {
        ("a", "flagged/f1"): ("0.900", True),
        ("b", "flagged/f1"): ("0.900", True),
        ("a", "flagged/fpr"): ("0.200", False),
        ("b", "flagged/fpr"): ("0.100", True),
    }


@pytest.mark.parametrize("score", [0.9, 0.3])
def test_null_labels_are_refused(spark, score):
    # Whether or not the null label's score ties with another row's.
    rows = [(1, [0.1, 0.9]), (0, [0.8, 0.2]), (None, [1 - score, score])]
    df = spark.createDataFrame(rows, "y int, p array<double>").withColumn("s", F.element_at("p", 2))
    for found in (
        lambda: metrics.binary_metrics(df, "p", "y"),
        lambda: metrics.confusion(df, "y", "y"),
        lambda: metrics.label_confusion(df.withColumn("t", F.array("y", F.lit(1))), "p", "t"),
        lambda: curves.auc_pr(df, "s", "y"),
    ):
        with pytest.raises(Exception, match="null in label column"):
            found().collect()


def test_slice_that_has_the_total_s_name(spark):
    rows = [(1, [0.1, 0.9], "all"), (1, [0.9, 0.1], "it"), (0, [0.8, 0.2], "it")]
    df = spark.createDataFrame(rows, "y int, p array<double>, g string")
    found = {
        (r["slice"], r["total"]): r["value"]
        for r in metrics.binary_metrics(df, "p", "y", "g").where("metric = 'accuracy'").collect()
    }
    assert found[("all", False)] == 1.0 and found[("all", True)] == pytest.approx(2 / 3)
