"""Commits while scoring, the classifier of counts, exact predicates, several models in one worker."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelsieve.operators import scoring
from labelsieve.operators.scoring import filter_rows, score_column
from labelsieve.plans.count_classifier import CountClassifier, fit_count_classifier
from labelsieve.plans.predict_and_flag import commit_slice, flag_into, score_into
from labelsieve.plans.train import COUNTS, train_text_classifier

ID2LABEL = {0: "safe", 1: "unsafe"}


class Stop(Exception):
    pass


def marking_model(path):
    """A model that notes every text it sees."""

    def load():
        import os
        import uuid

        import numpy as np

        def model(texts):
            with open(f"{path}/{os.getpid()}-{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            return np.stack([texts.str.len().to_numpy("float64"), np.zeros(len(texts))], axis=1)

        return model

    return load


def seen(path):
    return Counter(t for p in path.iterdir() for t in p.read_text().split("\n"))


def test_a_killed_run_keeps_its_commits(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "row_id long, text string")
    out, told = str(tmp_path / "out"), []

    def stop(done, of):
        told.append((done, of))
        if done == 3:
            raise Stop

    with pytest.raises(Stop):
        score_into(rows, out, marking_model(marks), ID2LABEL, commit_rows=25, committed=stop)
    assert told == [(1, 8), (2, 8), (3, 8)]
    kept = {r["row_id"] for r in spark.read.parquet(out).select("row_id").collect()}
    want = {r["row_id"] for r in rows.where(commit_slice("row_id", 8) < 3).collect()}
    assert kept == want and set(seen(marks)) == {f"text {i}" for i in kept}
    # New rows and the rest are scored, each row once over both runs.
    more = rows.unionByName(spark.createDataFrame([(500, "text 500")], "row_id long, text string"))
    scored = score_into(more, out, marking_model(marks), ID2LABEL, commit_rows=50)
    assert sorted(r["row_id"] for r in scored.collect()) == [*range(200), 500]
    assert seen(marks) == Counter(f"text {i}" for i in [*range(200), 500])


def test_a_failing_model_keeps_finished_slices(spark, tmp_path):
    bad = spark.range(100).where(commit_slice("id", 4) == 2).first()["id"]
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(100)], "row_id long, text string")

    def load():
        import numpy as np

        def model(texts):
            if (texts == f"text {bad}").any():
                raise ValueError("no answer")
            return np.zeros((len(texts), 2))

        return model

    out = str(tmp_path / "out")
    with pytest.raises(Exception, match="no answer"):
        flag_into(rows, out, load, ID2LABEL, "m", commit_rows=25)
    kept = spark.read.parquet(f"{out}/scores")
    assert kept.where(commit_slice("row_id", 4) >= 2).count() == 0
    assert kept.count() == rows.where(commit_slice("row_id", 4) < 2).count() > 0


def test_slices_hold_every_row(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id > 5 THEN id END AS k")
    for slices in (1, 2, 3, 7, 256):
        found = {r["s"]: r["count"] for r in rows.groupBy(commit_slice("k", slices).alias("s")).count().collect()}
        assert sum(found.values()) == 1000 and set(found) <= set(range(slices)) and found[0] >= 6


def test_commit_rows_is_checked(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a")], "row_id long, text string")
    with pytest.raises(ValueError, match="commit"):
        score_into(rows, str(tmp_path / "x"), marking_model(tmp_path), ID2LABEL, commit_rows=0)


def test_counts_by_hand(spark, tmp_path):
    train = [("Red red, blue", 0), ("red green", 1), ("green", 1), ("", 1), (None, 0), ("odd", None), ("far", 7)]
    model = fit_count_classifier(spark.createDataFrame(train, "text string, label int"))
    assert {r["token"]: r["counts"] for r in model.vocabulary.collect()} == {
        "red": [2, 1], "blue": [1, 0], "green": [0, 2], "nan": [1, 0]
    }
    assert model.texts == [2, 3]
    # Four tokens, four occurrences in class 0 and three in class 1.
    p = {"red": (3 / 8, 2 / 7), "green": (1 / 8, 3 / 7)}
    prior = (math.log(3 / 7), math.log(4 / 7))
    df = spark.createDataFrame([(1, "Green! red RED unknown"), (2, "unknown"), (3, ""), (3, "")], "id int, text string")
    path = str(tmp_path / "model")
    model.save(path)
    for m in (model, CountClassifier.load(path)):
        found = sorted((r["id"], r["logits"]) for r in m.logits(df).collect())
        want = [prior[k] + math.log(p["green"][k]) + 2 * math.log(p["red"][k]) for k in (0, 1)]
        assert found[0][1] == pytest.approx(want) and len(found) == 4
        assert all(x[1] == pytest.approx(list(prior)) for x in found[1:])


def test_counts_with_a_shuffled_vocabulary(spark, monkeypatch):
    from labelsieve.plans import count_classifier

    train = spark.createDataFrame([(f"w{i % 7} w{i % 3}", i % 2) for i in range(60)], "text string, label int")
    model = fit_count_classifier(train)
    rows = train.withColumn("id", F.monotonically_increasing_id())
    want = {r["id"]: r["logits"] for r in model.logits(rows).collect()}
    monkeypatch.setattr(count_classifier, "BROADCAST_TOKENS", 0)
    found = model.logits(rows)
    assert {r["id"]: pytest.approx(r["logits"]) for r in found.collect()} == want


def test_counts_without_rows(spark):
    none = spark.createDataFrame([], "text string, label int")
    model = fit_count_classifier(none)
    found = model.logits(spark.createDataFrame([("a",)], "text string")).first()
    assert found["logits"] == pytest.approx([math.log(0.5)] * 2)
    assert model.logits(none).collect() == []
    with pytest.raises(ValueError):
        fit_count_classifier(none, smoothing=0)


def test_training_flow_with_counts(spark):
    rows = spark.createDataFrame(
        [(i, "good fine" if i % 2 else "bad poor", i % 2) for i in range(100)], "row_id int, text string, label int"
    )
    run = train_text_classifier(rows, ["bad", "good"], learner=COUNTS)
    judged = {r["metric"]: r["value"] for r in run.test_metrics.collect()}
    assert judged["accuracy"] == 1.0
    with pytest.raises(ValueError):
        train_text_classifier(rows, ["bad", "good"], learner=COUNTS, problem_type="multi_label_classification")


def test_predicates_see_exact_numbers(spark):
    big = 2**53
    df = spark.createDataFrame([(big,), (big + 1,), (None,), (big + 2,)], "x long").coalesce(1)
    assert [r["x"] for r in filter_rows(df, lambda b: b["x"] == big + 1).collect()] == [big + 1]
    # A missing answer keeps no row, and any iterable of answers will do.
    assert filter_rows(df, lambda b: b["x"] > 0).count() == 3
    assert filter_rows(df, lambda b: [None if x == big else x != big + 1 for x in b["x"].fillna(big)]).count() == 1
    assert filter_rows(df, lambda b: (b["x"] > big).to_numpy(dtype=bool, na_value=False)).count() == 2


def test_two_models_in_one_plan_load_once(spark, tmp_path):
    def loader(name):
        def load():
            import uuid

            import numpy as np

            (tmp_path / f"{name}-{uuid.uuid4().hex}").write_text("")
            return lambda texts: np.zeros((len(texts), 1))

        return load

    df = spark.createDataFrame([(f"t{i}",) for i in range(40)], "t string").coalesce(1)
    col = F.col("t")
    out = df.select(score_column(col, loader("a")).alias("a"), score_column(col, loader("b")).alias("b"))
    assert len(out.collect()) == 40
    # One task, one worker: each model is loaded once, however the batches alternate.
    assert len(list(tmp_path.iterdir())) == 2


def test_kept_models_are_few():
    scoring._loaded.clear()
    for k in range(10):
        scoring._model(str(k), lambda k=k: k)
    assert list(scoring._loaded) == ["6", "7", "8", "9"]
    assert scoring._model("6", lambda: "again") == 6 and list(scoring._loaded) == ["7", "8", "9", "6"]
    scoring._loaded.clear()
