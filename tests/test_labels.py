"""Rules, ratings and labels on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.functions.rules import rule_label
from labelsieve.operators import labels as lab
from labelsieve.operators import ratings as rat
from labelsieve.operators.parts import with_parts
from labelsieve.plans.labelled_data import label_ratings

NAN = float("nan")


def labels_of(spark, values, dtype, rule):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    out = df.select("i", rule_label(F.col("v"), df.schema["v"].dataType, rule).alias("l"))
    return [r["l"] for r in out.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ("<2", [1, 0, 0, 0, None]),
        ("<=2", [1, 1, 0, 0, None]),
        (">2", [0, 0, 1, 0, None]),
        (" >= 2.0 ", [0, 1, 1, 0, None]),
        ("==2", [0, 1, 0, 0, None]),
        ("!=2", [1, 0, 1, 1, None]),
        ("", [1, 1, 1, 1, 0]),
    ],
)
def test_number_rules(spark, rule, want):
    assert labels_of(spark, [1.0, 2.0, 3.0, NAN, None], "double", rule) == want


def test_empty_rule_is_truthiness(spark):
    assert labels_of(spark, [0, 2, None], "int", "") == [0, 1, 0]
    assert labels_of(spark, ["", "x", None], "string", "") == [0, 1, 0]
    assert labels_of(spark, [True, False], "boolean", "") == [1, 0]


def test_text_rules(spark):
    assert labels_of(spark, ["a", "b"], "string", "== 'a'") == [1, 0]
    assert labels_of(spark, ["a", "b"], "string", '!="a"') == [0, 1]


@pytest.mark.parametrize("rule", ["2", "<", "< 2 or True", "<2; x", "is None", "< __import__('os')"])
def test_bad_rules(spark, rule):
    with pytest.raises(ValueError):
        rule_label(F.lit(1), T.IntegerType(), rule)


RATED = "row_id long, text string, target string, title string, acceptability int, cluster int, tag string"


@pytest.fixture
def rated(spark):
    rows = [
        (5, "a", "t", "x", 3, 1, "late"),
        (1, "a", "t", "x", 1, None, "first"),
        (2, "a", "t", "x", None, 0, "unrated"),
        (3, "a", None, "x", 4, 0, "null key"),
        (4, "a", None, "x", 2, 1, "null key too"),
        (6, "b", "t", "x", 2, None, None),
    ]
    return spark.createDataFrame(rows, RATED)


def groups(df):
    return {
        (r["text"], r["target"]): (r["row_id"], r["tag"], r["cluster"], r[rat.JOINED], r[rat.MEAN])
        for r in df.collect()
    }


def test_rating_groups(rated):
    got = groups(rat.prepare_ratings(rated))
    assert got == {
        ("a", "t"): (1, "first", None, "1, 3", 2.0),
        ("a", None): (3, "null key", 0, "4, 2", 3.0),
        ("b", "t"): (6, None, None, "2", 2.0),
    }


def test_null_cluster_survives_both_filters(rated):
    assert groups(rat.prepare_ratings(rated, "cluster 0"))[("a", "t")][3] == "1"
    assert groups(rat.prepare_ratings(rated, "cluster 1"))[("a", "t")][3] == "1, 3"
    assert ("b", "t") in groups(rat.prepare_ratings(rated, "cluster 1"))
    with pytest.raises(ValueError):
        rat.filter_cluster(rated, "cluster 2")


def test_missing_rating_column(rated):
    with pytest.raises(ValueError, match="title"):
        rat.aggregate_ratings(rated.drop("title"))


def test_nan_rating_makes_nan_mean(spark):
    df = spark.createDataFrame(
        [(1, "a", "t", "x", 1.0), (2, "a", "t", "x", NAN)],
        "row_id long, text string, target string, title string, acceptability double",
    )
    (row,) = rat.prepare_ratings(df).collect()
    assert row[rat.JOINED] == "1.0, nan"
    assert math.isnan(row[rat.MEAN])


def test_mean_is_float32_before_the_rule(spark):
    df = spark.createDataFrame(
        [(1, "a", "t", "x", 0.1)],
        "row_id long, text string, target string, title string, acceptability double",
    )
    out = lab.binarise(rat.prepare_ratings(df), rat.MEAN, "<=0.1")
    assert out.schema[rat.MEAN].dataType == T.FloatType()
    assert out.first()["label"] == 0


@pytest.mark.parametrize("gap", [1, 1000])
def test_large_group_is_one_row_and_parts_count_rows(spark, gap):
    n = 1000
    df = spark.range(n).select(
        (F.col("id") * gap).alias("row_id"),
        F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).otherwise("hot").alias("text"),
        F.lit("t").alias("target"),
        F.lit("x").alias("title"),
        (F.col("id") % 7).cast("int").alias("acceptability"),
    )
    hot = [k for k in range(n) if k % 5]
    want = ", ".join(str(k % 7) for k in hot)
    for span in (7, 100, 65_536):
        rows = {r["text"]: r for r in rat.aggregate_ratings(df, piece_rows=span).collect()}
        assert len(rows) == 201 and rows["hot"][rat.JOINED] == want
        assert rows["hot"][rat.MEAN] == pytest.approx(sum(k % 7 for k in hot) / len(hot))
        assert rows["hot"]["row_id"] == gap
    parts = [r for r in rat.rating_parts(df, 90).orderBy("part").collect() if r["text"] == "hot"]
    assert [r["part"] for r in parts] == list(range(9))
    assert [r["n_ratings"] for r in parts] == [90] * 8 + [80]
    assert ", ".join(r[rat.JOINED] for r in parts) == want
    data = label_ratings(df, "single_label_classification", rule="<3", label_column=rat.MEAN)
    assert {r["text"]: r[rat.JOINED] for r in data.rows.collect()}["hot"] == want


def test_null_and_position_tell_keys_apart(spark):
    df = spark.createDataFrame(
        [(i, *k) for i, k in enumerate([("a", None), (None, "a"), ("a", None), (None, "a")] * 5)],
        "row_id long, k string, l string",
    )
    out = with_parts(df, ["k", "l"], "row_id", 4)
    assert out.groupBy("k", "l", "part").count().select("part", "count").collect().count((2, 2)) == 2
    with pytest.raises(ValueError):
        with_parts(df, ["k"], "l", 4)


def test_label_ratings_end_to_end(rated):
    data = label_ratings(rated, "single_label_classification", rule="<=2", label_column=rat.MEAN)
    assert data.id2label == {0: "safe", 1: "unsafe"}
    assert {(r["text"], r["target"]): r["label"] for r in data.rows.collect()} == {
        ("a", "t"): 1,
        ("a", None): 0,
        ("b", "t"): 1,
    }
    with pytest.raises(ValueError):
        label_ratings(rated, "regression")


def test_multi_hot(spark):
    df = spark.createDataFrame(
        [(1, (True, False, None)), (2, (None, True, True))],
        "i int, label struct<S1:boolean,S2:boolean,S3:boolean>",
    )
    assert lab.label_names(df) == ["S1", "S2", "S3"]
    assert [r["label"] for r in lab.multi_hot(df).orderBy("i").collect()] == [[1, 0, 0], [0, 1, 1]]
    ordered = lab.multi_hot(df, labels=["S2"], strict=True)
    assert [r["label"] for r in ordered.orderBy("i").collect()] == [[0], [1]]
    with pytest.raises(Exception, match="S1 is null"):
        lab.multi_hot(df, labels=["S1"], strict=True).collect()
    with pytest.raises(ValueError, match="S9"):
        lab.multi_hot(df, labels=["S9"])


@pytest.mark.parametrize(
    ("values", "dtype", "want"),
    [
        ([0, 1, None], "int", [0, 1]),
        ([True, False], "boolean", [1, 0]),
        (["Safe", " UNSAFE"], "string", [0, 1]),
        (["unhealthy", "Healthy", "healthy"], "string", [1, 0, 0]),
        (["unsafe"], "string", [1]),
    ],
)
def test_inferred_mapping(spark, values, dtype, want):
    df = spark.createDataFrame([(f"t{i}", v) for i, v in enumerate(values)], f"text string, label {dtype}")
    assert [r["label"] for r in lab.prepare_labelled(df).orderBy("text").collect()] == want


@pytest.mark.parametrize("values", [["0"], ["true"], ["safe", "healthy"], ["a", "b", "c"]])
def test_mapping_that_cannot_be_inferred(spark, values):
    df = spark.createDataFrame([("t", v) for v in values], "text string, label string")
    with pytest.raises(ValueError, match="no known label pair"):
        lab.infer_label_mapping(df)


def test_empty_labels_give_the_safety_pair(spark):
    df = spark.createDataFrame([], "text string, label string")
    assert lab.infer_label_mapping(df) == {"safe": 0, "unsafe": 1}


def test_explicit_mapping(spark):
    df = spark.createDataFrame([("a", 2), ("b", 1), ("c", 3), (None, 1)], "body string, vote int")
    out = lab.prepare_labelled(df, "body", "vote", {"2": 0, "1": 1})
    assert out.columns == ["text", "label"]
    assert {(r["text"], r["label"]) for r in out.collect()} == {("a", 0), ("b", 1)}
    text = spark.createDataFrame([("a", "Safe"), ("b", "safe")], "text string, label string")
    literal = lab.prepare_labelled(text, mapping={"safe": 0}, literal=True)
    assert [r["text"] for r in literal.collect()] == ["b"]
    with pytest.raises(ValueError, match="vote"):
        lab.prepare_labelled(df.drop("vote"), "body", "vote")


def test_append_train(spark):
    train = spark.createDataFrame([("a", 1, "t")], "text string, label int, target string")
    extra = spark.createDataFrame([("b", 0)], "text string, label int")
    out = lab.append_train(train, extra)
    assert {tuple(r) for r in out.collect()} == {("a", 1, "t"), ("b", 0, None)}


def test_vocabulary():
    lab.check_vocabulary({0: "safe", 1: "unsafe"}, {0: "safe", 1: "unsafe"})
    with pytest.raises(ValueError, match="labels differ"):
        lab.check_vocabulary({0: "safe", 1: "unsafe"}, {0: "safe", 1: "other"})
    with pytest.raises(ValueError, match="ids differ"):
        lab.check_vocabulary({0: "safe", 1: "unsafe"}, {1: "safe", 0: "unsafe"})
