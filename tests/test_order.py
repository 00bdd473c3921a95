"""Running totals, quantiles, splits and curves against plain numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsieve.operators import curves, sampling
from labelsieve.operators.prefix import running_totals, with_row_id
from labelsieve.operators.quantile import EmptyColumnError, quantile
from labelsieve.operators.sampling import assign_split, hash_order, split_sizes


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- running totals ---


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("bucket_rows", [7, 10_000])
def test_running_totals_by_group(spark, descending, bucket_rows):
    rng = random.Random(5)
    rows = []
    for group, n in (("a", 300), (None, 120), ("tiny", 3)):
        for x in rng.sample(range(10_000), n):
            rows.append((group, x / 7.0, rng.randrange(5)))
    df = spark.createDataFrame(rows, "g string, x double, v long").repartition(5)
    got = running_totals(df, "x", ["v"], ["g"], descending, bucket_rows).collect()
    assert len(got) == len(rows)
    want = {}
    for group in ("a", None, "tiny"):
        part = sorted((r for r in rows if r[0] == group), key=lambda r: r[1], reverse=descending)
        total, upto = sum(r[2] for r in part), 0
        for r in part:
            upto += r[2]
            want[(group, r[1])] = (r[2], upto, total)
    assert {(r["g"], r["x"]): (r["v"], r["cum_v"], r["total_v"]) for r in got} == want


def test_row_ids_do_not_depend_on_partitions(spark):
    df = spark.range(500).select((F.col("id") * 37 % 5003).alias("k"))
    order = sorted(i * 37 % 5003 for i in range(500))
    for parts, bucket_rows in ((1, 1000), (9, 20)):
        got = with_row_id(df.repartition(parts), "k", bucket_rows=bucket_rows).collect()
        assert {r["k"]: r["row_id"] for r in got} == {k: i for i, k in enumerate(order)}


def test_bucketed_totals_keep_base_rows_spread(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).alias("one"))
    plan = plan_of(running_totals(df, "k", ["one"], bucket_rows=50))
    assert "hashpartitioning(_bucket" in plan
    # What goes to one task is the bucket totals, not the rows.
    at = plan.index("SinglePartition")
    assert "HashAggregate(keys=[_bucket" in plan[at : at + 400]


# --- quantiles ---


@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.95, 1.0])
@pytest.mark.parametrize("small", [0, 10_000])
def test_quantile(spark, q, small):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=700), np.full(350, 0.25), [9.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
    got = quantile(df, "v", q, small=small, bucket_rows=40)
    assert got == pytest.approx(float(np.quantile(values, q)), abs=1e-12)


def test_quantile_edges(spark):
    nan = spark.createDataFrame([(1.0,), (float("nan"),)], "v double")
    assert math.isnan(quantile(nan, "v", 0.5))
    with pytest.raises(EmptyColumnError):
        quantile(spark.createDataFrame([(None,)], "v double"), "v", 0.5)
    with pytest.raises(ValueError):
        quantile(nan, "v", 1.5)
    one = spark.createDataFrame([(4.0,)], "v double")
    assert quantile(one, "v", 0.95) == quantile(one, "v", 0.95, small=0) == 4.0
    assert quantile(one, "v", 0.95, method="approx") == 4.0


# --- splits ---


@pytest.mark.parametrize("n", [3, 10, 137])
def test_split_is_exact_and_complete(spark, n):
    df = spark.range(n)
    got = {r["id"]: r["split"] for r in assign_split(df.repartition(3), "id").collect()}
    test = math.ceil(n * 0.2)
    held = math.ceil((n - test) * 0.1)
    assert sorted(got) == list(range(n))
    assert sum(v == "test" for v in got.values()) == test
    assert sum(v == "eval" for v in got.values()) == held
    again = {r["id"]: r["split"] for r in assign_split(df.coalesce(1), "id").collect()}
    assert again == got
    other = {r["id"]: r["split"] for r in assign_split(df, "id", seed=1).collect()}
    assert n < 50 or other != got


def test_split_cut_over_many_prefixes(spark, monkeypatch):
    df = spark.range(3000)
    plain = assign_split(df, "id").where("split = 'test'").select("id")
    monkeypatch.setattr(sampling, "_SHORT_LIST", 2)
    monkeypatch.setattr(sampling, "_DIGITS", 1)
    narrow = assign_split(df, "id").where("split = 'test'").select("id")
    assert plain.count() == 600
    assert plain.exceptAll(narrow).count() == narrow.exceptAll(plain).count() == 0


def test_split_refuses(spark):
    with pytest.raises(ValueError, match="at least 2"):
        assign_split(spark.range(1), "id")
    with pytest.raises(ValueError, match="nulls"):
        assign_split(spark.createDataFrame([(1,), (None,), (3,)], "id long"), "id")
    same = spark.createDataFrame([(1,)] * 20, "id long")
    with pytest.raises(ValueError, match="not unique"):
        assign_split(same, "id")
    with pytest.raises(ValueError, match="no rows are left"):
        assign_split(spark.range(2), "id", 0.6, 0.5)
    with pytest.raises(ValueError):
        split_sizes(10, 1.5, 0.1)
    assert split_sizes(1000, 0.2, 0.1) == (720, 80, 200)


def test_two_way_split(spark):
    got = assign_split(spark.range(25), "id", test_ratio=0.0)
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"train": 22, "eval": 3}


def test_split_is_a_projection(spark):
    df = spark.range(100)
    plan = plan_of(assign_split(df, "id"))
    assert "Exchange" not in plan and "Sort" not in plan
    assert "md5" in plan and hash_order("id") is not None


# --- curves ---


def reference_curve(y, s):
    """Precision and recall per distinct score, lowest first, then the end point."""
    thresholds = sorted(set(s))
    positives = sum(y)
    precision, recall = [], []
    for t in thresholds:
        picked = [a for a, b in zip(y, s) if b >= t]
        precision.append(sum(picked) / len(picked))
        recall.append(sum(picked) / positives if positives else 1.0)
    return thresholds, [*precision, 1.0], [*recall, 0.0]


def reference_area(y, s):
    _, p, r = reference_curve(y, s)
    return -sum((r[i + 1] - r[i]) * (p[i + 1] + p[i]) / 2 for i in range(len(p) - 1))


CASES = {
    "mixed top tie": ([1, 1, 1, 0, 1, 1, 0, 0, 0, 0], [1.0] * 4 + [0.0] * 6),
    "no positives": ([0, 0, 0], [0.1, 0.2, 0.3]),
    "all positives": ([1, 1, 1], [0.1, 0.2, 0.2]),
    "one row": ([1], [0.4]),
    "random": (
        [random.Random(i).randrange(2) for i in range(200)],
        [round(random.Random(i + 999).random(), 2) for i in range(200)],
    ),
}


@pytest.mark.parametrize("bucket_rows", [5, 10_000])
def test_curves_against_counting(spark, bucket_rows):
    rows = [(name, a, b) for name, (y, s) in CASES.items() for a, b in zip(y, s)]
    df = spark.createDataFrame(rows, "name string, y int, s double").repartition(3)
    points = curves.pr_curve(df, "s", "y", ["name"], bucket_rows=bucket_rows).collect()
    areas = curves.auc_pr(df, "s", "y", ["name"], bucket_rows=bucket_rows).collect()
    best = curves.tune_threshold(df, "s", "y", ["name"], bucket_rows=bucket_rows).collect()
    for name, (y, s) in CASES.items():
        thresholds, precision, recall = reference_curve(y, s)
        got = {r["threshold"]: r for r in points if r["name"] == name}
        assert len(got) == len(thresholds) + 1
        for t, p, r in zip([*thresholds, None], precision, recall):
            assert (got[t]["precision"], got[t]["recall"]) == pytest.approx((p, r))
        area = next(r["aucpr"] for r in areas if r["name"] == name)
        assert area == pytest.approx(reference_area(y, s), abs=1e-12)
        f1 = [2 * (p * r) / (p + r + 1e-8) for p, r in zip(precision, recall)]
        assert next(r["threshold"] for r in best if r["name"] == name) == thresholds[int(np.argmax(f1))]


def test_known_areas(spark):
    for name, want in (("mixed top tie", 0.775), ("no positives", 0.5)):
        df = spark.createDataFrame(list(zip(*CASES[name])), "y int, s double")
        assert curves.auc_pr(df, "s", "y").first()["aucpr"] == pytest.approx(want)


def test_edges_and_brackets_from_samples(spark, monkeypatch):
    """Samples steer only how the work is cut; the answers stay exact."""
    from labelsieve.operators import quantile as quantile_module

    monkeypatch.setattr(quantile_module, "SKETCH_ROWS", 200)
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit(1).alias("one"))
    got = running_totals(df, "k", ["one"], bucket_rows=100)
    ranks = [r["cum_one"] for r in got.orderBy("k").collect()]
    assert ranks == list(range(1, 5001))
    keys = np.array([i * 7919 % 5003 for i in range(5000)])
    for q in (0.01, 0.5, 0.95):
        assert quantile(df, "k", q, small=0, bucket_rows=50) == pytest.approx(float(np.quantile(keys, q)))
