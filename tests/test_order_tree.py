"""Nested buckets: every order, no bucket over its rows, right totals at any depth."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelsieve.operators import order_tree, parts
from labelsieve.operators.chat import render_chat
from labelsieve.operators.order_tree import find_cuts, with_bucket
from labelsieve.operators.prefix import running_totals


def spread(kind, n=20_000):
    rng = np.random.default_rng(1)
    if kind == "even":
        return list(range(n))
    if kind == "far apart":
        return [i * 100_003 for i in range(n)]
    if kind == "one cluster":
        return sorted({*np.round(5.0 + rng.random(n) * 1e-9, 15).tolist(), -1e12, 1e12})
    if kind == "powers":
        return (2.0 ** rng.uniform(-900, 900, n)).tolist()
    if kind == "both signs":
        return np.unique(np.concatenate([-np.exp(rng.uniform(-200, 200, n // 2)), np.exp(rng.uniform(-200, 200, n // 2)), [0.0]])).tolist()
    if kind == "below zero":
        return (-(1.0 + np.arange(n)) ** 3).tolist()
    raise ValueError(kind)


@pytest.mark.parametrize("kind", ["even", "far apart", "one cluster", "powers", "both signs", "below zero"])
def test_no_bucket_exceeds_its_rows(spark, kind):
    values = [float(v) for v in spread(kind)]
    df = spark.createDataFrame([(v,) for v in random.Random(1).sample(values, len(values))], "v double")
    (cut,) = find_cuts(df, "v", [], 37)
    assert cut.edges == sorted(set(cut.edges)) and set(cut.edges) <= set(values)
    rows = with_bucket(df, "v", [], [cut]).collect()
    found = {}
    for r in rows:
        found.setdefault(r["_bucket"], []).append(r["v"])
    assert max(map(len, found.values())) <= 37 and len(found) == len(cut.edges) + 1
    # Not many more than needed: two neighbours hold more than one may.
    assert len(found) <= 2 * len(values) / 37 + 2
    ordered = [v for b in sorted(found) for v in sorted(found[b])]
    assert ordered == sorted(values)


def test_twenty_five_thousand_buckets_in_one_group(spark):
    n = 250_000
    df = spark.range(n, numPartitions=8).select(F.lit("a").alias("g"), (F.col("id") * 7919 % n).alias("v"), F.lit(1).alias("one"))
    df = df.unionByName(spark.createDataFrame([("b", 5, 1), (None, 5, 1), (None, 6, 1)], "g string, v long, one int"))
    cuts = find_cuts(df, "v", ["g"], 10)
    assert len(cuts) == 1 and len(cuts[0].edges) >= 24_999
    sizes = with_bucket(df, "v", ["g"], cuts).groupBy("g", "_bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 10
    out = running_totals(df, "v", ["one"], ["g"], bucket_rows=10)
    wrong = out.where(F.when(F.col("g") == "a", F.col("cum_one") != F.col("v") + 1).otherwise(F.lit(False)))
    assert out.count() == n + 3 and wrong.count() == 0
    assert {(r["g"], r["v"], r["cum_one"], r["total_one"]) for r in out.where("g is null or g = 'b'").collect()} == {
        ("b", 5, 1, 1), (None, 5, 1, 2), (None, 6, 2, 2)
    }


def test_nulls_nan_and_infinities_keep_their_order(spark):
    inf, nan = float("inf"), float("nan")
    values = [None, -inf, -1.7976931348623157e308, -2.5, -0.5, 0.0, 1e-300, 3.0, 1.7976931348623157e308, inf, nan]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, one int")
    for descending in (False, True):
        rows = running_totals(df, "v", ["one"], descending=descending, bucket_rows=2).collect()
        rank = {repr(r["v"]): r["cum_one"] for r in rows}
        order = values[::-1] if descending else values
        assert [rank[repr(v)] for v in order] == list(range(1, len(values) + 1))


def test_dates_and_times(spark):
    for kind in ("date", "timestamp"):
        df = spark.range(500).select(F.expr(f"cast(timestamp_seconds(id * 86400) as {kind})").alias("v"), "id", F.lit(1).alias("one"))
        rows = running_totals(df, "v", ["one"], bucket_rows=9).collect()
        assert all(r["cum_one"] == r["id"] + 1 for r in rows)


def test_numbers_beyond_doubles_share_a_bucket(spark):
    df = spark.range(3000).select((F.col("id") + F.lit(2**62)).alias("v"), "id", F.lit(1).alias("one"))
    rows = running_totals(df, "v", ["one"], bucket_rows=10).collect()
    assert all(r["cum_one"] == r["id"] + 1 for r in rows)


def test_tree_of_edges():
    edges = [float(k) for k in range(1, 5000)]
    depth = math.ceil(math.log(len(edges) + 1, order_tree.FANOUT))
    tree = {(level, path): s for level, path, s in order_tree._levels(edges, depth)}
    for value in (0.0, 1.0, 1.5, 64.0, 64.5, 4095.5, 4096.5, 4999.0, 9e9):
        path = 0
        for level in range(depth):
            path = path * order_tree.FANOUT + sum(e < value for e in tree[level, path])
        assert path == sum(e < value for e in edges)


def test_many_rows_widen_the_buckets(spark, monkeypatch):
    monkeypatch.setattr(order_tree, "MOST_EDGES", 40)
    df = spark.range(1000).withColumnRenamed("id", "v")
    (cut,) = find_cuts(df, "v", [], 1)
    assert 5 <= len(cut.edges) <= 40


def test_sparse_ids_are_joined_in_pieces(spark):
    """Ids 100,000 apart: no task but the last sorts more rows than a piece has."""
    n = 5000
    df = spark.range(n).select(
        (F.col("id") * 100_000).alias("at"), F.lit("k").alias("g"), F.col("id").cast("string").alias("t"), F.col("id").alias("v")
    )
    df = df.unionByName(spark.createDataFrame([(3, None, "x", 1), (1, None, "y", 2), (9, "z", None, 3)], "at long, g string, t string, v long")).repartition(5)
    whole = parts.join_in_order(df, ["g"], "at", F.col("t"), "-", "text", {"total": F.col("v")}, ["v"])
    pieces = parts.join_in_order(
        df, ["g"], "at", F.col("t"), "-", "text", {"total": F.col("v")}, ["v"], piece_rows=100, pieces=4
    )
    found = {r["g"]: (r["at"], r["v"], r["text"], r["total"]) for r in pieces.collect()}
    assert found == {r["g"]: (r["at"], r["v"], r["text"], r["total"]) for r in whole.collect()}
    assert found["k"] == (0, 0, "-".join(map(str, range(n))), n * (n - 1) // 2)
    assert found[None] == (1, 2, "y-x", 3) and found["z"][3] == 3
    # 50 pieces, then 13, 4 and the whole.
    plan = pieces._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("listagg") >= 4


def test_turns_without_role_or_text_keep_their_tags(spark):
    rows = [("c", 1, "user", "hi"), ("c", 2, None, "who"), ("c", 3, "bot", None), ("d", 1, None, None)]
    df = spark.createDataFrame(rows, "c string, turn int, role string, text string")
    found = {r["c"]: (r["n_turns"], r["text"]) for r in render_chat(df, ["c"], "turn", "role", "text").collect()}
    assert found == {"c": (3, "<|user|>\nhi\n<||>\nwho\n<|bot|>\n\n"), "d": (1, "<||>\n\n")}
