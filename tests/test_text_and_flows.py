"""Text functions, perplexity, files, scoring hook, streaming and training."""

import json
import math
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from labelsieve.functions import text as txt
from labelsieve.operators.chat import render_chat
from labelsieve.operators.perplexity import MaskedCounts, array_perplexity, count_tokens, score_tokens, text_perplexity
from labelsieve.operators.scoring import attach, filter_rows, map_batches, map_rows, remaining, score
from labelsieve.operators.skew import lookup_join
from labelsieve.plans.labelled_data import load_labelled, load_labelled_csv
from labelsieve.plans.predict_and_flag import flag_into, predict_and_flag
from labelsieve.plans.train import TextClassifier, train_text_classifier
from labelsieve.session import fill_cores, release, scratch_dir, spool
from labelsieve.sources import tables
from labelsieve.streaming.flags import read_text_stream, stream_flags

ID2LABEL = {0: "safe", 1: "unsafe"}


def size_model():
    def load():
        return lambda texts: np.array([[float(len(t)), 3.0] for t in texts])

    return load


# --- text ---


def test_decimal_text(spark):
    numbers = [
        0.0, -0.0, 1.0, -2.5, 0.001, 0.0001, 0.00012345, 1e-05, -1.5e-05, 1.2345e-10, 1e-100, 2.3e-308,
        123456.789, 1e7, 12345678.9, -98765432.125, 1e15, 123456789012345.6, 1e16, 1.5e16, 1.7e308,
        0.1 + 0.2, 1 / 3, 2 / 3, float("inf"), float("-inf"),
    ]
    df = spark.createDataFrame([(v,) for v in numbers], "v double")
    assert [r[0] for r in df.select(txt.decimal_text(F.col("v"))).collect()] == [repr(v) for v in numbers]
    nan = spark.createDataFrame([(float("nan"),), (None,)], "v double")
    assert [r[0] for r in nan.select(txt.decimal_text(F.col("v"))).collect()] == ["nan", None]


def test_json_lists(spark):
    words = ["a", 'q"uote', "back\\slash", "né, ü", "tab\t", "]", "["]
    df = spark.createDataFrame([(words, [0.5, 1e-05], [])], "w array<string>, d array<double>, e array<double>")
    got = df.select(
        txt.json_strings(F.col("w")), txt.json_numbers(F.col("d"), True), txt.json_numbers(F.col("e"), True)
    ).first()
    assert json.loads(got[0]) == words
    assert got[0] == json.dumps(words, ensure_ascii=False)
    assert (got[1], got[2]) == ("[0.5, 1e-05]", "[]")


def test_json_max(spark):
    cells = ["[0.1, 0.9]", "[]", "{}", "bad", None, "[3]", '["a"]']
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    assert [r[0] for r in df.select(txt.json_max(F.col("c"))).collect()] == [0.9, None, None, None, None, 3.0, None]


@pytest.mark.parametrize("template", ["{text}", "A {text} B {text}", "{{x}} {text}", "none", ""])
def test_template(spark, template):
    raw = "has {braces} and {text}"
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(txt.format_prompt(F.col("t"), template, ("<", ">"))).first()[0] == template.format(text=raw)


def test_prompt_priority_and_eos(spark):
    df = spark.createDataFrame([("a",), ("b</s>",)], "t string")
    t = F.col("t")
    assert [r[0] for r in df.select(txt.format_prompt(t, None, ("<", ">"))).collect()] == ["<a>", "<b</s>>"]
    assert [r[0] for r in df.select(txt.append_eos(t, "</s>")).collect()] == ["a</s>", "b</s>"]
    assert [r[0] for r in df.select(txt.append_eos(t, None)).collect()] == ["a", "b</s>"]


def test_tokenize(spark):
    df = spark.createDataFrame([("Hé, du—2 cafés!",), ("...",)], "t string")
    rows = txt.tokenize(df, "t", 3, "max_length").collect()
    assert rows[0]["tokens"] == ["hé", "du", "2"] and rows[0]["attention_mask"] == [1, 1, 1]
    assert rows[1]["tokens"] == ["<pad>"] * 3 and rows[1]["attention_mask"] == [0, 0, 0]
    free = txt.tokenize(df, "t", 3).collect()
    assert free[1]["tokens"] == [] and free[1]["attention_mask"] == []
    assert txt.effective_length(512, 100) == 100
    with pytest.raises(ValueError):
        txt.tokenize(df, "t", 3, "longest")


def test_chat(spark):
    turns = [(1, 2, "assistant", "yes"), (1, 1, "user", "is it?"), (2, 1, "user", "x")]
    df = spark.createDataFrame(turns, "c int, turn int, role string, text string")
    got = {r["c"]: r["text"] for r in render_chat(df, ["c"], "turn", "role", "text").collect()}
    assert got == {1: "<|user|>\nis it?\n<|assistant|>\nyes\n", 2: "<|user|>\nx\n"}
    long = spark.range(50).select(F.lit(1).alias("c"), F.col("id").alias("turn"), F.lit("u").alias("role"),
                                  F.col("id").cast("string").alias("text"))
    want = "".join(f"<|u|>\n{k}\n" for k in range(50))
    for span in (8, 65_536):
        rows = render_chat(long, ["c"], "turn", "role", "text", piece_rows=span).collect()
        assert [(r["n_turns"], r["text"]) for r in rows] == [(50, want)]


# --- perplexity ---

CORPUS = ["the cat sat", "the cat ran", "the dog sat on the mat", "a a a a a a a a"]
TARGET = {1: "the cat sat", 2: "the bird sat", 3: "...", 4: "a a a a a a a a a a", 5: "a a a a"}


def cut(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def triples_of(text):
    words = ["<s>", *cut(text), "</s>"]
    return [(words[i - 1], words[i], words[i + 1]) for i in range(1, len(words) - 1)]


def brute_force(a=1.0):
    corpus = [t for text in CORPUS for t in triples_of(text)]
    out = {}
    for key, text in TARGET.items():
        scores = []
        for left, word, right in triples_of(text):
            c_triple = sum(t == (left, word, right) for t in corpus)
            c_word = sum(t[1] == word for t in corpus) or 1
            c_context = sum((t[0], t[2]) == (left, right) for t in corpus)
            scores.append(math.log((c_triple + a * c_word / len(corpus)) / (c_context + a)))
        out[key] = scores
    return out


@pytest.mark.parametrize("hot_rows", [1, 3, 1000])
def test_perplexity(spark, hot_rows):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    target = spark.createDataFrame(list(TARGET.items()), "id int, text string")
    tokens = spool(score_tokens(target, count_tokens(corpus), "id", hot_rows=hot_rows))
    want = brute_force()
    got = {}
    for r in tokens.where("token is not null").orderBy("id", "position").collect():
        got.setdefault(r["id"], []).append(r["log_prob"])
        assert r["token_ppl"] == pytest.approx(math.exp(-r["log_prob"]))
    assert {k: v for k, v in want.items() if v} == {k: pytest.approx(v) for k, v in got.items()}
    per_text = text_perplexity(tokens, "id", with_tokens=True)
    rows = {r["id"]: r for r in per_text.withColumn("again", array_perplexity(F.col("token_scores"))).collect()}
    assert set(rows) == set(TARGET)
    assert math.isnan(rows[3]["pseudo_perplexity"]) and math.isnan(rows[3]["again"])
    assert rows[1]["pseudo_perplexity"] == pytest.approx(math.exp(-np.mean(want[1])))
    assert rows[1]["again"] == pytest.approx(rows[1]["pseudo_perplexity"])
    assert [t["token"] for t in rows[2]["token_scores"]] == ["the", "bird", "sat"]


def test_corpus_and_scored_texts_meet_in_one_shuffle(spark):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    target = spark.createDataFrame(list(TARGET.items()), "id int, text string")
    scored = score_tokens(target, count_tokens(corpus), "id")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"hashpartitioning\((\w+)#", plan)
    assert dealt.count("_c1") == 1 and not {"prev", "next", "_d1"} & set(dealt)
    # Rows are sorted once for both counts.
    assert len(re.findall(r"\bSort \[_c1", plan)) == 1


def test_texts_behind_a_join_fill_all_shuffle_partitions(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("-1", "24")):
        spark.conf.set(name, value)
    try:
        rows = spark.range(200).join(spark.range(200).withColumn("text", F.lit("a")), "id")
        assert fill_cores(rows, "id").rdd.getNumPartitions() == 24
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def test_counts_kept_score_the_same(spark, tmp_path):
    corpus = spark.createDataFrame([(t,) for t in CORPUS], "text string")
    target = spark.createDataFrame(list(TARGET.items()), "id int, text string")
    counts = count_tokens(corpus)
    counts.save(str(tmp_path / "counts"))
    kept = MaskedCounts.load(spark, str(tmp_path / "counts"))
    for hot_rows in (1, 1000):
        fresh, again = (
            sorted(map(str, score_tokens(target, c, "id", hot_rows=hot_rows).collect())) for c in (counts, kept)
        )
        assert fresh == again


def test_counts_can_be_kept(spark, tmp_path):
    counts = count_tokens(spark.createDataFrame([(t,) for t in CORPUS], "text string"))
    counts.save(str(tmp_path / "counts"))
    assert MaskedCounts.load(spark, str(tmp_path / "counts")).total == counts.total == 20


def test_hot_keys_are_spread(spark):
    rows = [(i, "hot" if i % 2 else None if i % 6 == 0 else f"k{i}") for i in range(600)]
    left = spark.createDataFrame(rows, "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("absent", 3)], "k string, v int")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(left, right, ["k"], ["i"], 600, hot_rows=50)
        assert {r["i"]: r["v"] for r in joined.collect()} == {i: {"hot": 1, "k2": 2}.get(k) for i, k in rows}
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert re.search(r"hashpartitioning\(k#\d+, _salt#", plan) and "BroadcastHashJoin" in plan


# --- scoring hook and joins ---


def test_score_keeps_row_order(spark):
    texts = ["a" * (i * 37 % 101) for i in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r["i"]: r["logits"] for r in score(df, "t", size_model(), batch_size=7).collect()}
    assert got == {i: [float(len("nan" if t is None else t)), 3.0] for i, t in enumerate(texts)}


def test_score_checks_the_model(spark):
    df = spark.createDataFrame([("a",), ("b",)], "t string").coalesce(1)

    def load():
        return lambda texts: np.zeros((1, 2))

    with pytest.raises(Exception, match="1 rows for 2 texts"):
        score(df, "t", load).collect()


def test_attach_compares_keys(spark):
    rows = spark.range(5).withColumnRenamed("id", "row_id")
    good = rows.withColumn("p", F.lit(0.5))
    assert attach(rows, good).count() == 5
    for bad in (good.limit(4), good.union(good.limit(1)), good.withColumn("row_id", F.col("row_id") + 1)):
        with pytest.raises(ValueError, match="do not match"):
            attach(rows, bad)
    with pytest.raises(ValueError, match="repeated"):
        attach(rows.union(rows), good.union(good))


def test_resume(spark):
    rows = spark.range(10).withColumnRenamed("id", "row_id")
    done = rows.where("row_id in (0, 1, 7)")
    assert {r["row_id"] for r in remaining(rows, done).collect()} == {2, 3, 4, 5, 6, 8, 9}


def test_flagging_resumes(spark, tmp_path):
    out = str(tmp_path / "flags")
    rows = spark.range(12).select(F.col("id").alias("row_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text"))
    flag_into(rows.where("row_id < 7"), out, size_model(), ID2LABEL, "m", default_threshold=0.6)
    first = {f.name for f in (tmp_path / "flags" / "scores").iterdir()}
    found = flag_into(rows, out, size_model(), ID2LABEL, "m", default_threshold=0.999)
    assert found.calibration.threshold == 0.999
    assert first < {f.name for f in (tmp_path / "flags" / "scores").iterdir()}
    flagged = found.rows.collect()
    assert sorted(r["row_id"] for r in flagged) == list(range(12))
    # One threshold for all rows, those of the first run too.
    assert all(r["manual_review"] == (r["prediction_confidence"] < 0.999) for r in flagged)
    assert found.summary.first()["flagged"] == sum(r["manual_review"] for r in flagged)
    with pytest.raises(Exception, match="already exists"):
        flag_into(rows, out, size_model(), ID2LABEL, "m", resume=False)


def test_generated_ids_are_refused_for_resuming(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("text\na\nb\n")
    rows = tables.read_labelled_csv(spark, path, row_id="row_id", multi_line=False)
    with pytest.raises(ValueError, match="ids that stay"):
        flag_into(rows, str(tmp_path / "out"), size_model(), ID2LABEL, "m")
    assert flag_into(rows, str(tmp_path / "out"), size_model(), ID2LABEL, "m", resume=False).rows.count() == 2


def test_user_functions(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, "a", big), (2, "bb", None), (3, "ccc", big + 2)], "i int, t string, b long")
    kept = filter_rows(df, lambda b: b["t"].str.len() > 1, ["t"])
    assert sorted((r["i"], r["b"]) for r in kept.collect()) == [(2, None), (3, big + 2)]
    assert filter_rows(df, lambda b: b["i"] > 0).count() == 3
    out = map_rows(df, lambda r: {"i": r["i"] * 10, "b": r["b"]}, "i int, b long")
    assert {(r["i"], r["b"]) for r in out.collect()} == {(10, big), (20, None), (30, big + 2)}
    same = map_batches(df, lambda b: b.assign(b=b["b"] + 2), df.schema)
    assert {r["b"] for r in same.collect()} == {big + 2, None, big + 4}


def test_model_is_loaded_once_per_process(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        import os
        import uuid

        import numpy as np

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda texts: np.zeros((len(texts), 2))

    rows = spark.range(4000).repartition(40).select(F.col("id").cast("string").alias("text"))
    score(rows, "text", load).collect()
    names = [f.name for f in tmp_path.iterdir()]
    assert len(names) == len({n.split("-")[0] for n in names}) <= 8


# --- files ---


def test_csv(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write('text,label,score\n"line\none, ""quoted""",0,1.5\nNA,1,x\nnan,,\n"",1,null\nplain,1,2\n')
    df = tables.read_labelled_csv(spark, path, {"label": "int", "score": "double"}, ["text"], row_id="row_id")
    got = [(r["text"], r["label"], r["score"]) for r in df.orderBy("row_id").collect()]
    frame = pd.read_csv(path)
    assert [g[0] for g in got] == [None if pd.isna(t) else t for t in frame["text"]]
    assert [g[1] for g in got] == [0, 1, None, 1, 1]
    assert [g[2] for g in got] == [1.5, None, None, None, 2.0]
    with pytest.raises(ValueError, match="absent"):
        tables.read_labelled_csv(spark, path, required=["absent"])
    kept = tables.csv_to_parquet(spark, path, str(tmp_path / "kept"), types={"label": "int"})
    assert kept.count() == 5 and kept.schema["label"].dataType.simpleString() == "int"


def test_prediction_table(spark, tmp_path):
    rows = [(1, "a", [0.25, 0.75], 0.3, True, 9.5, [(1, "a", -0.5, 1.6)])]
    schema = (
        "id int, text string, probs array<double>, loss double, unsure boolean, ppl double, "
        "tok array<struct<position:int,token:string,log_prob:double,token_ppl:double>>"
    )
    options = dict(loss="loss", uncertain="unsure", perplexity="ppl", token_scores="tok")
    df = spark.createDataFrame(rows, schema)
    tables.write_predictions(df, str(tmp_path / "p"), "my/model", **options)
    wide = spark.read.parquet(str(tmp_path / "p"))
    assert wide.columns == [
        "id", "text", "my/model_logit_class_0", "my/model_logit_class_1", "my/model_per_item_loss",
        "my/model_flag_uncertain", "my/model_pseudo_perplexity", "my/model_token_scores",
    ]
    assert wide.first()["my/model_logit_class_1"] == 0.75
    tables.write_predictions(df, str(tmp_path / "c.csv"), "m", fmt="csv", **options)
    back = tables.read_reference(spark, str(tmp_path / "c.csv")).first()
    assert json.loads(back["m_token_scores"])[0]["token"] == "a"
    with pytest.raises(ValueError):
        tables.write_flagged(df, str(tmp_path / "x"), "xml")


def test_metrics_on_disk(spark, tmp_path):
    df = spark.createDataFrame([("all", "f1", 0.5), ("it", "f1", 0.25)], "slice string, metric string, value double")
    tables.write_metrics(df, str(tmp_path / "m"), "a")
    got = tables.read_metrics(spark, str(tmp_path / "m"), ["a", "b"], ["all", "it"], ["f1"])
    assert {(r["model"], r["slice"]): r["value"] for r in got.collect()} == {
        ("a", "all"): 0.5, ("a", "it"): 0.25, ("b", "all"): 0.0, ("b", "it"): 0.0,
    }
    # A second run replaces its model and slice, whether its values are higher or lower.
    again = df.where("slice = 'it'").withColumn("value", F.lit(0.125))
    tables.write_metrics(again, str(tmp_path / "m"), "a")
    got = tables.read_metrics(spark, str(tmp_path / "m"), ["a"], ["all", "it"], ["f1"])
    assert {r["slice"]: r["value"] for r in got.collect()} == {"all": 0.5, "it": 0.125}
    none = tables.read_metrics(spark, str(tmp_path / "absent"), ["a"], ["all"], ["f1"], default=-1.0)
    assert [r["value"] for r in none.collect()] == [-1.0]
    tables.write_metrics(df.union(df), str(tmp_path / "twice"), "a")
    with pytest.raises(Exception, match="measured twice"):
        tables.read_metrics(spark, str(tmp_path / "twice"), ["a"], ["all"], ["f1"]).collect()


@pytest.mark.parametrize("template", ["{text}", "a {{text}} b", "{{{text}}}", "{{}}{text}{text}", "no field"])
def test_templates_are_read_as_format_reads_them(spark, template):
    df = spark.createDataFrame([("x",)], "t string")
    assert df.select(txt.format_prompt(F.col("t"), template)).first()[0] == template.format(text="x")


@pytest.mark.parametrize("template", ["{other}", "{text!r}", "{text:>5}", "{}", "{text"])
def test_other_fields_are_refused(template):
    with pytest.raises(ValueError):
        txt.format_prompt(F.col("t"), template)


def test_splits(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    spark.range(2).withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "b"))
    df = tables.load_splits(spark, {"train": str(tmp_path / "a"), "test": str(tmp_path / "b")})
    assert {(r["split"], r["x"]): r["count"] for r in df.groupBy("split", "x").count().collect()} == {
        ("train", None): 3, ("test", 1): 2,
    }
    with pytest.raises(ValueError):
        tables.load_splits(spark, {})


def test_scratch_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert scratch_dir(spark) == named
    df = spool(spark.range(4))
    assert df.count() == 4 and scratch_dir(spark).rstrip("/") in df.inputFiles()[0]


def test_labelled_data_from_disk(spark, tmp_path):
    schema = "row_id long, text string, target string, title string, acceptability int, cluster int"
    spark.createDataFrame([(1, "a", "t", "x", 1, 0), (2, "a", "t", "x", 2, 0)], schema).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(1, "a", "t", "x", 4, 1)], schema).write.parquet(str(tmp_path / "b"))
    data = load_labelled(
        spark,
        {"train": str(tmp_path / "a"), "test": str(tmp_path / "b")},
        problem_type="single_label_classification",
        rule="<2",
        label_column="average_acceptability",
    )
    assert {(r["split"], r["label"]) for r in data.rows.collect()} == {("train", 1), ("test", 0)}
    path = str(tmp_path / "l.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("body,vote\nx,2\ny,1\nz,\nw,3\n")
    rows = load_labelled_csv(spark, path, "body", "vote", {"2": 0, "1": 1}).rows
    assert {tuple(r) for r in rows.collect()} == {("x", 0), ("y", 1)}


# --- streaming ---


def test_stream_restart_adds_only_new_files(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "row_id long, text string"

    def arrive(first, n):
        rows = [(i, "x" * i) for i in range(first, first + n)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def run():
        query = stream_flags(
            read_text_stream(spark, src, schema, files_per_batch=1), out, mark, size_model(), ID2LABEL, 0.9
        )
        query.awaitTermination()
        return spark.read.parquet(out)

    arrive(0, 10)
    assert run().count() == 10
    assert run().count() == 10
    arrive(10, 5)
    rows = run().collect()
    assert sorted(r["row_id"] for r in rows) == list(range(15))
    assert {r["manual_review"] for r in rows if r["row_id"] in (3, 14)} == {True, False}


# --- training ---


def labelled(spark, n=240):
    rows = [(i, ("good fine nice " if i % 2 else "bad awful mean ") + f"w{i % 7} w{i % 11}", 1 - i % 2) for i in range(n)]
    return spark.createDataFrame(rows, "row_id int, text string, label int")


def test_training(spark):
    extra = spark.createDataFrame([("nice nice", 0), ("awful", 1)], "text string, label int")
    run = train_text_classifier(
        labelled(spark), ["safe", "unsafe"], extra=extra, n_features=1 << 10, max_iter=10, template="say {text}"
    )
    got = {r["metric"]: r["value"] for r in run.test_metrics.collect()}
    assert got["accuracy"] == got["unsafe_f1"] == 1.0
    assert {r["split"]: r["count"] for r in run.parts.groupBy("split").count().collect()} == {
        "train": 172, "eval": 20, "test": 48,
    }
    fresh = spark.createDataFrame([("fine",), (None,)], "text string")
    rows = run.classifier.logits(fresh).collect()
    assert rows[0]["logits"][0] > rows[0]["logits"][1] and len(rows) == 2


def test_multilabel_training(spark):
    rows = labelled(spark).withColumn(
        "label", F.array(F.col("label").cast("double"), (F.col("row_id") % 7 == 0).cast("double"))
    )
    run = train_text_classifier(
        rows, ["a", "b"], problem_type="multi_label_classification", tune=True, n_features=1 << 10, max_iter=10
    )
    got = {r["metric"]: r["value"] for r in run.test_metrics.collect()}
    assert got["a/f1"] > 0.9 and 0.0 < got["a/threshold"] < 1.0


def test_no_python_outside_the_hooks():
    """Python functions cross into tasks in the scoring module only (and in ``llm``, if it is there)."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "labelsieve")
    for folder, _, files in os.walk(root):
        for name in files if os.path.basename(folder) != "llm" else ():
            if name.endswith(".py") and name != "scoring.py":
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    code = f.read()
                assert not re.search(r"pandas_udf|mapInPandas|applyInPandas|\.rdd\b|F\.udf|localCheckpoint", code), name


def test_saved_classifier_scores_in_the_flows(spark, tmp_path):
    run = train_text_classifier(labelled(spark), ["safe", "unsafe"], n_features=1 << 10, max_iter=10)
    counts = {(r["split"], r["label"]): r["n_rows"] for r in run.label_counts.collect()}
    assert sum(counts.values()) == run.parts.count() and {s for s, _ in counts} == {"train", "eval", "test"}
    assert run.eval_loss.first()["eval_loss"] > 0.0
    run.classifier.save(str(tmp_path / "model"))
    back = TextClassifier.load(str(tmp_path / "model"))
    rows = run.parts.select("row_id", "text")
    want, _ = predict_and_flag(rows, run.classifier, ID2LABEL, "m")
    got, _ = predict_and_flag(rows, back, ID2LABEL, "m")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_release(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("labelsieve.session.scratch_dir", lambda _: str(tmp_path))
    other = tmp_path / "labelsieve" / "another-application"
    other.mkdir(parents=True)
    kept = spool(spark.range(3))
    assert kept.count() == 3 and len(list((tmp_path / "labelsieve").iterdir())) == 2
    release(spark)
    assert [f.name for f in (tmp_path / "labelsieve").iterdir()] == ["another-application"]
