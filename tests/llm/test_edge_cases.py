"""Defined results for nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelsieve.llm import (
    fingerprints,
    html_text,
    language,
    leaks,
    licenses,
    near,
    pieces,
    quality,
    tokens,
    toxicity,
)

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def by_id(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["doc_id"], []).append(r)
    return found


def test_fingerprints(odd, nothing):
    found = by_id(fingerprints.fingerprint_beside_next(odd))
    assert sum(map(len, found.values())) == 12 and len(found[None]) == 2 and len(found[5]) == 2
    assert found[1][0]["n_chars"] == 0 and found[1][0]["fingerprint"] == "" and found[1][0]["near_edited"] == 1.0
    assert found[2][0]["edited_sha256"] == hashlib.sha256(b"").hexdigest()
    # Equal texts have equal fingerprints, and the next of two repeated rows is the other.
    assert len({r["fingerprint"] for k in (5, 6) for r in found[k]}) == 1
    assert sorted(r["near_next"] for r in found[5]) == [1.0, 1.0]
    # The first row follows the last one: null ids come first, and null texts count as empty.
    assert found[9][0]["near_next"] == 0.0
    assert fingerprints.fingerprint_beside_next(nothing).collect() == []
    alone = fingerprints.fingerprint_beside_next(odd.where("doc_id = 7")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0


def test_near_join(odd, nothing):
    found = by_id(near.join_documents(odd))
    assert sum(map(len, found.values())) == 12
    same = [r for k in (5, 6, None) for r in found[k] if r["class_id"] == 5]
    assert len(same) == 4 and {r["links"] for r in same} == {3}
    for k in (1, 2, 3, 4, 7, 8, 9):
        assert (found[k][0]["class_id"], found[k][0]["links"]) == (k, 0)
    assert near.join_documents(nothing).collect() == []


def test_one_of_each(odd, nothing):
    kept = near.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] or 0, r["text"] is None) for r in kept.collect())
    # The null id stays where it has no text, and goes where row 5 stands for it.
    assert [i for i, _ in ids] == [0, 1, 2, 3, 4, 5, 7, 8, 9] and ids[0] == (0, True)
    assert near.one_of_each(nothing).collect() == []


def test_leaks(spark, odd, nothing):
    rows = [(1, "ONE two  three four five six seven", "x"), (None, "one two three four five six seven", "x"),
            (3, None, "x"), (4, "", "x"), (5, "short", "x")]
    items = spark.createDataFrame(rows, "item_id long, text string, doc_id string")
    found = leaks.find_leaks(odd, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0, r["distance"]) for r in found) == sorted(
        [(d, i, 0) for d in (5, 5, 6, 0) for i in (0, 1)]
    )
    assert {(r["begin"], r["end"]) for r in found} == {(0, 33)}
    assert leaks.find_leaks(nothing, items).collect() == []
    assert leaks.find_leaks(odd, items.limit(0)).collect() == []


def test_licenses(spark, odd, nothing):
    rows = [("A", "One, two three: four five six seven"), ("A", None), (None, "one two three four five"), ("B", "hi")]
    notices = spark.createDataFrame(rows, "license string, notice string")
    found = licenses.scan(odd, notices).collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["containment"]) for r in found) == [
        (d, "A", 1.0) for d in (0, 5, 5, 6)
    ]
    assert licenses.scan(nothing, notices).collect() == []
    none = licenses.scan(odd, notices.limit(0))
    assert none.collect() == [] and none.columns == licenses.scan(odd, notices).columns


def test_quality(odd, odd_labels, nothing, no_labels):
    found = by_id(quality.resample(odd, odd_labels, share=0.5))
    assert sum(map(len, found.values())) == 12
    assert found[1][0]["log_weight"] == 0.0 and found[2][0]["n_grams"] == 0
    assert found[5][0]["key"] == found[5][1]["key"]
    chosen = sum(r["selected"] for rows in found.values() for r in rows)
    assert chosen in (6, 7)  # the two equal rows are selected together
    assert len(quality.resample(odd, no_labels).collect()) == 12
    assert quality.resample(nothing, odd_labels).collect() == []


def test_toxicity(odd, odd_labels, nothing, no_labels):
    for labels in (odd_labels, no_labels):
        model = toxicity.fit_on(odd, labels)
        rows = toxicity.score_documents(odd, model).collect()
        assert len(rows) == 12 and all(0.0 <= r["score"] <= 1.0 for r in rows)
        scores = {r["doc_id"]: r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
        assert len(set(scores.values())) == 1
        assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert toxicity.fit_on(nothing, no_labels).weights == {}
    assert toxicity.score_documents(nothing, model).collect() == []


def test_language(odd, nothing):
    model = language.fit_on(odd)
    found = by_id(language.predict_documents(odd, model))
    for k in (1, 2, 3, 8):
        assert (found[k][0]["lang_pred"], found[k][0]["score"]) == ("und", 0.0)
    assert found[4][0]["lang_pred"] in ("en", "de") and 0.0 <= found[4][0]["score"] <= 1.0
    empty = language.fit_on(nothing)
    assert empty.languages == []
    assert {r["lang_pred"] for r in language.predict_documents(odd, empty).collect()} == {"und"}
    assert language.predict_documents(nothing, model).collect() == []


def test_tokens(odd, nothing):
    found = by_id(tokens.count_tokens(odd, WORDS))
    assert sum(map(len, found.values())) == 12
    assert (found[1][0]["n_tokens"], found[2][0]["n_bytes"], found[3][0]["n_tokens"]) == (0, 0, 0)
    assert found[4][0]["over_limit"] and not found[7][0]["over_limit"]
    assert tokens.count_tokens(nothing, WORDS).collect() == []


def test_pieces(odd, nothing):
    found = by_id(pieces.encode_documents(odd, MODEL))
    assert sum(map(len, found.values())) == 12
    assert found[1][0]["ids"] == [] and found[1][0]["decoded"] == ""
    # U+2581 is how the model writes a space; all else comes back.
    assert [k for k, rows in found.items() for r in rows if not r["same"]] == [9]
    assert pieces.encode_documents(nothing, MODEL).collect() == []


def test_pages(spark):
    rows = [(1, "u", None, "x"), (None, None, "", "x"), (2, "u", "<p>" + "long text " * 50_000, None),
            *[(2, "u", "<div><p>Same text on this page.</p></div>", "x")] * 2]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html_text.extract_pages(pages).collect()
    assert sorted(r["n_chars"] for r in found) == [0, 0, 23, 23, 499_999]
    assert html_text.extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(name, spark, odd, nothing, sf_dir):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, odd, sf_dir)
    if name != "pieces":
        assert out.dtypes == odd.dtypes
    out.collect()
    assert stage(spark, nothing, sf_dir).collect() == []


def test_stage_decisions(spark, odd, sf_dir):
    known = corpus_pipeline.keep_known_languages(spark, odd, sf_dir)
    assert not {1, 2, 3, 8} & {r["doc_id"] for r in known.collect()}
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.keep_known_languages(spark, unlabelled, sf_dir).count() == 12
