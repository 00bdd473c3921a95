"""What fitted models learn from: every script, long texts, copies, the same rows in every layout."""

import random

import numpy as np
import pytest

from labelsieve.llm import language, quality, toxicity

# First letter and number of letters of some scripts, three of them small.
SCRIPTS = {
    "zh": (0x4E00, 700), "ja": (0x6000, 700), "ko": (0xAC00, 700),
    "ka": (0x10D0, 33), "hy": (0x561, 38), "he": (0x5D0, 27), "got": (0x10330, 26),
}


def script_texts(lang, n, words=20, seed=1):
    first, letters = SCRIPTS[lang]
    rng = random.Random(f"{lang} {seed}")
    vocabulary = random.Random(lang)
    known = ["".join(chr(first + vocabulary.randrange(letters)) for _ in range(vocabulary.randrange(2, 6))) for _ in range(300)]
    return [" ".join(rng.choices(known, k=words)) for _ in range(n)]


def test_every_script_has_symbols():
    model = language.fit({lang: script_texts(lang, 100) for lang in SCRIPTS})
    for lang in SCRIPTS:
        best, score, _ = language.identify(model, script_texts(lang, 30, seed=2))
        assert best == [lang] * 30 and score.min() > 0.9


def test_symbols():
    assert bytes(language.symbols(" Éa  1-b? ")) == "éa b".encode()
    assert bytes(language.symbols("中\U00010330!")) == "中\U00010330".encode()
    assert len(language.symbols("12 ...")) == len(language.symbols("")) == 0


def test_long_texts_and_copies_are_learnt_from(spark):
    copies = [("en", "the same words again and again here")] * 3000
    rest = [("en", f"{w} {w}ing the other of words") for w in script_words("abcdefgh", 150)]
    # Long texts alone, whose beginnings have no letter.
    long = [("de", "1 " * 5_000 + f"und der die das {w} " * 3_000) for w in script_words("mnopqrst", 20)]
    rows = spark.createDataFrame(copies + rest + long, "lang string, text string")
    sample = language.training_sample(rows, "lang", "text")
    assert len(sample["en"]) == 100 == len(set(sample["en"]))
    assert len(sample["de"]) == 20 and max(map(len, sample["de"])) == language.TRAIN_CHARS
    assert sum("und der" in t for t in sample["de"]) > 10
    for parts in (1, 7, 40):
        assert language.training_sample(rows.repartition(parts), "lang", "text") == sample
    model = language.fit(sample)
    assert language.identify(model, ["das und die", "words of the other"])[0] == ["de", "en"]


def script_words(letters, n):
    rng = random.Random(letters)
    return ["".join(rng.choices(letters, k=7)) for _ in range(n)]


def test_shares_of_a_sample():
    assert language._shares([5, 100, 100], 60) == [5, 27, 28]
    assert language._shares([5, 6], 60) == [5, 6] and language._shares([], 3) == []


def test_many_languages_stay_within_the_table(monkeypatch):
    monkeypatch.setattr(language, "MOST_CELLS", 60_000)
    samples = {f"l{k:03d}": ["".join(random.Random(k).choices("abcdefghij ", k=3000))] for k in range(50)}
    model = language.fit(samples)
    assert len(model.languages) == 50 and len(model.moves) <= 2 * 60_000


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "lang string, text string")
    with pytest.raises(ValueError, match="different values"):
        language.training_sample(rows, "lang", "text")


def labelled(spark, n=600):
    rng = random.Random(4)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        parts = [" ".join(rng.choices(words, k=8)) for _ in range(5)]
        if toxic:
            parts[i % 5] += f" dreadful{chr(97 + i % 3)}"
        docs.append((i, ". ".join(parts)))
        labels.append((i, int(not toxic), int(toxic)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_fits_do_not_depend_on_the_layout(spark):
    docs, labels = labelled(spark)
    samples = [
        toxicity.training_sample(docs.repartition(k), labels.repartition(k + 1), "doc_id", "text", "toxic", rows=70)
        for k in (1, 4, 9)
    ]
    assert samples[0] == samples[1] == samples[2] and 100 < len(samples[0]) <= 140
    assert toxicity.fit(samples[0]) == toxicity.fit(samples[2])
    found = [
        sorted(tuple(r) for r in quality.resample(docs.repartition(k), labels.repartition(k + 1), rows=50).collect())
        for k in (1, 4, 9)
    ]
    assert found[0] == found[1] == found[2]


def plain_score(model, text):
    """Noisy-or, sentence by sentence."""
    import re

    clean, any_word = 1.0, False
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        known = {f for w in re.findall(r"[^\W\d_]+", sentence) for f in [w, *(w[:n] + "*" for n in (4, 5, 6) if len(w) > n)]}
        weights = [model.weights[f] for f in known if f in model.weights]
        if weights:
            any_word = True
            clean *= 1 - 1 / (1 + np.exp(-(model.bias + sum(weights))))
    return 1 - clean if any_word else 1 / (1 + np.exp(-model.bias))


def test_noisy_or_and_its_sentences(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit_on(docs, labels)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in labels.where("toxic = 1").collect()}
    for r in toxicity.score_documents(docs, model).collect():
        assert r["score"] == pytest.approx(plain_score(model, text[r["doc_id"]]), abs=1e-9)
        assert (r["predicted"] == 1) == (r["doc_id"] in toxic)
        blamed = [text[r["doc_id"]][s["begin"] : s["end"]] for s in r["offending"]]
        if r["predicted"]:
            assert len(blamed) == 1 and "dreadful" in blamed[0]
        else:
            assert not blamed


def test_gradient_of_the_noisy_or():
    """The slope that fitting uses, against finite differences of the loss."""
    rng = np.random.default_rng(1)
    for label in (0.0, 1.0):
        z = rng.normal(-1, 1, 4)

        def loss(z, label=label):
            whole = 1 - np.prod(1 - 1 / (1 + np.exp(-z)))
            return -np.log(whole) if label else -np.log(1 - whole)

        p = 1 / (1 + np.exp(-z))
        whole = 1 - np.prod(1 - p)
        want = p * (-(1 - whole) / whole if label else 1.0)
        for k in range(4):
            up = z.copy()
            up[k] += 1e-6
            assert (loss(up) - loss(z)) / 1e-6 == pytest.approx(want[k], rel=1e-3)


def test_offending_of_odd_rows(spark, odd, odd_labels, nothing):
    model = toxicity.fit_on(odd, odd_labels)
    assert len(toxicity.score_documents(odd, model).collect()) == 12
    assert toxicity.score_documents(nothing, model).collect() == []
