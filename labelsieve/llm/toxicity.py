"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from a logistic
model over its words and word beginnings, and the document's is the noisy-or of
them: 1 minus the product of the sentences' complements. Only documents carry
labels; training goes through the noisy-or, so it finds out which sentences
are to blame, and these can be reported.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.folds import held_out
from labelsieve.llm.texts import plain

# Labelled rows of each class that a model is fitted on, at most, and the characters
# of a fitting text: the sample has at most 32 million characters.
TRAIN_ROWS = 2_000
TRAIN_CHARS = 8_000
# A feature is kept when it is in so many training documents; the model has at most
# so many features, which bounds what is broadcast.
LEAST_DOCS = 5
MOST_FEATURES = 100_000
# Documents' worth of evidence that a feature must have to count at all.
SHRINK = 2.0
# Probability of a sentence that nothing speaks against.
LEAK = 1e-4

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")
# Lengths of word beginnings that are features beside the word.
_BEGINNINGS = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of words and of word beginnings (with a trailing ``*``)."""

    weights: dict[str, float]
    bias: float


def sentences(text: str) -> list[tuple[int, int]]:
    """Begin and end of each sentence that has a letter."""
    return [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(m.group())]


def _features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in _BEGINNINGS if len(word) > n)]


class Scorer:
    """Sentence and document scores of one process; silent words are remembered."""

    def __init__(self, model: ToxicityModel, remember: int = 200_000):
        self.model, self.remember = model, remember
        self.silent: dict[str, bool] = {}
        # A text that nothing speaks for or against scores like one such sentence.
        self.empty = float(1.0 / (1.0 + np.exp(-model.bias)))

    def _says_nothing(self, run: str) -> bool:
        """Whether no word in a run between white space has a weight."""
        found = self.silent.get(run)
        if found is None:
            weights = self.model.weights
            found = not any(f in weights for w in _WORD.findall(run) for f in _features(w))
            if len(self.silent) > self.remember:
                self.silent.clear()
            self.silent[run] = found
        return found

    def logits(self, parts: list[str]) -> np.ndarray:
        """Of lower-case sentences: the bias and the weight of each distinct feature."""
        weights, bias = self.model.weights, self.model.bias
        z = []
        for part in parts:
            found = {f for w in _WORD.findall(part) for f in _features(w)}
            z.append(bias + sum(sorted(weights[f] for f in found if f in weights)))
        return np.array(z)

    def text(self, text: str) -> float:
        """Noisy-or over the sentences with a known word, 0 to 1; else the bias alone."""
        text = text.lower()
        if all(map(self._says_nothing, set(text.split()))):
            return self.empty
        z = self.logits(_SENTENCE.findall(text))
        # The log of the product of all 1 - p.
        return float(-np.expm1(-np.logaddexp(0.0, z[z != self.model.bias]).sum()))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Begin, end and probability of the sentences to blame."""
        at = sentences(text)
        z = self.logits([text[a:b].lower() for a, b in at])
        p = 1.0 / (1.0 + np.exp(-z))
        return [(a, b, float(s)) for (a, b), s in zip(at, p) if s >= least]


def training_sample(
    docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int = TRAIN_ROWS
) -> list[tuple[str, float]]:
    """Texts and labels of about ``rows`` labelled rows of each class, at most.

    Rows are chosen by a hash of their id. Null ids, labels and texts are left out, as
    are texts over ``TRAIN_CHARS`` characters; scoring reads every text whole.
    """
    known = labels.select(F.col(doc_id).alias("id"), (F.col(label) > 0).cast("double").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isNotNull())
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    chosen = None
    for y, n in sorted(counts.items()):
        share = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, rows / n)))
        # In an order of their own, so that every run takes the same rows.
        part = known.where((F.col("y") == y) & share).orderBy(F.xxhash64("id", F.lit(7)), "id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return []
    # At most 2 * rows ids and labels are broadcast.
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t"))
    texts = texts.where(F.col("t").isNotNull() & (F.length("t") <= F.lit(TRAIN_CHARS)))
    found = texts.join(F.broadcast(chosen), "id").collect()
    return sorted((r["t"], r["y"]) for r in found)


def fit(sample: list[tuple[str, float]], steps: int = 50) -> ToxicityModel:
    """Fit by gradient steps through the noisy-or, on a bounded sample.

    Without any row, or with one label alone, the model is its bias.
    """
    labels = np.array([y for _, y in sample], np.float64)
    bias = float(np.log(LEAK))
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel({}, -bias if len(labels) and labels.max() > 0 else bias)

    # One entry for each feature of a sentence; a sentence knows its document.
    place: dict[str, int] = {}
    feature, sentence, document = array("i"), array("i"), array("i")
    in_docs: Counter[int] = Counter()
    for d, (text, _) in enumerate(sample):
        seen: set[int] = set()
        for part in _SENTENCE.findall(text.lower()):
            words = set(_WORD.findall(part))
            found = {place.setdefault(f, len(place)) for w in words for f in _features(w)}
            feature.extend(found)
            sentence.extend([len(document)] * len(found))
            document.append(d)
            seen |= found
        in_docs.update(seen)
    names = list(place)
    often = sorted((i for i, n in in_docs.items() if n >= LEAST_DOCS), key=lambda i: (-in_docs[i], names[i]))
    often = often[:MOST_FEATURES]
    number = np.full(len(names), -1, np.int64)
    number[often] = np.arange(len(often))
    feature, sentence = number[np.frombuffer(feature, np.int32)], np.frombuffer(sentence, np.int32)
    kept = feature >= 0
    feature, sentence, document = feature[kept], sentence[kept], np.frombuffer(document, np.int32)
    n_docs, n_sentences = len(labels), len(document)

    toxic = labels > 0
    balance = np.where(toxic, 0.5 / toxic.mean(), 0.5 / (1 - toxic.mean()))

    def descend(feature, sentence, weights, steps, shrink):
        squares = np.full(len(weights), 1e-8)
        for _ in range(steps):
            z = bias + np.bincount(sentence, weights[feature], n_sentences)
            p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
            clean = np.bincount(document, np.log1p(-np.minimum(p, 1 - 1e-9)), n_docs)
            whole = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
            # Slope of the loss by a sentence's logit: p if the label is 0, else -p (1 - P) / P.
            pull = np.where(toxic, -(1 - whole) / whole, 1.0) * balance
            slope = np.bincount(feature, (p * pull[document])[sentence], len(weights)) / n_docs
            squares += slope**2
            rate = 0.5 / np.sqrt(squares)
            weights = weights - rate * slope
            weights = np.sign(weights) * np.maximum(np.abs(weights) - rate * shrink / n_docs, 0.0)
        return weights

    weights = descend(feature, sentence, np.zeros(len(often)), steps, SHRINK)
    # Features that have earned a weight are fitted again without the handicap.
    strong = np.flatnonzero(weights)
    at = np.searchsorted(strong, feature)
    kept = (at < len(strong)) & (strong[np.minimum(at, max(len(strong) - 1, 0))] == feature) if len(strong) else feature < 0
    weights = descend(at[kept], sentence[kept], weights[strong], 2 * steps, 0.05)
    return ToxicityModel({names[often[i]]: float(w) for i, w in zip(strong, weights) if w}, bias)


def toxicity(model: ToxicityModel, text: Column) -> Column:
    """Document score in [0, 1]; null and empty texts get the model's bias."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.Series([scorer.text(plain(t)) for t in batch], dtype="float64")

    return F.pandas_udf(score, "double")(text)


def judged(model: ToxicityModel, text: Column, least: float = 0.5) -> Column:
    """Struct of ``score`` and ``offending``: begin and end (code points) and probability of the
    sentences to blame, which only a text that scores ``least`` can have."""

    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            texts = [plain(t) for t in batch]
            scores = [scorer.text(t) for t in texts]
            spans = [scorer.spans(t, least) if s >= least else [] for t, s in zip(texts, scores)]
            yield pd.DataFrame({"score": scores, "offending": pd.Series(spans, dtype=object)})

    kind = "score double, offending array<struct<begin: int, end: int, p: double>>"
    return F.pandas_udf(judge, kind)(text)


def offending(model: ToxicityModel, text: Column, least: float = 0.5) -> Column:
    """The sentences to blame: array of begin, end (code points) and probability."""
    return judged(model, text, least)["offending"]


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Fit on labelled rows outside the test fold (crc32 of the id, 5 folds, fold 0)."""
    learnt = labels.where(~held_out("doc_id", 5, 0))
    return fit(training_sample(docs, learnt, "doc_id", "text", label))


def score_documents(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """A row per row: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``offending``.

    ``offending`` has the sentences to blame, from 0.5 on; texts under 0.5 have none.
    Null and empty texts get the model's bias. A null id is held out. Repeated rows
    give repeated rows; other columns are not read, whatever their names.
    """
    scored = docs.select(
        F.col("doc_id").alias("doc_id"),
        held_out("doc_id", 5, 0).alias("held_out"),
        judged(model, F.col("text")).alias("j"),
    ).select("doc_id", "held_out", F.col("j.score").alias("score"), F.col("j.offending").alias("offending"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
