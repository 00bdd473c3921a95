"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text is built. A text is cut from
left to right into the longest phrases that occur in that labelled text; the language
that needs the fewest phrases, each charged the logarithm of its training length,
wins. Symbols are the bytes of lower-case letters in UTF-8, so letters of every script
have symbols of their own, however many there are. All automata share one table of
transitions, and the texts of a block are parsed side by side.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelsieve.llm.folds import held_out
from labelsieve.llm.texts import blocks, chunks, codepoints, plain, still_running

# What a model is fitted on, at most: distinct texts of each language, characters of one
# (a piece of a longer text), and symbols of each language.
TRAIN_ROWS = 100
TRAIN_CHARS = 2_000
TRAIN_SYMBOLS = 24_000
# Cells of the table of all automata, of 4 bytes: with many languages each has fewer
# symbols. An automaton has at most two states a symbol, each a row of as many cells as
# the language has distinct symbols, and one.
MOST_CELLS = 50_000_000
# More distinct languages than this are taken for an error in the data.
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
# Characters that one task parses at a time.
AT_ONCE = 2_000_000

_GAP = 32
_letters: np.ndarray | None = None


def symbols(text: str) -> np.ndarray:
    """The bytes of the text's lower-case letters, a gap between words and none at the ends."""
    global _letters
    if _letters is None:
        _letters = np.array([not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x10000)])
    codes = codepoints(text.lower()).copy()
    inside = _letters.take(codes, mode="clip") & (codes < 0x10000)
    for i in np.flatnonzero(codes > 0xFFFF):
        inside[i] = chr(codes[i]).isalpha()
    if not inside.any():
        return np.zeros(0, np.uint8)
    codes[~inside] = _GAP
    # Gaps are one symbol however long.
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    found = np.frombuffer(codes[keep].astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    return found[:-1] if found[-1] == _GAP else found


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    length, link = [0], [-1]
    last = 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return moves


@dataclass(frozen=True)
class LanguageModel:
    """Languages, the cells of their symbols, and the moves of all automata.

    ``cells[language, symbol]`` is the place of a symbol in each row of that language; 0
    is any symbol that its training text lacks. ``moves[row of a state + cell]`` is twice
    the row of the next state, plus 1 where the phrase ended before the symbol and the
    next one starts with it.
    """

    languages: list[str]
    cells: np.ndarray
    moves: np.ndarray
    roots: np.ndarray
    charge: np.ndarray


def _shares(sizes: list[int], most: int) -> list[int]:
    """How much of each is taken, evenly, so that all together are ``most`` at most."""
    taken = [0] * len(sizes)
    for left, i in zip(range(len(sizes), 0, -1), sorted(range(len(sizes)), key=lambda i: sizes[i])):
        taken[i] = min(sizes[i], most // left)
        most -= taken[i]
    return taken


def fit(samples: dict[str, list[str]]) -> LanguageModel:
    """Automata of a bounded sample of texts for each language; every text has an even share."""
    languages = sorted(samples)
    tables, roots, charge, base = [], [], [], 0
    cells = np.zeros((len(languages), 256), np.int32)
    for k, language in enumerate(languages):
        parts = [np.append(symbols(t), np.uint8(_GAP)) for t in samples[language]]
        known = np.unique(np.concatenate([np.zeros(0, np.uint8), *parts]))
        width = len(known) + 1
        most = min(TRAIN_SYMBOLS, MOST_CELLS // (len(languages) * 2 * width))
        text = np.concatenate([np.zeros(0, np.uint8), *(p[:n] for p, n in zip(parts, _shares([len(p) for p in parts], most)))])
        cells[k, known] = np.arange(1, width)
        states = automaton(cells[k, text].tolist())
        # One more state: a phrase that is one symbol this language lacks.
        lacking = len(states)
        table = np.full((lacking + 1, width), -1, np.int64)
        for i, moves in enumerate(states):
            for c, to in moves.items():
                table[i, c] = to
        start = np.where(table[0] < 0, lacking, table[0])
        ended = table < 0
        table = np.where(ended, start, table)
        ended[0] = False  # before the first symbol there is no phrase to end
        tables.append(((table * width + base) * 2 + ended).astype(np.int32).ravel())
        roots.append(base)
        base += table.size
        charge.append(math.log2(max(2, len(text))))
    return LanguageModel(
        languages,
        cells,
        np.concatenate(tables) if tables else np.zeros(0, np.int32),
        np.array(roots, np.int32),
        np.array(charge),
    )


def phrases(model: LanguageModel, texts: list[np.ndarray]) -> np.ndarray:
    """Phrases that each language (column) needs for each text (row) of symbols."""
    counts = np.zeros((len(texts), len(model.languages)), np.int64)
    for block in blocks([len(t) for t in texts]):
        lengths = np.array([len(texts[i]) for i in block], np.int64)
        flat = np.concatenate([texts[i] for i in block]).astype(np.intp) if len(block) else np.zeros(0, np.intp)
        starts = np.cumsum(lengths) - lengths
        state = np.repeat(model.roots[:, None], len(block), axis=1)
        ended = np.zeros(state.shape, np.int32)
        for i, running in enumerate(still_running(lengths)):
            cell = model.cells.take(flat.take(starts[:running] + i), axis=1)
            to = model.moves.take(state[:, :running] + cell)
            ended[:, :running] += to & 1
            state[:, :running] = to >> 1
        # The last phrase ends with the text.
        counts[block] = (ended + (lengths > 0)).T
    return counts


def identify(model: LanguageModel, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score in [0, 1] and the winner's phrases a symbol, for each text."""
    best = [UNKNOWN] * len(texts)
    score, rate = np.zeros(len(texts)), np.ones(len(texts))
    if not model.languages:
        return best, score, rate
    for part in chunks(texts, [len(t) for t in texts], AT_ONCE):
        parsed = [symbols(t) for t in texts[part]]
        size = np.maximum([len(s) for s in parsed], 1)
        found = phrases(model, parsed) / size[:, None]
        bits = found * model.charge
        winner = bits.argmin(axis=1)
        away = (bits - bits.min(axis=1, keepdims=True)) * np.sqrt(size)[:, None]
        sure = 1.0 / np.exp(-np.minimum(away, 700.0)).sum(axis=1)
        for k, i in enumerate(range(part.start, part.start + len(parsed))):
            if len(parsed[k]):
                best[i] = model.languages[winner[k]]
                score[i], rate[i] = sure[k], found[k, winner[k]]
    return best, score, rate


def language(model: LanguageModel, text: Column) -> Column:
    """Struct of ``lang``, ``score`` and ``rate`` (phrases a symbol).

    A null text and one without a letter are ``und``, with score 0 and rate 1, as is
    every text under a model without languages. Equal costs go to the first language
    in alphabetical order.
    """
    shared = SparkSession.active().sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            best, score, rate = identify(shared.value, [plain(t) for t in batch])
            yield pd.DataFrame({"lang": best, "score": score, "rate": rate})

    return F.pandas_udf(predict, "lang string, score double, rate double")(text)


def training_sample(docs: DataFrame, lang: str, text: str, rows: int = TRAIN_ROWS) -> dict[str, list[str]]:
    """The ``rows`` distinct texts of each language that a hash puts first.

    Copies count once. Of a text over ``TRAIN_CHARS`` characters a piece is taken, from a
    place that its hash says; no text is left out for its length. Null languages and
    texts are. Texts without a letter are chosen only where a language has no other.
    """
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("t")).where(
        F.col("lang").isNotNull() & F.col("t").isNotNull()
    )
    hashed = known.select("lang", "t", F.xxhash64("t", F.lit(3)).alias("h"))
    # Distinct texts, about: it only says how many need be looked at.
    most = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.03).alias("n"))
    counts = {r["lang"]: r["n"] for r in most.limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"column {lang!r} has over {MOST_LANGUAGES} different values")
    if not counts:
        return {}
    shares = docs.sparkSession.createDataFrame(
        [(name, int((1 << 30) * min(1.0, 3.0 * rows / max(1, n)))) for name, n in counts.items()], "lang string, near long"
    )
    begin = F.lit(1) + F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("t") - F.lit(TRAIN_CHARS - 1)))
    near = (
        hashed.join(F.broadcast(shares), "lang")
        .where(F.pmod("h", F.lit(1 << 30)) < F.col("near"))
        .select("lang", "h", F.substring(F.col("t"), begin.cast("int"), F.lit(TRAIN_CHARS)).alias("t"))
        .dropDuplicates(["lang", "h"])
    )
    order = Window.partitionBy("lang").orderBy(~F.col("t").rlike(r"\p{L}"), F.pmod("h", F.lit(1 << 30)), "h")
    found: dict[str, list[str]] = {name: [] for name in counts}
    for row in near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= rows).orderBy("lang", "k").collect():
        found[row["lang"]].append(row["t"])
    return found


def fit_on(docs: DataFrame) -> LanguageModel:
    """Fit on rows outside the test fold (crc32 of the id, 3 folds, fold 1)."""
    return fit(training_sample(docs.where(~held_out("doc_id", 3, 1)), "lang", "text"))


def predict_documents(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """A row per row: ``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``phrase_rate``.

    A null id is held out. Repeated rows give repeated rows; other columns are not
    read, whatever their names.
    """
    found = docs.select(
        F.col("doc_id").alias("doc_id"),
        held_out("doc_id", 3, 1).alias("held_out"),
        language(model, F.col("text")).alias("found"),
    )
    return found.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.rate").alias("phrase_rate"),
    )
