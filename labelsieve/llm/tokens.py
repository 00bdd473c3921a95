"""Token counts: a broadcast table of frequent lengths, worker caches for the rest.

No token leaves its row: texts are cut at white space (which no pre-token of this
tokenizer spans), each run is looked up in a small table of frequent runs, then in
a bounded cache of the worker process, and only a run that neither holds is encoded.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.texts import chunks, plain

# Rows that the frequent table is made from and their length, entries of the table,
# and characters of an entry: the sample has at most 16 million characters, the
# broadcast at most 65,536 entries of 64 characters, about 4 MB.
SAMPLE_ROWS = 1_000
SAMPLE_CHARS = 16_384
FREQUENT = 65_536
LONGEST_KEY = 64
# Entries after which a worker's own cache is emptied.
CACHE = 200_000
# Characters of the texts that are looked up together.
AT_ONCE = 1_000_000

# Fixed value: the tokenizer's pattern of pre-tokens, for normalised text.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

# Characters for which the tokenizer's normaliser is lower-casing alone.
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-¬®-įı-ɏ]")

_workers: dict[str, Lengths] = {}


class Lengths:
    """Token counts of texts with one tokenizer file, in one process."""

    def __init__(self, path: str, frequent: dict[str, int] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.frequent = frequent or {}
        self.cache: dict[str, int] = {}
        self.pre_tokens = regex.compile(PRE_TOKENS)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        longest_first = sorted(special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest_first))) if special else None

    def runs(self, text: str) -> list[str]:
        """The text's parts between white space, normalised."""
        if _UNUSUAL.search(text):
            text = self.tokenizer.normalizer.normalize_str(text)
            # What the pre-tokenizer takes for white space may differ from Python's.
            return [p for p in text.split(" ") if p]
        return text.lower().split()

    def _encode(self, tokens: list[str]) -> dict[str, int]:
        """Lengths of pre-tokens: as white space parts them, one call encodes them all."""
        if not tokens:
            return {}
        encoded = self.tokenizer.encode(" ".join(tokens), add_special_tokens=False)
        sizes = np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(tokens))
        if len(sizes) == len(tokens):
            return dict(zip(tokens, sizes.tolist()))
        alone = self.tokenizer.encode_batch(tokens, add_special_tokens=False)
        return {t: len(e) for t, e in zip(tokens, alone)}

    def _of_missing(self, runs: list[str]) -> dict[str, int]:
        """Lengths of runs that no table holds, through their pre-tokens."""
        frequent, cache = self.frequent, self.cache
        cut = {r: self.pre_tokens.findall(r) for r in runs}
        known: dict[str, int | None] = {}
        for tokens in cut.values():
            for t in tokens:
                if t not in known:
                    known[t] = frequent[t] if t in frequent else cache.get(t)
        known |= self._encode([t for t, n in known.items() if n is None])
        found = {r: sum(known[t] for t in tokens) for r, tokens in cut.items()}
        if len(cache) > CACHE:
            cache.clear()
        for new in (known, found):
            cache.update((k, n) for k, n in new.items() if len(k) <= LONGEST_KEY)
        return found

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; a special string inside a text is one token."""
        totals = [0] * len(texts)
        runs: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                parts = self.special.split(text)
                totals[i] = len(parts) - 1
                runs += [(i, self.runs(p)) for p in parts]
            else:
                runs.append((i, self.runs(text)))
        frequent, cache = self.frequent, self.cache
        lengths = {r: frequent[r] if r in frequent else cache.get(r) for r in set().union(*(rs for _, rs in runs))}
        lengths |= self._of_missing([r for r, n in lengths.items() if n is None])
        for i, rs in runs:
            totals[i] += sum(map(lengths.__getitem__, rs))
        return totals


def _worker(path: str, frequent: Broadcast | None) -> Lengths:
    key = f"{path} {frequent.value['id'] if frequent else ''}"
    if key not in _workers:
        _workers.clear()
        _workers[key] = Lengths(path, frequent.value["table"] if frequent else None)
    return _workers[key]


def frequent_lengths(
    docs: DataFrame, path: str, text: str = "text", rows: int = SAMPLE_ROWS, most: int = FREQUENT
) -> dict[str, int]:
    """Token counts of the most frequent runs and pre-tokens of a few rows.

    The sample is the first ``rows`` rows that are not over ``SAMPLE_CHARS`` long, so
    Spark reads no more than the first partitions. It only saves work: whatever the
    table lacks is encoded where it occurs.
    """
    lengths = Lengths(path)
    short = docs.select(F.col(text).alias("t")).where(F.length("t") <= F.lit(SAMPLE_CHARS))
    found: Counter[str] = Counter()
    for row in short.take(rows):
        runs = lengths.runs(row["t"])
        found.update(runs)
        found.update(t for r in runs for t in lengths.pre_tokens.findall(r) if t != r)
    top = sorted(found.items(), key=lambda item: (-item[1], item[0]))
    return lengths._of_missing([r for r, _ in top if len(r) <= LONGEST_KEY][:most])


def count_tokens(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id``, bytes, tokens and whether the tokens exceed ``limit``, a row per row.

    The counts are those of the tokenizer file at ``path`` (on every executor)
    without added special tokens; a special string inside a text counts as the
    library does by default. A null text counts as empty, an empty text has 0
    tokens, a null id stays null, repeated rows give repeated rows, and other
    columns are not read, whatever their names.
    """
    import hashlib

    table = frequent_lengths(docs, path, text)
    name = hashlib.md5(repr(sorted(table.items())).encode()).hexdigest()
    frequent = docs.sparkSession.sparkContext.broadcast({"id": name, "table": table})

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lengths = _worker(path, frequent)
        for batch in batches:
            texts = [plain(t) for t in batch]
            parts = chunks(texts, [len(t) for t in texts], AT_ONCE)
            yield pd.Series([n for part in parts for n in lengths.count(texts[part])], dtype="int64")

    tokens = F.pandas_udf(count, "long")
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.octet_length(whole).cast("long").alias("n_bytes"),
        tokens(whole).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
