"""Document fingerprints: an embedding of edit distance, sampled at fixed steps.

Every text takes the same random walk over its characters (:mod:`walks`), so edits
become differences in a few steps. The fingerprint keeps one sign for each sampled
step: all of the first 64, then 32 of each range twice as long as the one before, as
far as the walk goes. A sample stands for as many steps as it was drawn from, and the
likeness of two fingerprints is the share of steps at which they agree. Bands of
sampled signs bring similar fingerprints together; the likeness verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.buckets import bucket_links
from labelsieve.llm.graph import components
from labelsieve.llm.texts import codepoints, mix, salts
from labelsieve.llm.walks import Walks
from labelsieve.session import spool

# Steps that are all sampled, and samples of each doubling beyond.
DENSE = 64
SPARSE = 32
DOUBLINGS = 40
# Bands, and signs of a band. A pair of likeness 0.8 meets with probability 0.98.
BANDS = 24
BAND_SIGNS = 8
LIKE = 0.8
# Characters that are walked at a time.
AT_ONCE = 2_000_000

_SIGNS = np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_", np.uint8)


def _plan() -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps, ascending, and how many steps each stands for."""
    steps, weights = [np.arange(DENSE)], [np.ones(DENSE)]
    for k in range(DOUBLINGS):
        width = DENSE << k
        slot = width / SPARSE
        # One step at random in each of equal slots.
        jitter = (salts(SPARSE, 100 + k) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        steps.append((width + (np.arange(SPARSE) + jitter) * slot).astype(np.int64))
        weights.append(np.full(SPARSE, slot))
    return np.concatenate(steps), np.concatenate(weights)


STEPS, WEIGHTS = _plan()
_REACH = np.concatenate([[0.0], np.cumsum(WEIGHTS)])


def signs(codes: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
    """What the walk writes at the sampled steps, as signs."""
    if not len(codes):
        return np.zeros(0, np.uint8)
    steps = STEPS[: np.searchsorted(STEPS, end)]
    written = codes[np.searchsorted(at, steps, side="right") - 1].astype(np.uint64)
    return _SIGNS[(mix(written + np.uint64(1)) >> np.uint64(58)).astype(np.int64)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the steps at which two fingerprints agree; 1 for two empty ones."""
    both, either = min(len(a), len(b)), max(len(a), len(b))
    if not either:
        return 1.0
    return float(WEIGHTS[:both][a[:both] == b[:both]].sum() / _REACH[either])


_bands: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _band_steps(level: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs that the bands sample of a walk through ``level`` doublings, and multipliers.

    A sign is drawn as often as the steps that it stands for.
    """
    if level not in _bands:
        n = DENSE + SPARSE * level
        draws = (salts(BANDS * BAND_SIGNS, 300 + level) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        at = np.searchsorted(_REACH[1 : n + 1], draws * _REACH[n], side="right")
        _bands[level] = np.minimum(at, n - 1).reshape(BANDS, BAND_SIGNS), salts(BAND_SIGNS + 1, 400 + level)
    return _bands[level]


def band_keys(print_: np.ndarray) -> np.ndarray:
    """A key for each band, at the two lengths that a similar fingerprint may have.

    Likeness ``LIKE`` leaves walks within one doubling of each other; the keys of even
    and odd doublings have their own places, so that equal places can be compared.
    """
    level = max(0, (len(print_) - DENSE) // SPARSE)
    padded = np.zeros(DENSE + SPARSE * level, np.uint64)
    some = print_[: len(padded)]
    padded[: len(some)] = some
    keys = np.empty((2, BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for here in (level, level - 1):
            # Below the first doubling there is none; the own digest meets nothing else.
            at, salt = _band_steps(max(here, 0))
            sums = (padded[at] * salt[:-1]).sum(axis=1, dtype=np.uint64)
            if here < 0:
                sums = sums + (padded * salts(len(padded), 9)).sum(dtype=np.uint64) + np.uint64(1)
            keys[here % 2] = mix(sums + salt[-1] * np.uint64(here + 2) + np.arange(BANDS, dtype=np.uint64))
    return keys.ravel().view(np.int64)


def _prints(payload: list[str]) -> list[np.ndarray]:
    return [np.frombuffer(p.encode(), np.uint8) for p in payload]


def near_copies(prints: DataFrame, least: float = LIKE) -> DataFrame:
    """``doc_id``, ``class_id``, ``links`` of ``doc_id`` and ``fingerprint`` rows.

    Fingerprints that share a band are compared; those with a likeness of ``least``
    (``LIKE`` or more) are linked. Equal ones are one node with a weight, so copies
    cost nothing; ``links`` counts them too. A class is named by its least id. A null
    fingerprint is no copy of anything, and null ids belong to their classes.
    """

    def alike(payload: list[str]) -> tuple[np.ndarray, np.ndarray]:
        many = _prints(payload)
        pairs = [(i, j) for i in range(len(many)) for j in range(i + 1, len(many)) if likeness(many[i], many[j]) >= least]
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([band_keys(p) for p in _prints(batch.tolist())], dtype=object)

    rows = prints.select("doc_id", F.col("fingerprint").alias("id"))
    equal = rows.where(F.col("id").isNotNull()).groupBy("id")
    nodes = equal.agg(F.count(F.lit(1)).alias("weight"), F.min("doc_id").alias("least"))
    nodes = spool(nodes.withColumn("keys", F.pandas_udf(keys, "array<bigint>")("id")))
    found = spool(bucket_links(nodes, lambda ids: ids.withColumn("payload", F.col("id")), alike, block=256))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = (
        nodes.drop("keys")
        .join(found.groupBy("id").agg(F.sum("links").alias("more")), "id", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .withColumn("root", F.coalesce("root", "id"))
    )
    names = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    named = classes.join(names, "root").select(
        "id", "class_id", (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("links")
    )
    return rows.join(named, "id", "left").select(
        "doc_id",
        F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def text_prints(walks: Walks, texts: list[np.ndarray]) -> list[np.ndarray]:
    """Fingerprints of texts given as code points."""
    at, end = walks.steps(texts)
    return [signs(c, a, e) for c, a, e in zip(texts, at, end)]


def _edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by the beginning of the following one."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_BESIDE = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shared_bands int"
)


def _compare(walks: Walks, ids: list, texts: list[str]) -> list[tuple]:
    """Rows of :data:`_BESIDE` for all but the last of consecutive texts."""
    codes = [codepoints(t) for t in texts]
    at, end = walks.steps(codes)
    prints = [signs(c, a, e) for c, a, e in zip(codes, at, end)]
    # An edited text takes the same walk up to the edit and goes on from there.
    n = len(texts) - 1
    cut = [len(codes[i]) - len(codes[i]) // 4 for i in range(n)]
    tails = [codes[i + 1][: len(codes[i]) // 4] for i in range(n)]
    begin = [at[i][cut[i]] if cut[i] < len(codes[i]) else end[i] for i in range(n)]
    tail_at, tail_end = walks.steps(tails, np.array(begin, np.int64))
    rows = []
    for i in range(n):
        whole = np.concatenate([codes[i][: cut[i]], tails[i]])
        edited = signs(whole, np.concatenate([at[i][: cut[i]], tail_at[i]]), tail_end[i])
        text = _edited(texts[i], texts[i + 1]).encode("utf-8", "surrogatepass")
        rows.append(
            (
                ids[i],
                len(codes[i]),
                hashlib.sha256(text).hexdigest(),
                prints[i].tobytes().decode(),
                edited.tobytes().decode(),
                likeness(prints[i], edited),
                likeness(prints[i], prints[i + 1]),
                int((band_keys(prints[i]) == band_keys(edited)).sum()),
            )
        )
    return rows


def fingerprint_beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness and shared bands.

    The edited text has the last floor(n / 4) code points replaced by the first as
    many (or all) of the next document's, in ascending order of the id; the first
    follows the last. A null text counts as empty and a null id comes first (and
    stays null); rows with the same id follow each other in the order of their
    texts. Every row gives one row. A document alone follows itself. Other columns
    are not read, whatever their names.

    The texts are shuffled once, into ranges of ids; each range also gets the first
    row of the next one.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(doc_id).cast("long").alias("id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)]
    bounds = rows.select("key").agg(
        F.min("key").alias("least"),
        F.percentile_approx("key", F.array(*[F.lit(s) for s in shares or [0.5]]), 100 * parts).alias("cuts"),
    ).first()
    cuts = np.unique(np.array([c for c in bounds["cuts"] or [] if c > bounds["least"]], np.int64))
    last = len(cuts)
    least = bounds["least"]

    @F.pandas_udf("array<int>")
    def ranges(keys: pd.Series) -> pd.Series:
        # A cut is the id of some row, so the first row of a range is known by it.
        at = np.searchsorted(cuts, keys.to_numpy(), side="right")
        first = np.isin(keys, cuts)
        return pd.Series(
            [
                [a, *([a - 1] if f else []), *([last] if k == least and last else [])]
                for a, f, k in zip(at.tolist(), first, keys)
            ]
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walks = Walks()
        ids: list = []
        texts: list[str] = []
        first: tuple | None = None
        size = 0
        schema = pa.schema(
            [
                ("doc_id", pa.int64()),
                ("n_chars", pa.int64()),
                ("edited_sha256", pa.string()),
                ("fingerprint", pa.string()),
                ("edited_fingerprint", pa.string()),
                ("near_edited", pa.float64()),
                ("near_next", pa.float64()),
                ("shared_bands", pa.int32()),
            ]
        )

        def done(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        follows: tuple | None = None
        for batch in batches:
            for own, i, t in zip(batch["own"].to_pylist(), batch["id"].to_pylist(), batch["t"].to_pylist()):
                if not own:
                    # The first row of the next range; of equal ids the first text.
                    follows = follows or (i, t)
                    continue
                first = first or (i, t)
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size > AT_ONCE:
                    yield done(_compare(walks, ids, texts))
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if texts:
            i, t = follows or first
            yield done(_compare(walks, [*ids, i], [*texts, t]))

    ordered = (
        rows.select("*", F.posexplode(ranges("key")).alias("pos", "range"))
        .withColumn("own", F.col("pos") == 0)
        .repartitionById(last + 1, "range")
        .sortWithinPartitions(F.desc("own"), "key", "t")
    )
    return ordered.select("own", "id", "t").mapInArrow(compare, _BESIDE)
