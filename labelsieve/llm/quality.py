"""Quality by importance resampling.

Two models of hashed word n-grams, one of target text and one of all text, give each
document the logarithm of their likelihood ratio. Adding Gumbel noise and taking the
largest sums samples documents without replacement, in proportion to that ratio.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.texts import chunks, mix, plain, salts, word_hashes
from labelsieve.session import spool

# Buckets of the hashed n-grams (words and pairs of words), and what is added to each
# bucket's count.
BUCKETS = 10_000
SMOOTHING = 1.0
# Target rows that are broadcast by id, at most; all documents count as raw text.
TARGET_ROWS = 50_000
# Share of the documents that is sampled.
SHARE = 0.5
SEED = 17
# Characters that one task counts at a time.
AT_ONCE = 2_000_000


def gram_buckets(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and pairs of words of each text, and the text they are from.

    Words are lower-case runs between white space. The order is by kind, then text.
    """
    words = [t.lower().split() for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    one = word_hashes([w for ws in words for w in ws])
    first, second = salts(2, 21)
    with np.errstate(over="ignore"):
        pair = mix(one[:-1] * first + one[1:] * second)
    within = owner[:-1] == owner[1:]
    grams = np.concatenate([mix(one ^ first), pair[within]])
    return (grams % np.uint64(buckets)).astype(np.int64), np.concatenate([owner, owner[:-1][within]])


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Logarithm of target over raw probability of each bucket, smoothed."""
    t = (target + SMOOTHING) / (target.sum() + SMOOTHING * len(target))
    r = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * len(raw))
    return np.log(t) - np.log(r)


def fit(docs: DataFrame, target_ids: DataFrame, doc_id: str, text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of each bucket: target documents against all documents.

    ``target_ids`` has the target's ids, at most ``TARGET_ROWS`` (they are broadcast).
    Counts are summed in each partition, then by bucket.
    """
    ids = F.broadcast(target_ids.select(F.col(doc_id).alias("id")).distinct().withColumn("target", F.lit(True)))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("t")).join(ids, "id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            texts = [plain(t) for t in batch["t"].to_pylist()]
            wanted = np.array([bool(x) for x in batch["target"].to_pylist()], bool)
            for part in chunks(texts, [len(t) for t in texts], AT_ONCE):
                bucket, owner = gram_buckets(texts[part], buckets)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[wanted[part][owner]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"]
        )

    counts = rows.select("t", "target").mapInArrow(count, "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return log_ratio(raw, target)


def score(docs: DataFrame, ratio: np.ndarray, doc_id: str, text: str, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``n_grams``, ``log_weight`` and ``key``, the weight with Gumbel noise.

    The noise of a row follows from its id and text, so it is the same in every run.
    """

    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [plain(t) for t in batch]
            weights, grams = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            for part in chunks(texts, [len(t) for t in texts], AT_ONCE):
                bucket, owner = gram_buckets(texts[part], len(ratio))
                n = part.stop - part.start
                weights[part] = np.bincount(owner, ratio[bucket], n)
                grams[part] = np.bincount(owner, minlength=n)
            yield pd.DataFrame({"n": grams, "w": weights})

    found = F.pandas_udf(weigh, "n long, w double")(F.col(text))
    # 52 bits of a digest, in the middle of their interval: never 0 or 1.
    digest = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id).isNull(), doc_id, text), 12)
    uniform = (digest.cast("double") + 0.5) / float(1 << 52)
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("f"), (-F.log(-F.log(uniform))).alias("noise")).select(
        "doc_id",
        F.col("f.n").alias("n_grams"),
        F.col("f.w").alias("log_weight"),
        (F.col("f.w") + F.col("noise")).alias("key"),
    )


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The ``k``-th largest value of a column without nulls, exactly.

    Each pass counts the values in equal bins and goes on inside the one that holds
    the rank, so only counts reach the driver, however many rows there are.
    """
    found = values.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    low, high, above = found["a"], found["b"], 0
    while low < high:
        inside = values.where((F.col(column) >= F.lit(low)) & (F.col(column) <= F.lit(high)))
        width = (high - low) / bins
        bin_ = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        counts = (
            inside.groupBy(bin_.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for r in counts:
            if above + r["n"] >= k:
                if (r["a"], r["b"]) == (low, high):
                    # Numbers next to each other that no bin parts.
                    return high if inside.where(F.col(column) == F.lit(high)).count() + above >= k else low
                low, high = r["a"], r["b"]
                break
            above += r["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, rows: int = TARGET_ROWS) -> DataFrame:
    """``doc_id``, ``n_grams``, ``log_weight``, ``key``, ``selected``, a row per row.

    The target are documents with quality 1, at most about ``rows`` of them, chosen by
    a hash of their id. The ``share`` of the rows with the largest keys is selected;
    rows with the same key are selected together. Null and empty texts have no
    n-grams and weight 0. Null ids and labels teach nothing. Repeated rows give
    repeated rows; other columns are not read, whatever their names. Without target
    rows the two models differ by smoothing alone.
    """
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id")
    n_good = good.count()
    near = F.lit(int((1 << 30) * min(1.0, rows / max(1, n_good))))
    # In an order of their own, so that every run takes the same rows.
    hashed = F.xxhash64("doc_id", F.lit(SEED))
    good = good.where(F.pmod(hashed, F.lit(1 << 30)) < near).orderBy(hashed, "doc_id").limit(rows)
    found = spool(score(docs, fit(docs, good, "doc_id", "text"), "doc_id", "text"))
    n = found.count()
    if not n:
        return found.withColumn("selected", F.lit(False))
    least = kth_largest(found, "key", max(1, math.ceil(share * n)))
    return found.withColumn("selected", F.col("key") >= F.lit(least))
