"""Links between rows that share a bucket, without a row for each pair.

Rows come with one key for each band; rows with the same key in the same band share a
bucket. Every pair of a bucket is compared inside a task, on whole payloads, and only
sums leave it: what each row is linked with, and links enough to connect it. A pair
that shares several buckets is counted in the first of them. A large bucket is cut
into blocks, and each pair of blocks is a task's work, so no task holds more than two
blocks, however many rows share a key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.session import spool

BLOCK = 1024

# For payloads: the pairs (first, second) that are alike.
Alike = Callable[[list], tuple[np.ndarray, np.ndarray]]


def _first_shared(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (keys[a] == keys[b]).argmax(axis=1)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` rows, the first row that the pairs connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _work(alike: Alike) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pairs_of_blocks(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True).drop_duplicates("id", ignore_index=True)
        a, b = alike(rows["payload"].tolist())
        side = rows["block"].to_numpy()
        if rows["i"].iat[0] != rows["j"].iat[0]:
            across = side[a] != side[b]
            a, b = a[across], b[across]
        keys = np.array(rows["keys"].tolist(), np.int64)
        here = _first_shared(keys, a, b) == rows["band"].iat[0]
        a, b = a[here], b[here]
        weight = rows["weight"].to_numpy(np.float64)
        n = len(rows)
        links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        found = np.flatnonzero(links)
        return pd.DataFrame(
            {
                "id": rows["id"].to_numpy()[found],
                "links": links[found].astype(np.int64),
                "other": rows["id"].to_numpy()[_spanning(n, a, b)[found]],
            }
        )

    return pairs_of_blocks


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``id``, ``weight``, ``keys``, ``band``, ``key``, ``n`` of rows in buckets of two or more.

    A bucket whose rows also share one earlier bucket has no pair of its own and is
    left out. Only band, key and id are shuffled for all rows; the rest follows for
    those that share a bucket.
    """
    single = rows.select("id", F.posexplode("keys").alias("band", "key"))
    sizes = single.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = single.join(sizes, ["band", "key"])
    members = spool(shared.join(rows.select("id", "weight", "keys"), "id"))
    bands = rows.agg(F.max(F.size("keys")).alias("n")).first()["n"] or 0
    together = F.lit(False)
    for k in range(bands):
        same = F.min(F.col("keys")[k]) == F.max(F.col("keys")[k])
        together = together | ((F.lit(k) < F.min("band")) & same)
    own = members.groupBy("band", "key").agg(together.alias("again")).where("not again").drop("again")
    return spool(members.join(own, ["band", "key"]))


def bucket_links(
    rows: DataFrame, payloads: Callable[[DataFrame], DataFrame], alike: Alike, block: int = BLOCK
) -> DataFrame:
    """Links of ``rows`` (``id``, ``weight``, ``keys`` an array of longs, one a band).

    ``payloads`` gives ``id`` and ``payload`` for a frame of distinct ids. Returns
    ``id``, ``links`` (the weights of what it is linked with) and ``other``, a row it
    is connected with; an id may come several times, once for each task that found
    links of it.
    """
    members = shared_buckets(rows)
    placed = (
        members.join(payloads(members.select("id").distinct()), "id")
        .withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "with"))
        .withColumn("j", F.greatest("block", "with"))
        .select("id", "weight", "keys", "band", "key", "block", "i", "j", "payload")
    )
    kind = dict(rows.dtypes)["id"]
    return placed.groupBy("band", "key", "i", "j").applyInPandas(
        _work(alike), f"id {kind}, links long, other {kind}"
    )
