"""Similarity join of documents: word n-grams, MinHash bands, full verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.buckets import Alike, bucket_links
from labelsieve.llm.graph import components
from labelsieve.llm.texts import chunks, mix, plain, salts, shingle_hashes, word_hashes
from labelsieve.session import spool

SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.995
# Minima of a band: more make fewer chance meetings, but more bands are needed.
ROWS = 4
# Characters that one task sketches at a time.
AT_ONCE = 2_000_000
# Shingles in so many texts of a task are counted as a matrix product.
COMMON = 24


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` minima so that a pair as similar meets with chance ``recall``."""
    if not (0.0 < similarity <= 1.0 and 0.0 < recall < 1.0):
        raise ValueError("similarity must be in (0, 1], recall in (0, 1)")
    miss = 1.0 - similarity**rows
    return 1 if miss <= 0.0 else max(1, math.ceil(math.log(1.0 - recall) / math.log(miss)))


def _shingles(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lower-case words between white space, and where each text begins."""
    words = [t.lower().split() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    return shingle_hashes(word_hashes([w for ws in words for w in ws]), starts, n)


def shingle_sets(texts: list[str], n: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    hashes, begins = _shingles(texts, n)
    return [np.unique(hashes[begins[i] : begins[i + 1]]) for i in range(len(texts))]


def alike(similarity: float = SIMILARITY, n: int = SHINGLE) -> Alike:
    """All pairs of texts whose shingle sets have the Jaccard similarity, exactly."""

    def pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sets = shingle_sets(texts, n)
        sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, name = np.unique(np.concatenate(sets) if sets else [], return_inverse=True)
        order = np.argsort(name, kind="stable")
        owner, name = owner[order], name[order]
        spread = np.bincount(name)[name] if len(name) else name
        both = np.zeros((len(sets), len(sets)), np.float32)
        # Common shingles: columns of a 0/1 matrix times its transpose, some at a time.
        common = spread >= COMMON
        columns = np.unique(name[common], return_inverse=True)[1]
        for start in range(0, int(columns.max()) + 1 if len(columns) else 0, 2048):
            here = (columns >= start) & (columns < start + 2048)
            some = np.zeros((len(sets), 2048), np.float32)
            some[owner[common][here], columns[here] - start] = 1.0
            both += some @ some.T
        # The others: every pair of owners of the same shingle.
        for apart in range(1, COMMON - 1):
            a, b = owner[:-apart], owner[apart:]
            match = (name[:-apart] == name[apart:]) & ~common[apart:]
            if not match.any():
                break
            np.add.at(both, (a[match], b[match]), 1.0)
            np.add.at(both, (b[match], a[match]), 1.0)
        a, b = np.nonzero(np.triu(both, 1))
        shared = both[a, b].astype(np.int64)
        linked = shared >= similarity * (sizes[a] + sizes[b] - shared) - 1e-9
        return a[linked], b[linked]

    return pairs


def _sketch_batch(texts: list[str], n: int, bands: int, rows: int) -> tuple[list, list]:
    """Set digest and band keys of each text; null for a text without words."""
    hashes, begins = _shingles(texts, n)
    sizes = np.diff(begins)
    full = np.flatnonzero(sizes)
    digests: list[bytes | None] = [None] * len(texts)
    keys: list[np.ndarray | None] = [None] * len(texts)
    if not len(full):
        return digests, keys
    at = begins[:-1][full]
    with np.errstate(over="ignore"):
        found = np.zeros((len(full), bands), np.uint64)
        for k, salt in enumerate(salts(bands * rows, 11)):
            least = np.minimum.reduceat(hashes * salt, at)
            found[:, k // rows] = mix(found[:, k // rows] + least)
        one, two = salts(2, 12)
        for i, row in zip(full, found):
            own = np.unique(hashes[begins[i] : begins[i + 1]])
            sums = (mix(own ^ one).sum(dtype=np.uint64), mix(own ^ two).sum(dtype=np.uint64))
            digests[i] = sums[0].tobytes() + sums[1].tobytes()
            keys[i] = row.view(np.int64)
    return digests, keys


def sketch(
    docs: DataFrame, text: str, carry: list[Column], n: int = SHINGLE, bands: int = 10, rows: int = ROWS
) -> DataFrame:
    """Columns ``carry``, then ``set_id`` (a digest of the shingle set) and band ``keys``."""
    given = docs.select(*carry, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = given.columns[:-1]
    kept = given.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [plain(t) for t in batch["_text"].to_pylist()]
            digests: list = []
            keys: list = []
            for part in chunks(texts, [len(t) for t in texts], AT_ONCE):
                d, k = _sketch_batch(texts[part], n, bands, rows)
                digests += d
                keys += k
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in names), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=[*names, "set_id", "keys"],
            )

    found = [T.StructField("set_id", T.BinaryType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    return given.mapInArrow(run, T.StructType([*kept, *found]))


def _with_nulls(names: list[str]) -> list[Column]:
    """Columns for a digest in which a null is unlike any value."""
    return [c for n in names for c in (F.col(f"`{n}`").isNull(), F.col(f"`{n}`"))]


def _mark(carry: list[Column], text: str, seed: int) -> Column:
    """A digest that finds a row again."""
    cells = [c for k in (*carry, F.col(text)) for c in (k.isNull(), k)]
    return F.xxhash64(F.lit(seed), *cells)


def _fresh(names: list[str]) -> tuple[str, str]:
    """Two column names that are not taken."""
    stem = "_row"
    while any(n.lower().startswith(stem) for n in names):
        stem += "_"
    return f"{stem}1", f"{stem}2"


def near_classes(
    docs: DataFrame,
    carry: list[Column],
    least: list[str],
    text: str = "text",
    similarity: float = SIMILARITY,
    n: int = SHINGLE,
    recall: float = RECALL,
) -> DataFrame:
    """``carry`` of every row, with ``links`` and the ``least`` columns of its class.

    Two texts are linked if the sets of their ``n``-word shingles (lower-case words
    between white space; a shorter text has one shingle of all its words) have a
    Jaccard similarity of ``similarity`` or more; a class is what links connect.
    ``links`` counts the other rows that a row is linked with, copies included.
    ``class`` is a struct of the ``least`` columns of the class, the smallest of them.

    Bands are set so that a pair at the threshold meets with chance ``recall``; every
    pair that meets is verified on the full sets. Rows with equal sets are one node
    with a weight, so copies cost nothing. Texts without words (null, empty) are
    linked with nothing, and each is its own class.
    """
    bands = bands_for(similarity, recall, ROWS)
    marks = [_mark(carry, text, seed).alias(f"_mark{seed}") for seed in (1, 2)]
    rows = spool(sketch(docs, text, [*carry, *marks], n, bands))
    given = rows.columns[:-4]
    own = F.struct(*least)
    nodes = spool(
        rows.where(F.col("set_id").isNotNull())
        .groupBy(F.col("set_id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("weight"),
            F.min(own).alias("least"),
            F.min(F.struct("_mark1", "_mark2")).alias("from"),
            F.first("keys").alias("keys"),
        )
    )

    def texts(ids: DataFrame) -> DataFrame:
        """One text of each set, read again from the row that its marks point at."""
        wanted = ids.join(nodes.select("id", "from.*"), "id")
        return docs.select(*marks, F.col(text).alias("payload")).join(wanted, ["_mark1", "_mark2"]).select("id", "payload")

    found = spool(bucket_links(nodes, texts, alike(similarity, n)))
    linked = found.groupBy("id").agg(F.sum("links").alias("more"))
    roots = components(found.select(F.col("id").alias("a"), F.col("other").alias("b")))
    classes = (
        nodes.select("id", "weight", "least")
        .join(linked, "id", "left")
        .join(roots.select(F.col("node").alias("id"), "root"), "id", "left")
        .where((F.col("weight") > 1) | F.col("root").isNotNull())
        .withColumn("root", F.coalesce("root", "id"))
    )
    smallest = classes.groupBy("root").agg(F.min("least").alias("class"))
    joined = classes.join(smallest, "root").select(
        F.col("id").alias("set_id"),
        "class",
        (F.col("weight") - 1 + F.coalesce("more", F.lit(0))).alias("links"),
    )
    return rows.join(joined, "set_id", "left").select(
        *given, F.coalesce("links", F.lit(0)).cast("long").alias("links"), F.coalesce("class", own).alias("class")
    )


def join_documents(docs: DataFrame) -> DataFrame:
    """A row per row: ``doc_id``, ``class_id`` (the least id of its class), ``links``.

    Five words, similarity 0.8; see :func:`near_classes`. A null id belongs to its
    class like any other, but ``class_id`` is null only if the class has no other id.
    """
    # Ids that are not null come first in the order that the least is taken from.
    carry = [F.col("doc_id").alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]
    found = near_classes(docs, carry, ["no_id", "doc_id"])
    return found.select("doc_id", F.col("class.doc_id").alias("class_id"), "links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that another row of their class stands for.

    The row with the least id of a class stays (of equal ids the one with the least
    digest, and one of rows that are equal in all columns); null ids come last. Rows
    without words are their own classes and stay.
    """
    names = docs.columns
    same = [F.xxhash64(F.lit(seed), *_with_nulls(names)) for seed in (1, 2)]
    tagged = docs.select("*", *[c.alias(n) for c, n in zip(same, _fresh(names))])
    one, two = _fresh(names)
    carry = [F.col(f"`{c}`").alias(a) for c, a in ((one, "one"), (two, "two"))]
    carry += [F.col("doc_id").alias("doc_id"), F.col("doc_id").isNull().alias("no_id")]
    order = ["no_id", "doc_id", "one", "two"]
    stays = near_classes(tagged, carry, order).where(F.col("class") == F.struct(*order)).select(
        F.col("one").alias(one), F.col("two").alias(two)
    ).distinct()
    return tagged.join(stays, [one, two], "left_semi").dropDuplicates([one, two]).select(*[f"`{c}`" for c in names])
