"""Ranked lexical search: item bundles that travel through the owners of their terms.

Documents are indexed in blocks of consecutive rows; a block keeps, for each term, the
rows that hold it and how often. The terms are parted among a few stages by how frequent
they are, rare terms first. A bundle holds the accumulators of a group of items over one
block: the documents that have a score so far, and the score. In every stage bundles and
postings of the stage's terms meet in a cogroup by block and group; the stage adds its
integer contributions and sends the bundle on. A document goes out of a bundle only when
all that the later stages can still add leaves it below ten others, so no rank changes.
After the last stage each bundle names its best, and the best of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelsieve.session import spool

TOP = 10
# A stage owns the terms that at most so large a share of the documents holds; the last
# one owns the rest.
STAGES = (1 / 1024, 1 / 32, 1 / 4, 1.0)
# Documents and bytes of a block, and items of a group on average.
BLOCK_DOCS = 8_192
BLOCK_BYTES = 16_000_000
GROUP_ITEMS = 256
# Item terms that go to every task, and their bytes; with more of them the index holds
# every term, and meets the items' terms in a join instead.
BROADCAST_TERMS = 1_000_000
BROADCAST_BYTES = 32_000_000

# Bytes that part terms, and lower case for A to Z alone. All of them are
# below 128, so whole characters beyond stay whole.
_GAPS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in _GAPS else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

_INDEX = (
    "block long, term binary, rows binary, counts binary, "
    "ids binary, null_ids binary, sizes binary, n_docs long, n_terms long"
)
_BUNDLE = (
    "block long, grp long, ids binary, null_ids binary, sizes binary, "
    "items array<long>, rows array<binary>, scores array<binary>"
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order."""
    return text.translate(_TABLE).split()


def _counted(numbers: list[int]) -> bytes:
    most = max(numbers)
    return np.array(numbers, np.uint8 if most < 256 else np.int64).tobytes()


class _Block:
    """Postings of consecutive documents."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.bytes = 0
        self.rows: dict[bytes, list[int]] = {}
        self.counts: dict[bytes, list[int]] = {}

    def add(self, doc_id: int | None, text: bytes, wanted: frozenset[bytes] | None) -> None:
        terms = terms_of(text)
        at = len(self.ids)
        self.ids.append(doc_id)
        self.sizes.append(len(terms))
        self.bytes += len(text)
        counts: dict[bytes, int] = {}
        for t in terms if wanted is None else filter(wanted.__contains__, terms):
            counts[t] = counts.get(t, 0) + 1
        for t, n in counts.items():
            if t in self.rows:
                self.rows[t].append(at)
                self.counts[t].append(n)
            else:
                self.rows[t] = [at]
                self.counts[t] = [n]

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.bytes >= BLOCK_BYTES

    def rows_out(self, block: int) -> pa.RecordBatch:
        """One row of documents, and one row for each term."""
        nulls = [i for i, d in enumerate(self.ids) if d is None]
        terms = list(self.rows)
        n = len(terms)
        columns = [
            pa.array([block] * (n + 1), pa.int64()),
            pa.array([None, *terms], pa.binary()),
            pa.array([None, *(np.array(self.rows[t], np.uint16).tobytes() for t in terms)], pa.binary()),
            pa.array([None, *(_counted(self.counts[t]) for t in terms)], pa.binary()),
            pa.array([np.array([d or 0 for d in self.ids], np.int64).tobytes()] + [None] * n, pa.binary()),
            pa.array([np.array(nulls, np.int32).tobytes()] + [None] * n, pa.binary()),
            pa.array([np.array(self.sizes, np.int64).tobytes()] + [None] * n, pa.binary()),
            pa.array([sum(s > 0 for s in self.sizes), *(len(self.rows[t]) for t in terms)], pa.int64()),
            pa.array([sum(self.sizes)] + [None] * n, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _INDEX.split(", ")])


def index(docs: DataFrame, wanted: Broadcast | None, doc_id: str, text: str) -> DataFrame:
    """Blocks of documents: a row for each block and term of it, and one for the block itself.

    Only ``wanted`` terms are kept, or all without it. Documents without a term are in no block.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = wanted.value if wanted is not None else None
        # A block is named by its task and its number there; the table is written once.
        name = TaskContext.get().partitionId() << 32
        block = _Block()
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(d, t.as_py(), keep)
                if block.full():
                    yield block.rows_out(name)
                    block, name = _Block(), name + 1
        if block.ids:
            yield block.rows_out(name)

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).cast("binary").alias("t"))
    return rows.where(F.col("t").isNotNull()).mapInArrow(blocks, _INDEX)


def _item_terms(items: DataFrame) -> DataFrame:
    """``item``, ``grp``, ``term``, ``times`` of ``item``, ``grp``, ``t`` rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, grp, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts: dict[bytes, int] = {}
                for t in terms_of(text):
                    counts[t] = counts.get(t, 0) + 1
                out += [(item, grp, t, n) for t, n in counts.items()]
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "grp", "term", "times"]
            )

    return items.mapInArrow(split, "item long, grp long, term binary, times long")


def _lengths(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with so many terms."""
    most = int(sizes.max()) if len(sizes) else 0
    if 75 * most * n_docs < 1 << 62:
        return 25 + (75 * sizes * n_docs) // n_terms
    return np.array([25 + (75 * int(s) * n_docs) // n_terms for s in sizes], np.int64)


def _kept(scores: np.ndarray, rest: int, top: int) -> np.ndarray:
    """Rows that may still be among the ``top`` when at most ``rest`` is added to each."""
    rows = np.flatnonzero(scores)
    if len(rows) > top:
        have = scores[rows]
        tenth = np.partition(have, len(have) - top)[len(have) - top]
        rows = rows[have + rest >= tenth]
    return rows


def _stage(n_docs: int, n_terms: int, top: int):
    """The function of one stage: a bundle and the postings of its terms, in a cogroup."""

    def add(bundles: pd.DataFrame, postings: pd.DataFrame) -> pd.DataFrame:
        if bundles.empty or postings.empty:
            return bundles
        bundle = bundles.iloc[0]
        sizes = np.frombuffer(bundle["sizes"], np.int64)
        lengths = _lengths(sizes, n_docs, n_terms)
        parts: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        rest: dict[int, int] = {}
        for p in postings.itertuples(index=False):
            rows = np.frombuffer(p.rows, np.uint16)
            counts = np.frombuffer(p.counts, np.uint8 if len(p.counts) == len(rows) else np.int64).astype(np.int64)
            gain = int(p.weight) * ((1_000_000_000 * counts) // (1000 * counts + 8 * lengths[rows]))
            for item, times, more in zip(p.items, p.times, p.rest):
                parts.setdefault(int(item), []).append((rows, gain, int(times)))
                rest[int(item)] = int(more)
        sums = {int(i): (r, s) for i, r, s in zip(bundle["items"], bundle["rows"], bundle["scores"])}
        for item, found in parts.items():
            scores = np.zeros(len(sizes), np.int64)
            if item in sums:
                scores[np.frombuffer(sums[item][0], np.uint16)] = np.frombuffer(sums[item][1], np.int64)
            for rows, gain, times in found:
                scores[rows] += gain * times
            rows = _kept(scores, rest[item], top)
            sums[item] = rows.astype(np.uint16).tobytes(), scores[rows].tobytes()
        out = bundles.head(1).copy()
        out["items"] = [list(sums)]
        out["rows"] = [[r for r, _ in sums.values()]]
        out["scores"] = [[s for _, s in sums.values()]]
        return out

    return add


def _best(top: int):
    """The best of each bundle: ``item``, ``doc_id``, ``score`` rows."""

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            items, docs, null, totals = [], [], [], []
            for b in batch.itertuples(index=False):
                ids = np.frombuffer(b.ids, np.int64)
                missing = np.zeros(len(ids), bool)
                missing[np.frombuffer(b.null_ids, np.int32)] = True
                for item, r, s in zip(b.items, b.rows, b.scores):
                    rows, scores = np.frombuffer(r, np.uint16), np.frombuffer(s, np.int64)
                    order = np.lexsort((ids[rows], missing[rows], -scores))[:top]
                    items.append(np.full(len(order), item, np.int64))
                    docs.append(ids[rows[order]])
                    null.append(missing[rows[order]])
                    totals.append(scores[order])
            if items:
                doc_id = pd.Series(np.concatenate(docs)).astype("Int64")
                doc_id[np.concatenate(null)] = pd.NA
                yield pd.DataFrame({"item": np.concatenate(items), "doc_id": doc_id, "score": np.concatenate(totals)})

    return best


def _stage_of(share: Column) -> Column:
    stage = F.lit(len(STAGES) - 1)
    for k in reversed(range(len(STAGES) - 1)):
        stage = F.when(share <= F.lit(STAGES[k]), F.lit(k)).otherwise(stage)
    return stage


def _to_every_task(terms: DataFrame) -> Broadcast | None:
    """The distinct terms, if their number and size are under the bounds."""
    terms = terms.select("term").distinct()
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    if size["n"] > BROADCAST_TERMS or (size["bytes"] or 0) > BROADCAST_BYTES:
        return None
    found = frozenset(bytes(r["term"]) for r in terms.toLocalIterator())
    return terms.sparkSession.sparkContext.broadcast(found)


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = TOP,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``top`` documents of each item.

    Terms, weights and scores are integers as the module's constants fix them. Equal
    scores are ranked by ascending id; null ids come last among them, and rows with the
    same id are documents of their own with ranks of their own. Null and empty texts have
    no term: as documents they count nowhere, as items they have no row. Items of equal
    text are searched once and each get their rows; a null item id stays null. A document
    of any length is one row of its block. Without documents or items there is no row.
    Other columns are not read, whatever their names.
    """
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("t")).where(F.col("t").isNotNull())
    # Numbers of distinct texts: any distinct numbers do, as they are written once.
    texts = spool(asked.select("t").distinct().select("t", F.monotonically_increasing_id().alias("item")))
    groups = max(1, -(-texts.count() // GROUP_ITEMS))
    wanted = spool(_item_terms(texts.select("item", F.pmod(F.hash("item"), F.lit(groups)).cast("long").alias("grp"), F.col("t").cast("binary"))))
    held = spool(index(docs, _to_every_task(wanted), doc_id, text))
    whole = held.where(F.col("term").isNull())
    totals = whole.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = totals["n"] or 0, totals["l"] or 0
    result = "item_id, rank int, doc_id long, score long"
    if not n_docs:
        nothing = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in result.split(", ")[1:]]
        return asked.where(F.lit(False)).select("item_id", *nothing)

    holding = held.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n_docs").alias("df"))
    odds = F.lit(float(2 * n_docs + 2)) / (2.0 * F.col("df") + 1.0)
    weighed = (
        wanted.join(holding, "term")
        .withColumn("weight", F.floor(F.lit(1000.0) * F.ln(odds)).cast("long"))
        .withColumn("stage", _stage_of(F.col("df") / F.lit(float(n_docs))))
    )
    # The most that the later stages can add to any document of the item.
    later = Window.partitionBy("item").orderBy("stage").rangeBetween(1, Window.unboundedFollowing)
    owned = spool(
        weighed.withColumn("rest", F.coalesce(F.sum(F.col("weight") * F.col("times") * 1_000_000).over(later), F.lit(0)))
        .groupBy("stage", "term", "weight", "grp")
        .agg(F.collect_list(F.struct("item", "times", "rest")).alias("of"))
    )
    bundles = whole.select(
        "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"),
        "ids",
        "null_ids",
        "sizes",
        F.array().cast("array<long>").alias("items"),
        F.array().cast("array<binary>").alias("rows"),
        F.array().cast("array<binary>").alias("scores"),
    )
    for stage in range(len(STAGES)):
        postings = (
            held.where(F.col("term").isNotNull())
            .select("block", "term", "rows", "counts")
            .join(owned.where(F.col("stage") == stage), "term")
            .select(
                F.col("block").alias("in_block"),
                F.col("grp").alias("of_grp"),
                "rows",
                "counts",
                "weight",
                F.col("of.item").alias("items"),
                F.col("of.times").alias("times"),
                F.col("of.rest").alias("rest"),
            )
        )
        bundles = (
            bundles.groupBy("block", "grp")
            .cogroup(postings.groupBy("in_block", "of_grp"))
            .applyInPandas(_stage(n_docs, n_terms, top), _BUNDLE)
        )
    best = bundles.mapInPandas(_best(top), "item long, doc_id long, score long").where(F.col("score") > 0)
    ranked = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    best = best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    return asked.join(texts, "t").join(best, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")
