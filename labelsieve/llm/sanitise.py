"""Personal data: patterns of fixed kinds, and terms that give them away.

Addresses and numbers are found by patterns. Each of their values is a protected entity.
Words that stand near an entity are candidates; over the distinct texts of the corpus the
pointwise mutual information of word and entity, PMI = log2(N c(t, e) / (c(t) c(e))), says
how much of the entity's information content, IC = log2(N / c(e)), the word gives away.
From a share ``GENERALISE`` on a word is replaced by what kind of word it is, from
``REMOVE`` on it is taken out, wherever it stands.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.texts import plain
from labelsieve.session import spool

# The kinds in the order in which spans of one place are named.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Words on either side of an entity, and different surroundings that a word and an
# entity share at least: copies of one passage tell nothing new.
WINDOW = 8
LEAST_CONTEXTS = 3
# Shares of an entity's information content.
GENERALISE = 0.95
REMOVE = 0.99
# Words that go to every task at a time, and their bytes; more of them take more rounds.
ROUND_TERMS = 500_000
ROUND_BYTES = 16_000_000

# The patterns of the kinds. Runs are possessive and begin at their first character, which
# finds the same matches without trying every place of a long run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Every number lies inside such a stretch.
_STRETCH = re.compile(r"[0-9+][0-9 ().+-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """(start, number of the kind, end) of the patterns' matches, in that order."""
    found: list[Span] = [(a, 0, b) for a, b in _emails(text)]
    for stretch in _STRETCH.finditer(text):
        first, last = stretch.span()
        if last - first < 7:
            continue
        for m in _IP.finditer(text, first, last):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text, first, last):
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, first, last):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _entity(text: str, span: Span) -> bytes:
    """What the span names, however it is written."""
    start, kind, end = span
    value = text[start:end]
    if kind == 0:
        value = value.lower()
    elif kind == 1:
        value = ".".join(p.lstrip("0") or "0" for p in value.split("."))
    else:
        value = _NOT_DIGIT.sub("", value)
    return hashlib.md5(f"{KINDS[kind]}:{value}".encode()).digest()


def free_words(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Places of words that no span touches."""
    words = [m.span() for m in _WORD.finditer(text)]
    if not spans:
        return words
    starts = [s[0] for s in spans]
    # Spans of different kinds may overlap: the furthest end so far.
    ends, furthest = [], 0
    for s in spans:
        furthest = max(furthest, s[2])
        ends.append(furthest)
    kept = []
    for a, b in words:
        k = bisect_left(starts, b)
        if not k or ends[k - 1] <= a:
            kept.append((a, b))
    return kept


def _surroundings(text: str, spans: list[Span]) -> Iterator[tuple[bytes, list[str]]]:
    """Each span's entity and the words about it, in order."""
    words = free_words(text, spans)
    starts = [a for a, _ in words]
    for span in spans:
        k, after = bisect_left(starts, span[0]), bisect_right(starts, span[2] - 1)
        near = [*words[max(0, k - WINDOW) : k], *words[after : after + WINDOW]]
        yield _entity(text, span), [text[a:b].lower() for a, b in near]


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))
    for batch in batches:
        out: list[tuple] = []
        for text in batch.column(0).to_pylist():
            if spans := base_spans(text):
                source = hashlib.md5(text.encode()).digest()
                for entity, words in _surroundings(text, spans):
                    out.append((entity, source, hashlib.md5(" ".join(words).encode()).digest(), sorted(set(words))))
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["entity", "source", "context", "terms"]
        )


def _rounds(terms: DataFrame, *columns: str) -> Iterator[Broadcast]:
    """A frame with a ``term`` column as broadcast rows, a bounded part at a time."""
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
    rounds = math.ceil(max(size["n"] / ROUND_TERMS, (size["bytes"] or 0) / ROUND_BYTES))
    for k in range(rounds):
        part = terms.where(F.pmod(F.xxhash64("term"), F.lit(rounds)) == k) if rounds > 1 else terms
        found = {r["term"]: tuple(r[c] for c in columns) for r in part.select("term", *columns).collect()}
        yield terms.sparkSession.sparkContext.broadcast(found)


def _held_terms(shared: Broadcast) -> Column:
    """The broadcast terms that a text holds."""

    def held(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        wanted = shared.value.keys()
        for batch in batches:
            # Words are cut before they are lowered, as lowering may bring marks.
            yield pd.Series([sorted({w.lower() for w in _WORD.findall(t)} & wanted) for t in batch], dtype=object)

    return F.pandas_udf(held, "array<string>")(F.col("t"))


def disclosing_terms(docs: DataFrame, text: str = "text", generalise: float = GENERALISE) -> DataFrame:
    """``term`` and ``share``, the largest share of an entity's information that it gives away.

    Counts are of distinct texts: copies count once. A word and an entity are considered
    if they stand within ``WINDOW`` words in ``LEAST_CONTEXTS`` different surroundings.
    """
    texts = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
    mentions = spool(texts.mapInArrow(_mentions, "entity binary, source binary, context binary, terms array<string>"))
    n = texts.select(F.md5(F.col("t").cast("binary"))).distinct().count()
    entities = mentions.groupBy("entity").agg(
        F.count_distinct("source").alias("with_entity"), F.count_distinct("context").alias("contexts")
    )
    known = entities.where(F.col("contexts") >= LEAST_CONTEXTS).select(
        "entity", "with_entity", (F.log2(F.lit(float(n))) - F.log2(F.col("with_entity").cast("double"))).alias("ic")
    )
    near = mentions.select("entity", "source", "context", F.explode("terms").alias("term"))
    pairs = (
        near.join(known.where(F.col("ic") > 0), "entity")
        .groupBy("entity", "term", "with_entity", "ic")
        .agg(F.count_distinct("source").alias("both"), F.count_distinct("context").alias("contexts"))
        .where(F.col("contexts") >= LEAST_CONTEXTS)
    )
    # A term is in no fewer texts than it is near any entity in: most common words end here.
    at_least = near.groupBy("term").agg(F.count_distinct("source").alias("seen"))
    share = F.lit(1.0) + (F.log2(F.col("both").cast("double")) - F.log2(F.col("seen").cast("double"))) / F.col("ic")
    candidates = spool(
        pairs.join(at_least, "term").where(share >= generalise - 1e-12).select("term", "both", "ic")
    )
    counted = None
    for shared in _rounds(candidates.select("term").distinct()):
        found = texts.select(F.md5(F.col("t").cast("binary")).alias("source"), F.explode(_held_terms(shared)).alias("term"))
        counts = found.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("seen"))
        counted = counts if counted is None else counted.unionByName(counts)
    if counted is None:
        return candidates.select("term", F.col("ic").alias("share"))
    # PMI / IC = 1 + log2(p(entity | term)) / IC.
    return (
        candidates.join(counted, "term")
        .select("term", share.alias("share"))
        .groupBy("term")
        .agg(F.max("share").alias("share"))
        .where(F.col("share") >= generalise - 1e-12)
    )


def _general(word: str) -> str:
    return "[NUMBER]" if word.isdigit() else "[NAME]" if word[0].isupper() else "[WORD]"


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, kind, b in spans)


def term_spans(text: str, base: list[Span], terms: dict[str, tuple[float]]) -> list[tuple[int, int, float]]:
    """Start, end and share of the disclosing words outside the base spans."""
    if not terms or terms.keys().isdisjoint({w.lower() for w in _WORD.findall(text)}):
        return []
    places = ((a, b, terms.get(text[a:b].lower())) for a, b in free_words(text, base))
    return [(a, b, share[0]) for a, b, share in places if share is not None]


def _locator(shared: Broadcast) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def locate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([term_spans(t, base_spans(t), shared.value) for t in batch], dtype=object)

    return locate


def sanitised(text: str, base: list[Span], terms: list[tuple[int, int, float]], remove: float = REMOVE) -> str:
    """The text with base spans named by their kind, and terms generalised or removed."""
    cuts = [(a, b, f"[{KINDS[k].upper()}]") for a, k, b in base]
    cuts += [(a, b, "" if share >= remove else _general(text[a:b])) for a, b, share in terms]
    out, at = [], 0
    for a, b, instead in sorted(cuts):
        if a >= at:
            out += [text[at:a], instead]
        at = max(at, b)
    return "".join([*out, text[at:]])


_FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, n_term long, "
    "base_sha256 string, spans string, sanitised string"
)


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per row: counts and spans of personal data, and the text without it.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and then kind:
    the patterns' matches and the disclosing terms (kind ``term``), which lie outside of
    them. ``base_sha256`` is the digest of the patterns' part alone. In ``sanitised`` a
    match is replaced by its kind, of overlapping ones by that of the first. A null text
    counts as empty and has no span, a null id stays null, and repeated rows give repeated
    rows but count once in the corpus statistics. Without personal data in the corpus no
    term discloses any. Other columns are not read, whatever their names. Terms are
    broadcast in rounds of at most ``ROUND_TERMS``, each looked up in its own pass.
    """
    terms = spool(disclosing_terms(docs, text))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    located = "array<struct<start: long, end: long, share: double>>"
    found = F.array().cast(located)
    rounds = list(_rounds(terms, "share"))
    last = rounds.pop() if rounds else None
    for shared in rounds:
        found = F.concat(found, F.pandas_udf(_locator(shared), located)(F.col("t")))

    def describe(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = last.value if last is not None else {}
        for texts, before in batches:
            out = []
            for t, earlier in zip(texts, before):
                t = plain(t)
                base = base_spans(t)
                more = sorted([*((s["start"], s["end"], s["share"]) for s in earlier), *term_spans(t, base, table)])
                named = [(a, KINDS[k], b) for a, k, b in base]
                counts = [sum(k == kind for _, k, _ in base) for kind in range(len(KINDS))]
                order = {kind: k for k, kind in enumerate((*KINDS, TERM))}
                whole = sorted([*named, *((a, TERM, b) for a, b, _ in more)], key=lambda s: (s[0], order[s[1]], s[2]))
                digest = hashlib.sha256(_joined(named).encode()).hexdigest()
                out.append((*counts, len(more), digest, _joined(whole), sanitised(t, base, more)))
            yield pd.DataFrame(out, columns=[f.split()[0] for f in _FOUND.split(", ")])

    found = F.pandas_udf(describe, _FOUND)(F.col("t"), found)
    return rows.select("doc_id", found.alias("f")).select("doc_id", "f.*")
