"""SentencePiece encoding and decoding with a given model file.

An Aho-Corasick automaton over the pieces reports, in one pass over a text, every
piece that ends at a position (through its output links); the best score of a prefix
is relaxed with them, as in a Viterbi search. In a unigram model the score is the sum
of the pieces' scores. In a BPE model the same pass admits a piece only after a piece
that merging would leave beside it; of each prefix one segmentation is then left,
the one that merging by rank finds.

No piece of such models reaches over the beginning of a word, so the unit of the pass
is a word with the spaces before it, and worker processes remember units.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelsieve.llm.texts import chunks, plain

# Units and pairs of pieces that a worker remembers (units twice over), and the longest
# unit that is remembered: some 200 MB at most.
CACHE = 400_000
LONGEST_KEY = 64
# Bytes of the texts that are encoded before their rows are handed on.
AT_ONCE = 1_000_000

_SPACE = "▁"
# Kinds of pieces and models, and the handicap of unknown characters.
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6
_UNIGRAM, _BPE = 1, 2
_UNKNOWN_PENALTY = 10.0
_UNKNOWN_SURFACE = " ⁇ "


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, model: bytes):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        rules = proto.normalizer_spec
        if rules.precompiled_charsmap or not rules.escape_whitespaces:
            raise ValueError("only models that leave characters as they are can be read")
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (_UNIGRAM, _BPE):
            raise ValueError("only unigram and BPE models can be read")
        self.prefix = rules.add_dummy_prefix
        self.squeeze = rules.remove_extra_whitespaces
        self.byte_fallback = proto.trainer_spec.byte_fallback
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.score: dict[int, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        self.surface: list[bytes] = []
        plain_scores = [p.score for p in proto.pieces if p.type == _NORMAL] or [0.0]
        self.unknown_score = min(plain_scores) - _UNKNOWN_PENALTY
        automaton = ahocorasick.Automaton()
        for i, p in enumerate(proto.pieces):
            surface = p.piece.encode()
            if p.type == _BYTE:
                surface = bytes([int(p.piece[1:-1], 16)])
                self.byte[surface[0]] = i
            elif p.type == _UNKNOWN:
                surface = _UNKNOWN_SURFACE.encode()
            elif p.type == _CONTROL:
                surface = b""
            elif p.type in (_NORMAL, _USER):
                # A piece that the user asked for is always taken.
                score = p.score if p.type == _NORMAL else len(p.piece) * max(plain_scores) - 0.1
                self.id[p.piece], self.score[i] = i, score
                automaton.add_word(p.piece, (i, len(p.piece), score))
            self.surface.append(surface)
        automaton.make_automaton()
        self.automaton = automaton
        inside = re.compile(f"[^{_SPACE}]{_SPACE}")
        self.by_unit = not any(inside.search(p) for p in self.id)
        self.units = re.compile(f"{_SPACE}+[^{_SPACE}]*|[^{_SPACE}]+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.borders: dict[int, bool] = {}
        self.text = {i: p for p, i in self.id.items()}
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}

    def _merged(self, text: str) -> list[str]:
        """A short text merged by rank, for the border of two pieces."""
        parts = list(text)
        while len(parts) > 1:
            pairs = enumerate(zip(parts, parts[1:]))
            ranked = [(self.score[self.id[a + b]], -k) for k, (a, b) in pairs if a + b in self.id]
            if not ranked:
                break
            k = -max(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _border(self, a: int, b: int) -> bool:
        """Whether merging leaves two pieces beside each other."""
        if len(self.borders) > CACHE:
            self.borders.clear()
        left, right = self.text[a], self.text[b]
        found = self.borders[a * len(self.surface) + b] = self._merged(left + right) == [left, right]
        return found

    def _pass(self, unit: str) -> tuple[int, ...]:
        """The best segmentation of a unit, by one pass of the automaton."""
        last, begin = (self._merge_pass if self.kind == _BPE else self._score_pass)(unit)
        out: list[int] = []
        e = len(unit)
        while e:
            piece = last[e]
            if piece >= 0:
                out.append(piece)
            elif self.byte_fallback:
                out += [self.byte[c] for c in reversed(unit[begin[e] : e].encode("utf-8", "replace"))]
            elif not out or out[-1] != self.unknown:
                # Unknown characters in a row are one piece.
                out.append(self.unknown)
            e = begin[e]
        return tuple(reversed(out))

    def _score_pass(self, unit: str) -> tuple[list[int], list[int]]:
        """Of every prefix: the last piece (-1: unknown) of its best scored way, and its begin."""
        n = len(unit)
        best = [0.0] + [-np.inf] * n
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        alone = [False] * (n + 1)  # whether a piece is the last character alone
        unknown, done = self.unknown_score, 0
        for end, (piece, length, score) in chain(self.automaton.iter(unit), [(n, (-1, 0, 0.0))]):
            # Positions before this end are complete: longer pieces came first.
            while done < end:
                done += 1
                if not alone[done] and best[done - 1] + unknown > best[done]:
                    best[done], last[done], begin[done] = best[done - 1] + unknown, -1, done - 1
            if length:
                e, start = end + 1, end + 1 - length
                alone[e] |= length == 1
                if best[start] + score > best[e]:
                    best[e], last[e], begin[e] = best[start] + score, piece, start
        return last, begin

    def _merge_pass(self, unit: str) -> tuple[list[int], list[int]]:
        """The same for merges: of the pieces that end a prefix, the one that they leave there.

        A piece is left after the one before it if merging the two alone leaves both,
        so there is one way for each prefix. An unknown character is its own piece.
        """
        n = len(unit)
        last, begin = [-2] * (n + 1), [0] * (n + 1)  # -2: not yet reached
        last[0] = -1
        borders, width, done = self.borders, len(self.surface), 0
        for end, (piece, length, _) in self.automaton.iter(unit):
            while done < end:
                done += 1
                if last[done] == -2:
                    last[done], begin[done] = -1, done - 1
            e = end + 1
            if last[e] == -2:
                before = last[e - length]
                if before >= 0:
                    left = borders.get(before * width + piece)
                    if not (self._border(before, piece) if left is None else left):
                        continue
                last[e], begin[e] = piece, e - length
        for e in range(done + 1, n + 1):
            if last[e] == -2:
                last[e], begin[e] = -1, e - 1
        return last, begin

    def _remember(self, unit: str, found: tuple[int, ...]) -> None:
        if len(unit) <= LONGEST_KEY:
            if len(self.known) > CACHE:
                # What was of use lately is found in the older half and moves on.
                self.older, self.known = self.known, {}
            self.known[unit] = found

    def _part(self, unit: str) -> tuple[int, ...]:
        found = self.known.get(unit)
        if found is None:
            found = self.older.get(unit) or self._pass(unit)
            self._remember(unit, found)
        return found

    def _unit(self, unit: str) -> tuple[int, ...]:
        """A unit, cut where no piece has the two characters in a row."""
        found = self.known.get(unit)
        if found is not None:
            return found
        found = self.older.get(unit)
        if found is None:
            # Cutting saves work and changes nothing; words of letters alone are left whole.
            inside = () if unit[1:].isalpha() else range(1, len(unit))
            cuts = [k for k in inside if unit[k - 1 : k + 1] not in self.inside]
            # Unknown characters in a row are one piece, so they must not be parted.
            if not cuts or not self.byte_fallback:
                found = self._pass(unit)
            else:
                parts = [unit[a:b] for a, b in zip([0, *cuts], [*cuts, len(unit)])]
                found = tuple(chain.from_iterable(map(self._part, parts)))
        self._remember(unit, found)
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of the pieces; an empty text has none."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return np.zeros(0, np.int32)
        text = (" " if self.prefix else "") + text
        text = text.replace(" ", _SPACE)
        units = self.units.findall(text) if self.by_unit else [text]
        return np.fromiter(chain.from_iterable(map(self._unit, units)), np.int32)

    def decode(self, ids) -> str:
        """The text of ids. A byte that is not part of a character becomes U+FFFD."""
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace").replace(_SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


_workers: dict[str, Pieces] = {}


def _worker(path: str) -> Pieces:
    if path not in _workers:
        with open(path, "rb") as file:
            _workers[path] = Pieces(file.read())
    return _workers[path]


def encode(path: str, text: Column) -> Column:
    """Ids of the pieces of each text; none for null and empty texts."""

    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _worker(path)
        for batch in batches:
            yield pd.Series([pieces.encode(plain(t)) for t in batch], dtype=object)

    return F.pandas_udf(ids, "array<int>")(text)


def decode(path: str, ids: Column) -> Column:
    """The text of each array of ids; null stays null."""

    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _worker(path)
        for batch in batches:
            yield pd.Series([None if row is None else pieces.decode(row.tolist()) for row in batch], dtype=object)

    return F.pandas_udf(texts, "string")(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """A row per row: ``doc_id``, ``ids``, ``n_pieces``, ``decoded``, ``same``.

    ``same`` tells whether the text decoded from the ids is the text (null counts as
    empty). It is, but for texts with U+2581, which the model writes spaces with. A
    null id stays null; repeated rows give repeated rows; other columns are not read,
    whatever their names. The model file lies at ``path`` on every executor.

    One pass through one worker encodes and decodes, some texts at a time.
    """
    given = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    kind = given.schema["doc_id"]
    schema = T.StructType(
        [
            kind,
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_pieces", T.IntegerType()),
            T.StructField("decoded", T.StringType()),
            T.StructField("same", T.BooleanType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _worker(path)
        for batch in batches:
            sizes = pc.binary_length(batch["t"]).to_numpy()
            for part in chunks(sizes, sizes, AT_ONCE):
                some = batch.slice(part.start, part.stop - part.start)
                texts = some["t"].to_pylist()
                ids = [pieces.encode(t) for t in texts]
                decoded = [pieces.decode(i.tolist()) for i in ids]
                lengths = np.array([len(i) for i in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids), pa.int32()))
                same = [a == b for a, b in zip(decoded, texts)]
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"], lists, pa.array(lengths), pa.array(decoded, pa.string()), pa.array(same)],
                    names=schema.names,
                )

    return given.mapInArrow(run, schema)
