"""SentencePiece encoding and decoding with a weighted finite-state transducer.

A model file is compiled once per Python worker into three parts: the normaliser (space marks and the mark
before the text), the pieces as a trie whose accepting states write piece ids, and byte fallback arcs for
characters that are no piece. Composed with a text they give a lattice, and the path of least weight in the
tropical semiring is the encoding.

A unigram model weighs a piece by its negative score. A model of merges has no such weights: its greedy merges
are not the path of least score. There the state is the last piece, and an arc weighs nothing if merging the
last piece and the next one leaves just those two, and is infinite otherwise. A sequence of pieces is the merged form
of its text exactly if each neighbouring pair is, so one path has finite weight: at every position one state.

No piece spans the end of a word (a space mark follows other characters in no piece), so the lattice falls
apart into words and the path of a word is found once and kept.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.rows import packed, text_function

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
KEPT_WORDS = 400_000
KEPT_PAIRS = 250_000
LONGEST_KEPT = 48
ROWS_AT_ONCE = 1_000
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
INFINITE = float("inf")


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at : at + size], at + size
        else:
            size = 4 if kind == 5 else 8
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Transducer:
    """A compiled model."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.dummy_prefix, self.squeeze, mapped = UNIGRAM, True, True, b""
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
                self.pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
            elif number == 2:
                self.kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                mapped, self.dummy_prefix, self.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if mapped or self.kind not in (UNIGRAM, MERGES) or any(t == USER_DEFINED for _, _, t in self.pieces):
            raise ValueError("only identity normalisers and unigram or merge models without user-defined pieces can be compiled")
        self.score = {p: s for p, s, t in self.pieces if t == NORMAL}
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == BYTE}
        self.unknown = next((i for i, (_, _, t) in enumerate(self.pieces) if t == UNKNOWN), 0)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece spans the end of a word")
        self.trie: tuple[dict, list] = ({}, [])  # arcs by character, and the piece written on arrival
        for piece in self.ids:
            node = self.trie
            for c in piece:
                node = node[0].setdefault(c, ({}, []))
            node[1].append(piece)
        self.worst = min(self.score.values(), default=0.0) - 10.0
        self.words = _Kept(self._word, KEPT_WORDS, LONGEST_KEPT)
        self._joins: dict[str | None, dict[str, float]] = {}
        self._older: dict[str | None, dict[str, float]] = {}
        self._pairs = 0
        self._edges: dict[str, tuple[list, list]] = {}
        self.surface = [self._surface(i) for i in range(len(self.pieces))]

    # normaliser

    def normalised(self, text: str) -> str:
        """Spaces as marks, and one mark before a text that is not empty."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix and text else text

    # weights

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """What greedy merges leave of a text, and the merges: best score first, leftmost among equals."""
        parts, done = list(text), []
        while True:
            best, place = -INFINITE, -1
            for i in range(len(parts) - 1):
                score = self.score.get(parts[i] + parts[i + 1])
                if score is not None and score > best:
                    best, place = score, i
            if place < 0:
                return parts, done
            done.append((parts[place], parts[place + 1]))
            parts[place : place + 2] = [parts[place] + parts[place + 1]]

    def edges(self, piece: str) -> tuple[list[tuple[str, float, float]], list[tuple[str, float, float]]]:
        """The parts that stand at a piece's right end and at its left end while it is merged.

        Each with the rank at which it is formed and the rank at which a merge within the piece takes it in.
        A piece that merging its own characters does not leave whole has no edges: it is never written.
        """
        found = self._edges.get(piece)
        if found is None:
            parts, done = self.merged(piece)
            time = {c: 0.0 for c in piece}
            split = {}
            for left, right in done:
                whole = left + right
                time[whole] = max(-self.score[whole], time[left], time[right])
                split[whole] = (left, right)
            sides = []
            for side in (1, 0):
                spine, part, taken = [], piece, INFINITE
                while True:
                    spine.append((part, time.get(part, 0.0), taken))
                    if part not in split:
                        break
                    part, taken = split[part][side], time[part]
                sides.append(spine)
            found = self._edges[piece] = (sides[0], sides[1]) if len(parts) == 1 else ([], [])
        return found

    def stays(self, last: str | None, piece: str) -> bool:
        """Whether merging the characters of two pieces leaves just these two."""
        if last is None:
            return bool(self.edges(piece)[1])
        if not last.strip(SPACE):  # runs of marks all have one score, so that places decide and not ranks
            return self.merged(last + piece)[0] == [last, piece]
        right, left = self.edges(last)[0], self.edges(piece)[1]
        for x, x_from, x_to in right:
            for y, y_from, y_to in left:
                if max(x_from, y_from) < min(x_to, y_to):
                    score = self.score.get(x + y)
                    if score is not None and (-score < x_to and -score <= y_to):
                        return False
        return bool(right and left)

    def weight(self, last: str | None, piece: str) -> float:
        """The weight of an arc that writes ``piece`` after ``last``; kept while it is in use, in two generations."""
        if self._pairs >= KEPT_PAIRS // 2:
            self._older, self._joins, self._pairs = self._joins, {}, 0
        found = self._older.get(last, {}).get(piece)
        if found is None:
            if self.kind == UNIGRAM:
                found = -self.score[piece]
            else:
                found = 0.0 if self.stays(last, piece) else INFINITE
        self._joins.setdefault(last, {})[piece] = found
        self._pairs += 1
        return found

    # composition and shortest path

    def shortest(self, word: str) -> list[int]:
        """Ids on the path of least weight through the lattice of a word."""
        size = len(word)
        cost, last, back = [INFINITE] * (size + 1), [None] * (size + 1), [-1] * (size + 1)
        cost[0] = 0.0
        done = 0.0 if self.kind == MERGES else -INFINITE  # no path into a place weighs less
        for i in range(size):
            here, before = cost[i], last[i]
            if here == INFINITE:
                continue
            known = self._joins.get(before) or {}
            (arcs, _), j = self.trie, i
            while j < size:
                node = arcs.get(word[j])
                if node is None:
                    break
                j += 1
                arcs, written = node
                if written and cost[j] > done:
                    piece = written[0]
                    total = known.get(piece)
                    total = here + (self.weight(before, piece) if total is None else total)
                    if total < cost[j]:
                        cost[j], last[j], back[j] = total, piece, i
            if word[i] not in self.ids:
                total = here + (-self.worst if self.kind == UNIGRAM else 0.0)
                if total < cost[i + 1]:
                    cost[i + 1], last[i + 1], back[i + 1] = total, None, i
        path: list[int] = []
        place = size
        while place:
            if last[place] is not None:
                path.append(self.ids[last[place]])
            elif self.byte_ids:
                path.extend(self.byte_ids.get(b, self.unknown) for b in reversed(word[back[place]].encode()))
            else:
                path.append(self.unknown)
            place = back[place]
        return path[::-1]

    def _word(self, word: str) -> tuple[bytes, bytes]:
        """The ids of a word, and what they are decoded to."""
        path = self.shortest(word)
        return np.array(path, np.int32).tobytes(), b"".join(map(self.surface.__getitem__, path))

    def _parts(self, text: str) -> list[tuple[bytes, bytes]]:
        return list(map(self.words.__getitem__, _WORDS.findall(self.normalised(text))))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(ids for ids, _ in self._parts(text)), np.int32)

    def round_trip(self, text: str) -> tuple[np.ndarray, bool]:
        """The ids of a text, and whether they decode to it. Ids decode one after another, so those of a word do so once."""
        parts = self._parts(text)
        ids = np.frombuffer(b"".join(ids for ids, _ in parts), np.int32)
        return ids, self._read(b"".join(surface for _, surface in parts)) == text

    # decoding

    def _surface(self, number: int) -> bytes:
        piece, _, kind = self.pieces[number]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the inverse arcs, without the mark put before the text."""
        return self._read(b"".join(map(self.surface.__getitem__, ids.tolist())))

    def _read(self, surface: bytes) -> str:
        text = surface.decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


#: Words as no piece crosses their ends: marks with what follows them, and single line feeds.
_WORDS = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


class _Kept(dict):
    """Results by word in two generations: when the younger is full it becomes the older, and what is used again comes back.

    Its memory is bounded and its answers never change; frequent words are never made anew.
    """

    def __init__(self, make, most: int, longest: int) -> None:
        super().__init__()
        self.make, self.most, self.longest = make, most // 2, longest
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def __missing__(self, word: str) -> tuple[bytes, bytes]:
        found = self.older.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found


@lru_cache(maxsize=1)
def _compiled(model: bytes) -> Transducer:
    return Transducer(model)


def encoded(docs: DataFrame, text: str = "text", model: str = MODEL) -> DataFrame:
    """All rows as ``_row`` with ``n_tokens``, ``token_ids`` and ``round_trip``.

    ``round_trip`` says that decoding the ids gives the text back; it is false for a text that holds the space mark
    itself, which the model reads as a space. Null and empty texts have no tokens and round-trip as empty.
    The model file, of fixed size, is read on the driver and sent along.
    """
    with open(model, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(texts: pa.Array) -> pa.Array:
        transducer, parts = _compiled(shared.value), []
        for first in range(0, len(texts), ROWS_AT_ONCE):
            found = [transducer.round_trip(t or "") for t in texts.slice(first, ROWS_AT_ONCE).to_pylist()]
            sizes = np.array([len(ids) for ids, _ in found], np.int64)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            values = pa.array(np.concatenate([ids for ids, _ in found]), pa.int32())
            same = pa.array([ok for _, ok in found], pa.bool_())
            parts.append(pa.StructArray.from_arrays([pa.array(sizes), pa.ListArray.from_arrays(offsets, values), same], ["n_tokens", "token_ids", "round_trip"]))
        return pa.concat_arrays(parts) if parts else pa.array([], _TOKENS)

    # Only texts go to Python; the rows they belong to wait in the executor.
    rows = packed(docs, text)
    return rows.select("_row", text_function(run, "n_tokens long, token_ids array<int>, round_trip boolean")(F.col("_text")).alias("_found")).select("_row", "_found.*")


_TOKENS = pa.struct([("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32())), ("round_trip", pa.bool_())])


def decoded(tokens: DataFrame, ids: str = "token_ids", model: str = MODEL) -> DataFrame:
    """Rows of ``ids`` with their ``text``; null ids give a null text."""
    with open(model, "rb") as file:
        shared = tokens.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _compiled(shared.value)
        for batch in batches:
            texts = [None if x is None else transducer.decode(np.array(x, np.int32)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_row", "_decoded"])

    rows = tokens.select(F.struct(*(F.col(f"`{c}`") for c in tokens.columns)).alias("_row"), F.col(f"`{ids}`").alias("_ids"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(run, f"_row {kind}, _decoded string")


def token_table(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """One row per document: id, number of tokens, token ids, and whether they decode to the text.

    Repeated rows stay repeated, an empty table gives an empty one, and other columns do not matter.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    done = encoded(rows.select("_key", "_text"), "_text", model)
    return done.select(F.col("_row._key").alias(key), "n_tokens", "token_ids", "round_trip")
