"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k is cut into k + 1 pieces; whatever holds the item with at most k edits
holds one piece unchanged. One automaton finds all pieces in one pass over a text, and each place found is
verified with Myers' bit-parallel edit distance. Items are broadcast in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.rows import packed, text_function

PIECE = 24
BLOCK_CHARS = 4_000_000


def normal(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def budget_of(item: str, piece: int = PIECE) -> int:
    """Edits allowed for an item: as many as leave every piece ``piece`` characters or more."""
    return max(0, len(item) // piece - 1)


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """Offset and text of the ``budget + 1`` pieces, as even as they can be."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_end(pattern: str, text: str) -> tuple[int, int]:
    """Fewest edits between the pattern and any part of the text, and where the first such part ends.

    Myers' algorithm: one step of whole-word operations per character, the pattern's length in bits.
    """
    size = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, end = size, 0
    for place, c in enumerate(text, start=1):
        equal = masks.get(c, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (~(vertical | up) & full)
        minus = up & vertical
        if score < best:
            best, end = score, place
    return best, end


@dataclass
class Matcher:
    """The items of a block and an automaton over all their pieces."""

    items: list[tuple[int, str]]

    @cached_property
    def sizes(self) -> list[tuple[int, int]]:
        """Length and error budget of every item."""
        return [(len(item), budget_of(item)) for _, item in self.items]

    @cached_property
    def automaton(self):
        """Built once in every process that uses it."""
        return self.build()

    def build(self):
        import ahocorasick

        found: dict[str, dict[int, tuple[int, int]]] = {}
        for number, (_, item) in enumerate(self.items):
            for offset, piece in pieces(item, budget_of(item)):
                places = found.setdefault(piece, {})
                places[number] = places.get(number, (offset,))[0], offset
        automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            automaton.add_word(piece, (len(piece), [(n, first, last) for n, (first, last) in places.items()]))
        automaton.make_automaton()
        return automaton

    def matches(self, automaton, text: str) -> Iterator[tuple[int, int, int, int]]:
        """Item id, edits, start and end of the best match of each item that the text holds.

        A piece that an item repeats is one entry: the windows of its places overlap, as each is longer than the item. Windows are
        merged while they come, so a repetitive text keeps few of them.
        """
        windows: dict[int, list[list[int]]] = {}
        for end, (length, places) in automaton.iter(text):
            for number, first, last in places:
                begin, (size, budget) = end + 1 - length, self.sizes[number]
                low, high = max(0, begin - last - budget), begin - first + size + budget
                spans = windows.setdefault(number, [])
                if spans and low <= spans[-1][1] and high >= spans[-1][0]:
                    spans[-1] = [min(low, spans[-1][0]), max(high, spans[-1][1])]
                else:
                    spans.append([low, high])
        for number, spans in sorted(windows.items()):
            ident, item = self.items[number]
            budget, best = budget_of(item), None
            for low, high in _merged(spans):
                edits, end = best_end(item, text[low:high])
                if edits <= budget and (best is None or edits < best[0]):
                    best = edits, low, low + end
            if best:
                edits, low, end = best
                low = max(low, end - len(item) - budget)
                _, back = best_end(item[::-1], text[low:end][::-1])
                yield ident, edits, end - back, end


def _merged(spans: list[list[int]]) -> list[tuple[int, int]]:
    found: list[list[int]] = []
    for low, high in sorted(spans):
        if found and low <= found[-1][1]:
            found[-1][1] = max(found[-1][1], high)
        else:
            found.append([low, high])
    return [(low, high) for low, high in found]


def item_blocks(benchmark: DataFrame, key: str, text: str, limit: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in blocks of at most ``limit`` characters (a longer item is a block of its own)."""
    block, size = [], 0
    rows = benchmark.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).where("k is not null and t is not null")
    for row in rows.distinct().toLocalIterator():
        item = normal(row["t"])
        if not item:
            continue
        if block and size + len(item) > limit:
            yield block
            block, size = [], 0
        block.append((row["k"], item))
        size += len(item)
    if block:
        yield block


def _found(texts: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """Rows ``_key, item_id, edits, start, end`` of one block of items."""
    shared = texts.sparkSession.sparkContext.broadcast(Matcher(sorted(items)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        automaton = matcher.build()
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for key, text in zip(keys, batch.column(1)):
                if text.is_valid:
                    rows.extend((key, *m) for m in matcher.matches(automaton, normal(text.as_py())))
            if rows:
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int32(), pa.int32(), pa.int32())
                columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["_key", "item_id", "edits", "match_start", "match_end"])

    kind = texts.schema["_key"].dataType.simpleString()
    return texts.select("_key", "_text").mapInArrow(run, f"_key {kind}, item_id long, edits int, match_start int, match_end int")


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id") -> DataFrame:
    """One row per document and test item that it holds within the item's error budget.

    ``match_start`` and ``match_end`` count characters of the text in normal form (lower case, single spaces).
    Null or blank texts and items match nothing; an item id that comes with several texts matches by each;
    repeated rows each give their rows; empty tables give none.
    """
    texts = packed(docs, text).select(F.col(f"_row.`{key}`").alias("_key"), "_text")
    found = None
    for block in item_blocks(benchmark, item, "text"):
        part = _found(texts, block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = _found(texts.limit(0), [])
    return found.select(F.col("_key").alias(key), "item_id", "edits", "match_start", "match_end")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no test item, in their own columns; each block of items is one pass over the texts."""
    for block in item_blocks(benchmark, "item_id", "text"):
        docs = docs.where(~_holds(docs, block)(F.col(f"`{text}`").cast("string")))
    return docs


def _holds(docs: DataFrame, items: list[tuple[int, str]]) -> Callable[[Column], Column]:
    """Whether a text holds one of the items."""
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(sorted(items)))

    def run(texts: pa.Array) -> pa.Array:
        matcher = shared.value
        return pa.array([t.is_valid and next(matcher.matches(matcher.automaton, normal(t.as_py())), None) is not None for t in texts], pa.bool_())

    return text_function(run, "boolean")
