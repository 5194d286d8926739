"""Removal of long byte strings that start more than once in a corpus, found with run-length indexes.

A string of ``length`` bytes is repeated if it also starts elsewhere. Each start belongs to an anchor, the rightmost
least hash among the first ``SPAN`` places of the string, so equal strings have their anchor at the same place. The
starts of one anchor share a core of bytes; equal strings have equal cores. Counting cores, and the
contexts around them, settles almost all starts with a few numbers per anchor and no text.

What remains are contexts that agree in their core and differ beside it. Their starts are cut into short
ranges with longer cores and counted again; what is still open then are a few bytes on both sides of a core. Those
texts, each core as one symbol, are indexed in groups: a run-length Burrows-Wheeler transform with samples at the
ends of runs, against which the same texts are streamed for their matching statistics. A match that covers a core and
``range - 1`` symbols more is a repeated string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import blocks as B
from quarryline.llm.rows import row_key, text_function

LENGTH = 400
SEED_BYTES = 16
RANGE = 16
GROUP_ROWS = 4_096
INDEX_ROWS = 20_000
REPORT_ROWS = 1_000


def span_of(length: int) -> int:
    """Places among which a string's anchor is chosen; at least half of it remains as its core."""
    return max(1, min(256, length // 2))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least value of each window."""
    have = 1
    while have < size:
        step = min(have, size - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """First and last start and anchor of each run of starts with one anchor, with hashes of core and context."""
    span, seed = span_of(length), min(SEED_BYTES, length - span_of(length) + 1)
    count = len(data) - length + 1
    if count <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hasher = B.Hasher(B.code(data))
    hashes = hasher.windows(seed)[: count + span - 1]
    least = _least(hashes, span)[:count]
    enters = hashes[span - 1 : span - 1 + count] == least
    fresh = np.ones(count, bool)
    fresh[1:] = (least[1:] != least[:-1]) | enters[1:]
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], count) - 1
    anchor = first + span - 1
    for i in np.flatnonzero(~enters[first]):  # the old least has left: look for the rightmost new one
        window = hashes[first[i] : first[i] + span]
        anchor[i] = first[i] + span - 1 - int(np.argmin(window[::-1]))
    core = hasher.of(anchor, anchor + length - span + 1)
    shape = ((anchor - first) * span + (anchor - last)).astype(np.uint64)
    context = B.mix(hasher.of(first, last + length) + shape * np.uint64(0x9E3779B97F4A7C15))
    return first, last, anchor, core, context


ANCHORS = "core long, context long, _k1 long, _k2 long, spot long"


def anchor_table(docs: DataFrame, length: int) -> DataFrame:
    """All anchors of ``_text``; ``spot`` packs the first start and, counted from it, the last one and the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            k1, k2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for block in B.blocks(batch.column(2)):
                for row in range(block.rows):
                    data = block.data[block.offsets[row] : block.offsets[row + 1]]
                    if len(data) < length:
                        continue
                    first, last, anchor, core, context = anchors(data, length)
                    at = block.first + row
                    same = np.ones(len(first), np.int64)
                    values = (core.view(np.int64), context.view(np.int64), k1[at] * same, k2[at] * same,
                              (first << 16) | (last - first) << 8 | (anchor - first))
                    for part, value in zip(parts, values):
                        part.append(value)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], ["core", "context", "_k1", "_k2", "spot"])

    return docs.select("_k1", "_k2", "_text").mapInArrow(run, ANCHORS)


def _with_counts(rows: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have a count, with it."""
    named = counts.select(*(F.col(c).alias(f"_x{c}") for c in keys), *(c for c in counts.columns if c not in keys))
    return rows.join(named, [F.col(c) == F.col(f"_x{c}") for c in keys]).drop(*(f"_x{c}" for c in keys))


def _settled(rows: DataFrame, core: list[str], context: list[str], stage) -> DataFrame:
    """Rows whose core is found again, with how often their whole context is found (``_n``) and how many
    different contexts their core has (``_kinds``). Counts are combined before they are shuffled."""
    # counts are written first: only plain scans on both sides of a join let Spark split a hot core
    again = stage(rows.groupBy(*core).agg(F.count("*").alias("_all")).where("_all > 1").drop("_all"), "cores")
    found = stage(_with_counts(rows, again, core), "found-again")
    contexts = stage(found.groupBy(*core, *context).agg(F.count("*").alias("_n")), "contexts")
    kinds = stage(contexts.groupBy(*core).agg(F.count("*").alias("_kinds")), "kinds")
    return _with_counts(found, _with_counts(contexts, kinds, core), [*core, *context])


def _open_and_twins(settled: DataFrame, core: list[str], context: list[str], kept: list[str]) -> DataFrame:
    """Rows with a context of their own, and one row for each other context of their cores."""
    twins = settled.where("_n > 1 and _kinds > 1").groupBy(*core, *context, "_kinds").agg(F.min(F.struct(*kept)).alias("s"))
    return settled.where("_n = 1").select(*core, *context, "_kinds", *kept).unionByName(twins.select(*core, *context, "_kinds", "s.*"))


def _ranges(marked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """Unsettled anchors cut into ranges of starts, each with a longer core and the bytes around it.

    Starts are told by their distance before the anchor, on a grid that the anchor fixes. The strings of a
    range share ``length - RANGE + 1`` bytes; up to ``RANGE - 1`` more stand on either side.
    """
    listed = _open_and_twins(marked, ["core"], ["context"], ["_k1", "_k2", "spot"])
    perdoc = listed.groupBy("_k1", "_k2").agg(F.collect_list(F.struct("core", "spot")).alias("_spots"))
    named = perdoc.select(F.col("_k1").alias("_p1"), F.col("_k2").alias("_p2"), "_spots")
    texts = docs.select("_k1", "_k2", F.col("_text").cast("binary").alias("_bytes"))
    spots = texts.join(named, (F.col("_k1") == F.col("_p1")) & (F.col("_k2") == F.col("_p2"))).select("_k1", "_k2", "_bytes", F.explode("_spots").alias("s"))
    spots = spots.selectExpr(
        "_k1", "_k2", "_bytes", "s.core AS core", "shiftright(s.spot, 16) + (s.spot & 255) AS place",
        "cast((s.spot & 255) - (shiftright(s.spot, 8) & 255) AS int) AS lo", "cast(s.spot & 255 AS int) AS hi",
    )
    cells = spots.select("*", F.expr(f"explode(sequence(lo div {RANGE}, hi div {RANGE}))").alias("cell"))
    cells = cells.selectExpr(
        "*", f"place - cell * {RANGE} AS inner", f"least(hi - cell * {RANGE}, {RANGE - 1}) AS before", f"greatest(lo - cell * {RANGE}, 0) AS skipped"
    )
    size = length - RANGE + 1
    cut = "substring(_bytes, cast({} AS int) + 1, cast({} AS int))"
    piece = cut.format("inner", size)
    return cells.selectExpr(
        "_k1", "_k2", f"xxhash64(core, cell, {piece}) AS core1", f"xxhash64({piece}, 17) AS core2",
        cut.format("inner - before", "before") + " AS left",
        cut.format(f"inner + {size}", f"{RANGE - 1} - skipped") + " AS right",
        "cast(inner - before AS long) AS start", "cast(before - skipped + 1 AS int) AS starts",
    )


class RunLengthIndex:
    """A run-length Burrows-Wheeler transform of many short texts with text places sampled at the ends of runs.

    Symbols are numbers above zero; each text ends in a symbol of its own, smaller than all others.
    """

    def __init__(self, symbols: np.ndarray, ends: np.ndarray, longest: int) -> None:
        size = self.size = len(symbols)
        text = symbols + len(ends)
        text[ends] = np.arange(len(ends))
        self.text = text
        rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while width <= longest:  # suffixes by twice as many symbols in each round
            follow = np.zeros(size, np.int64)
            follow[: size - width] = rank[width:] + 1
            key = rank * (size + 1) + follow
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(size, np.int64)
            rank[order] = np.cumsum(np.r_[0, sorted_key[1:] != sorted_key[:-1]])
            width *= 2
        last = text[order - 1]
        head = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])
        self.run_start, self.run_symbol = head, last[head]
        length = np.diff(np.r_[head, size])
        sample = order[head + length - 1]
        self.last = order[-1]
        by_symbol = np.lexsort((head, self.run_symbol))
        symbol = self.run_symbol[by_symbol]
        self.length, self.sample = length[by_symbol], sample[by_symbol]
        self.key = symbol * (size + 1) + head[by_symbol]
        total = np.cumsum(self.length) - self.length
        first = np.r_[True, symbol[1:] != symbol[:-1]]
        self.before = total - np.maximum.accumulate(np.where(first, total, 0))
        self.kinds, self.smaller = symbol[first], total[first]

    def _rank(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often a symbol stands in the transform before a place, and its last run that begins there."""
        run = np.searchsorted(self.key, symbol * (self.size + 1) + place) - 1
        known = (run >= 0) & (self.key[run] // (self.size + 1) == symbol)
        inside = np.minimum(self.length[run], place - self.key[run] % (self.size + 1))
        return np.where(known, self.before[run] + inside, 0), run

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals after one more symbol to the left, and a place in the texts for each interval."""
        under, _ = self._rank(symbol, low)
        upto, run = self._rank(symbol, high)
        base = self.smaller[np.minimum(np.searchsorted(self.kinds, symbol), len(self.kinds) - 1)]
        top = self.run_symbol[np.searchsorted(self.run_start, high - 1, side="right") - 1] == symbol
        return base + under, base + upto, np.where(top, at, self.sample[run]) - 1

    def everywhere(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of the empty string, for several searches."""
        return np.zeros(count, np.int64), np.full(count, self.size, np.int64), np.full(count, self.last, np.int64)


def repeated_ranges(groups: np.ndarray, left: list[bytes], right: list[bytes], starts: np.ndarray) -> np.ndarray:
    """For each row and start of its range: whether the string also stands in another row of its group.

    Rows of a group share a core, one symbol. Each string ends at a place of the row; from there the row is
    streamed backwards through the index while its match still stands in two places at least.
    """
    count = len(left)
    sizes = np.array([len(a) + len(b) + 2 for a, b in zip(left, right)], np.int64)
    first = np.cumsum(sizes) - sizes
    symbols = np.zeros(int(sizes.sum()), np.int64)
    core = first + np.array([len(a) for a in left], np.int64)
    joined = np.frombuffer(b"".join(a + b"\0" + b + b"\0" for a, b in zip(left, right)), np.uint8)
    symbols[:] = joined.astype(np.int64) + 1
    symbols[core] = 257 + np.unique(groups, return_inverse=True)[1]
    index = RunLengthIndex(symbols, first + sizes - 1, int(sizes.max()))
    found = np.zeros((count, RANGE), bool)
    for i in range(RANGE):
        rows = np.flatnonzero(i < starts)
        low, high, at = index.everywhere(len(rows))
        for back in range(RANGE - 1, -1, -1):
            if not len(rows):
                break
            low, high, at = index.step(index.text[first[rows] + i + back], low, high, at)
            alive = high - low > 1
            rows, low, high, at = rows[alive], low[alive], high[alive], at[alive]
        if len(rows):
            offsets = np.arange(RANGE)
            witness = index.text[at[:, None] + offsets] == index.text[(first[rows] + i)[:, None] + offsets]
            if not witness.all():
                raise AssertionError("a place found by the index does not hold the string")
            found[rows, i] = True
    return found


RUNS = "_k1 long, _k2 long, start long, starts long"


def _indexed(open_ranges: DataFrame) -> DataFrame:
    """Starts of unsettled ranges whose string is repeated, found by indexes over whole groups."""

    def search(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        columns = list(zip(*rows))
        groups = np.array(columns[0], np.int64) * 31 + np.array(columns[1], np.int64)
        hit = repeated_ranges(groups, list(columns[2]), list(columns[3]), np.array(columns[5], np.int64))
        row, start = np.nonzero(hit)
        if len(row):
            k1, k2, begin = (np.array(columns[i], np.int64)[row] for i in (6, 7, 4))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (k1, k2, begin + start, np.ones(len(row), np.int64))], ["_k1", "_k2", "start", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if len(held) >= INDEX_ROWS and row[:2] != held[-1][:2]:  # only between groups
                    yield from search(held)
                    held = []
                held.append(row)
        if held:
            yield from search(held)

    rows = open_ranges.where(f"_kinds <= {GROUP_ROWS}").select("core1", "core2", "left", "right", "start", "starts", "_k1", "_k2")
    return rows.repartition("core1", "core2").sortWithinPartitions("core1", "core2").mapInArrow(run, RUNS)


def _split_groups(open_ranges: DataFrame) -> DataFrame:
    """The same for groups too large for one task: each string of a range is counted by its own bytes."""
    rows = open_ranges.where(f"_kinds > {GROUP_ROWS}")
    each = rows.selectExpr("*", "explode(sequence(0, starts - 1)) AS i").selectExpr(
        "_k1", "_k2", "start + i AS start", "core1", "core2", "length(left) - i AS depth", "substring(left, i + 1) AS l",
        f"substring(right, 1, {RANGE - 1} - length(left) + i) AS r",
    )
    keyed = each.selectExpr("_k1", "_k2", "start", "xxhash64(core1, core2, depth, l, r) AS s1", "xxhash64(r, l, core2, 23) AS s2")
    twice = keyed.groupBy("s1", "s2").agg(F.count("*").alias("_all")).where("_all > 1").drop("_all")
    return _with_counts(keyed, twice, ["s1", "s2"]).select("_k1", "_k2", "start", F.lit(1).cast("long").alias("starts"))


def repeated(docs: DataFrame, stage, length: int = LENGTH) -> DataFrame:
    """Rows ``_k1, _k2, start, starts``: runs of starts of repeated strings in ``_text`` of rows named by ``_k1, _k2``."""
    marked = stage(_settled(stage(anchor_table(docs, length), "anchors"), ["core"], ["context"], stage), "anchor-counts")
    sure = marked.where("_n > 1").selectExpr("_k1", "_k2", "shiftright(spot, 16) AS start", "(shiftright(spot, 8) & 255) + 1 AS starts")
    core, context = ["core1", "core2"], ["left", "right", "starts"]
    closer = stage(_settled(stage(_ranges(marked, docs, length), "ranges"), core, context, stage), "range-counts")
    told = closer.where("_n > 1").select("_k1", "_k2", "start", F.col("starts").cast("long").alias("starts"))
    rest = stage(_open_and_twins(closer, core, context, ["_k1", "_k2", "start"]), "open-ranges")
    return sure.unionByName(told).unionByName(_indexed(rest)).unionByName(_split_groups(rest))


def _covered(size: int, starts: list, length: int) -> np.ndarray:
    """Which bytes of a text lie in a repeated string."""
    edge = np.zeros(size + 1, np.int64)
    begin = np.array([s["start"] for s in starts], np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + np.array([s["starts"] for s in starts], np.int64) - 1 + length, -1)
    return np.cumsum(edge)[:-1] > 0


def _named_runs(docs: DataFrame, stage, length: int) -> DataFrame:
    """All columns of docs and ``_runs``, the runs of repeated starts of the row (null if it has none).

    Equal rows share a name and bring the same runs each, of which one is kept.
    """
    runs = repeated(docs, stage, length).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "starts")).alias("_runs"))
    named = runs.select(F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2"), "_runs")
    return docs.join(named, (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")), "left").drop("_r1", "_r2")


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> bytes:
    """What is left of a text in UTF-8; a character that lost a byte goes whole."""
    leads = (data & 0xC0) != 0x80
    leads[:1] = True
    begins = np.flatnonzero(leads)
    lost = np.logical_or.reduceat(gone, begins) if len(begins) else gone
    return data[~np.repeat(lost, np.diff(np.append(begins, len(data))))].tobytes()


def removal_report(docs: DataFrame, stage, length: int = LENGTH, text: str = "text", key: str = "doc_id", with_text: bool = False) -> DataFrame:
    """One row per document: bytes, bytes removed, runs removed, and the SHA-256 of what is left.

    ``with_text`` adds what is left, in a column named as the texts were; the SHA-256 is of all bytes left, the text has
    no character that is cut in two. Null texts count as empty; shorter texts than ``length`` lose nothing; a repeated
    row makes all its strings repeated; an empty table gives an empty one.
    """
    texts = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), texts.alias("_text")).select("_key", "_text", *row_key(F.col("_key"), F.col("_text")))
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}

    def report(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, kept = [], []
        for value, runs in zip(batch.column(1), batch.column(2)):
            data = np.frombuffer(value.as_buffer(), np.uint8)
            gone = _covered(len(data), runs.as_py(), length) if runs.is_valid else np.zeros(len(data), bool)
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            out.append((len(data), int(gone.sum()), spans, hashlib.sha256(data[~gone].tobytes()).hexdigest()))
            if with_text:
                kept.append(_whole_characters(data, gone))
        columns = {"_key": batch.column(0), **{n: pa.array(v, k) for (n, k), v in zip(kinds.items(), zip(*out))}}
        if with_text:
            columns["_kept"] = pa.array(kept, pa.binary()).view(pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, REPORT_ROWS):
                yield report(batch.slice(at, REPORT_ROWS))

    kind = rows.schema["_key"].dataType.simpleString()
    found = _named_runs(rows, stage, length).select("_key", "_text", "_runs")
    names = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    done = found.mapInArrow(run, f"_key {kind}, {names}{', _kept string' if with_text else ''}")
    return done.select(F.col("_key").alias(key), *kinds, *([F.col("_kept").alias(text)] if with_text else []))


def without_repeats(docs: DataFrame, stage, length: int = LENGTH, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents without the bytes of repeated strings, in their own columns.

    Bytes of a character that is cut in two go with the removed part. A null text stays null.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text))
    rows = docs.select(row.alias("_row"), F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.select("_row", "_text", *row_key(F.col("_key"), F.coalesce("_text", F.lit(""))))

    def cut(texts: pa.Array, runs: pa.Array) -> pa.Array:
        left = []
        for value, covered in zip(texts, runs):
            if not covered.is_valid or not value.is_valid:
                left.append(value.as_py())
                continue
            data = np.frombuffer(value.as_buffer(), np.uint8)
            left.append(data[~_covered(len(data), covered.as_py(), length)].tobytes().decode("utf-8", "ignore"))
        return pa.array(left, pa.string())

    done = _named_runs(rows, stage, length).select("_row", text_function(cut, "string")(F.col("_text"), F.col("_runs")).alias("_left"))
    return done.select(*(F.col("_left").alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns))
