"""Hard-negative mining with rotated one-bit codes.

A vector of scaled integers is rotated (signs and a Hadamard transform, so any direction is spread over all places) and becomes its
signs, a one-bit code. Beside the code stands its alignment, the cosine between it and what it encodes, which gives the code
its best length. What it leaves over is rotated again and encoded the same way, a few levels deep; the norm of the last rest is
stored too. An anchor is turned through the same rotations and cut into bit planes, so that its inner product with a code is a
sum of popcounts. What all rests can add to the estimate is bounded by the Cauchy-Schwarz inequality: every score lies in an
interval that never fails. A row whose interval cannot reach an anchor's wanted scores, or not its best found so far, is done with;
the others get their integer score.

Anchors meet rows in blocks: all rows of a block against all anchors of another, one task each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: One-bit codes per vector, each of which leaves about 0.6 of the length of what it encodes; bit planes per anchor.
LEVELS, PLANES = 8, 8
#: Bytes of integer components in a block of rows and in a block of anchors.
BLOCK_BYTES = 16 << 20
#: Small tables are cut into smaller blocks, down to this many rows, while there are idle tasks.
SMALL_BLOCK = 2_048
#: Rows compared at once: few at first, as all of them get a score until every anchor has its first finds.
TILE_ANCHORS, FIRST_TILE, TILE_ROWS = 64, 128, 2_048
#: Integer components gathered at once for scoring.
SCORED_AT_ONCE = 1 << 21
SCALE = 256
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these hundredths of the positive's.
LOW, HIGH = 30, 90
#: Scaled components are cut to this size, and scores to the other: what follows multiplies scores by 100.
COMPONENT_LIMIT, SCORE_LIMIT = 1 << 31, 1 << 56
NO_ID = np.iinfo(np.int64).max

CODED = "_id long, _label long, _own long, _ints array<long>, _codes binary, _alignments array<double>, _norms array<double>"


def _padded(ints: np.ndarray) -> np.ndarray:
    """Rows with zeros up to a power of two of at least 64 places."""
    width = max(64, 1 << (ints.shape[1] - 1).bit_length()) if ints.shape[1] else 64
    out = np.zeros((len(ints), width))
    out[:, : ints.shape[1]] = ints
    return out


def _rotated(values: np.ndarray, level: int) -> np.ndarray:
    """Rows times the orthogonal matrix of a level."""
    n, width = values.shape
    out = values * np.random.default_rng((width, level)).choice((-1.0, 1.0), width)
    half = 1
    while half < width:
        pairs = out.reshape(n, -1, 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, width)
        half *= 2
    return out / np.sqrt(width)


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, axis=1, bitorder="little").view(np.uint64)


def encode(ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (row, level, 64-bit word), alignments (row, level) and norms (row, level + 1) of integer vectors.

    A norm is that of what the level encodes; the last one is the rest after all levels.
    """
    rest = _padded(ints)
    width = rest.shape[1]
    codes = np.zeros((len(rest), LEVELS, width // 64), np.uint64)
    alignments, norms = np.zeros((len(rest), LEVELS)), np.zeros((len(rest), LEVELS + 1))
    for level in range(LEVELS):
        rest = _rotated(rest, level)
        norms[:, level] = np.linalg.norm(rest, axis=1)
        positive = rest >= 0
        codes[:, level] = _bits(positive)
        length = np.abs(rest).sum(axis=1) / width
        alignments[:, level] = np.divide(length * np.sqrt(width), norms[:, level], out=np.zeros(len(rest)), where=norms[:, level] > 0)
        rest -= np.where(positive, length[:, None], -length[:, None])
    norms[:, LEVELS] = np.linalg.norm(rest, axis=1)
    return codes, alignments, norms


@dataclass
class Planes:
    """Anchors in the basis of every level: signs of weight 1, 2, 4, ... steps, and the norm of what these leave over."""

    bits: np.ndarray
    step: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, ints: np.ndarray) -> Planes:
        turned = _padded(ints)
        n, width = turned.shape
        bits, step, rest = np.zeros((n, LEVELS, PLANES, width // 64), np.uint64), np.zeros((n, LEVELS)), np.zeros((n, LEVELS))
        top = (1 << PLANES) - 1
        for level in range(LEVELS):
            turned = _rotated(turned, level)
            step[:, level] = np.abs(turned).max(axis=1, initial=0) / top
            scaled = np.divide(turned, step[:, level][:, None], out=np.zeros((n, width)), where=step[:, level][:, None] > 0)
            number = np.clip(np.rint((scaled + top) / 2), 0, top).astype(np.int64)
            rest[:, level] = np.linalg.norm(turned - step[:, level][:, None] * (2 * number - top), axis=1)
            for plane in range(PLANES):
                bits[:, level, plane] = _bits((number >> plane) & 1 > 0)
        return cls(bits, step, rest)

    def __getitem__(self, which) -> Planes:
        return Planes(self.bits[which], self.step[which], self.rest[which])


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of both, one by one; exact at any size and then cut to the limit."""
    if left.shape[1] * float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) < 2**53:
        return np.einsum("ij,ij->i", left.astype(np.float64), right.astype(np.float64)).astype(np.int64)
    exact = (left.astype(object) * right.astype(object)).sum(axis=1)
    return np.array([max(-SCORE_LIMIT, min(SCORE_LIMIT, x)) for x in exact], np.int64)


@dataclass
class Coded:
    """A block of coded vectors."""

    row: np.ndarray
    id: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    codes: np.ndarray
    lengths: np.ndarray
    norm: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, width: int) -> Coded:
        column = lambda name: table.column(name).combine_chunks()
        n = len(table)
        codes = np.frombuffer(b"".join(column("_codes").to_pylist()), np.uint64).reshape(n, LEVELS, -1) if n else np.zeros((0, LEVELS, 1), np.uint64)
        flat = lambda name, size: column(name).flatten().to_numpy(zero_copy_only=False).reshape(n, size)
        alignments, norms = flat("_alignments", LEVELS), flat("_norms", LEVELS + 1)
        lengths = alignments * norms[:, :LEVELS] / np.sqrt(64 * codes.shape[2])
        plain = lambda name: column(name).to_numpy(zero_copy_only=False)
        return cls(plain("_row"), plain("_id"), plain("_label"), flat("_ints", width), codes, lengths, norms[:, 0], norms[:, LEVELS])

    def __getitem__(self, which) -> Coded:
        return Coded(*(getattr(self, f)[which] for f in self.__dataclass_fields__))

    def __len__(self) -> int:
        return len(self.row)


def intervals(anchors: Coded, planes: Planes, rows: Coded) -> tuple[np.ndarray, np.ndarray]:
    """Estimate of every score and how far at most the score is from it."""
    words = rows.codes.shape[2]
    estimate = np.zeros((len(anchors), len(rows)))
    for level in range(LEVELS):
        unlike = np.zeros(estimate.shape, np.int32)
        for plane in range(PLANES):
            for w in range(words):
                unlike += np.bitwise_count(planes.bits[:, level, plane, w][:, None] ^ rows.codes[:, level, w][None, :]).astype(np.int32) << plane
        like = ((1 << PLANES) - 1) * 64 * words - 2 * unlike
        estimate += planes.step[:, level][:, None] * like * rows.lengths[:, level][None, :]
    # <a, x> is the sum over levels of <a, code> times its length, and <a, rest>; <a, code> is off by <what the planes leave, code>.
    reach = np.outer(anchors.norm, rows.rest) + planes.rest @ (rows.lengths * np.sqrt(64 * words)).T
    return estimate, reach + 1e-9 * np.outer(anchors.norm, rows.norm) + 1e-6


class _Best:
    """The best ``k`` rows found for every anchor and band of scores."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.least = low.copy()  # scores below can no longer enter

    def add(self, anchor: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        bands = self.low.shape[1]
        inside = (score[:, None] >= self.least[anchor]) & (score[:, None] <= self.high[anchor])
        which, band = np.nonzero(inside)
        slot = np.concatenate((self.slot, anchor[which] * bands + band))
        score, ids = np.concatenate((self.score, score[which])), np.concatenate((self.id, ids[which]))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot, side="left")
        keep = place < self.k
        self.slot, self.score, self.id, place = slot[keep], score[keep], ids[keep], place[keep]
        full = place == self.k - 1
        self.least.reshape(-1)[self.slot[full]] = self.score[full]


def search(anchors: Coded, rows: Coded, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[_Best, int]:
    """The best rows per anchor and band, among those of the same or of other labels; how many scores that took."""
    best, scored, first, size, planes = _Best(low, high, k), 0, 0, FIRST_TILE, Planes.of(anchors.ints)
    pairs = max(1, SCORED_AT_ONCE // max(1, rows.ints.shape[1]))
    while first < len(rows):
        tile = rows[first : first + size]
        first, size = first + size, min(2 * size, TILE_ROWS)
        for at in range(0, len(anchors), TILE_ANCHORS):
            some = slice(at, at + TILE_ANCHORS)
            part = anchors[some]
            wanted = (part.label[:, None] == tile.label[None, :]) == same
            if same:  # only rows of the anchors' labels need an interval
                used = np.flatnonzero(wanted.any(axis=0))
                wanted, near = wanted[:, used], tile[used]
            else:
                near = tile
            if not len(near):
                continue
            estimate, reach = intervals(part, planes[some], near)
            most, open_ = estimate + reach, np.zeros(estimate.shape, bool)
            estimate -= reach
            for band in range(low.shape[1]):
                open_ |= (most >= best.least[some, band][:, None]) & (estimate <= best.high[some, band][:, None])
            a, r = np.nonzero(open_ & wanted)
            scored += len(a)
            for cut in range(0, len(a), pairs):
                x, y = a[cut : cut + pairs], r[cut : cut + pairs]
                best.add(x + at, scores(part.ints[x], near.ints[y]), near.id[y])
    return best, scored


def coded_rows(vectors: DataFrame, stage, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """The rows that take part, coded and written; and how long the longest vector is.

    Left out are rows with a null label or vector or any null or non-finite component. A row without an id takes part as a
    candidate; among equal scores it comes last. Shorter vectors count as ending in zeros, and scaled components beyond 2**31 as that.
    """
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("_id"), F.col(f"`{label}`").cast("long").alias("_label"), F.col(f"`{embedding}`").cast("array<double>").alias("_v"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("_label").isNotNull() & F.col("_v").isNotNull() & finite)
    v = v.withColumn("_label", F.when(F.col("_id") % SHIFT_EVERY == 0, (F.col("_label") + 1) % LABELS).otherwise(F.col("_label")))
    width = v.agg(F.coalesce(F.max(F.size("_v")), F.lit(0)).alias("n")).first()["n"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("_v"), batch.num_rows
            if not n:
                continue
            values = np.zeros((n, width))
            sizes = np.diff(lists.offsets.to_numpy())
            values[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            ints = np.clip(np.floor(np.clip(values, -(2.0**40), 2.0**40) * SCALE), -COMPONENT_LIMIT, COMPONENT_LIMIT).astype(np.int64)
            codes, alignments, norms = encode(ints)
            lists = lambda a: pa.ListArray.from_arrays(np.arange(0, a.size + 1, max(1, a.shape[1]), dtype=np.int32) if a.shape[1] else np.zeros(n + 1, np.int32), a.reshape(-1))
            ids = batch.column("_id").fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("_label"), pa.array(scores(ints, ints)), lists(ints), pa.array([c.tobytes() for c in codes], pa.binary()), lists(alignments), lists(norms)],
                ["_id", "_label", "_own", "_ints", "_codes", "_alignments", "_norms"],
            )

    coded = v.mapInArrow(code, CODED).withColumn("_row", F.monotonically_increasing_id())
    return stage(coded, "coded-vectors"), width


def _blocks(rows: DataFrame, width: int, slots: int = 1) -> int:
    n = rows.count()
    return max(1, -(-n // max(64, BLOCK_BYTES // (8 * max(64, width)))), min(slots, n // SMALL_BLOCK))


def _block(row: str, count: int) -> Column:
    return F.pmod(F.xxhash64(row), F.lit(count)).cast("long")


def _each(count: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))


def _met(anchors: DataFrame, rows: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """Per anchor and band, the best of each block of rows: columns ``_row``, ``band``, ``score``, ``found``, ``scored``.

    ``anchors`` has arrays ``_low`` and ``_high``, the bands. A block is a hash of the row's number, so blocks are of
    about one size whatever ids and labels repeat.
    """
    many, few = _blocks(rows, width, rows.sparkSession.sparkContext.defaultParallelism), _blocks(anchors, width)
    dealt = rows.select("*", _block("_row", many).alias("_j"), _each(few).alias("_i"))
    asking = anchors.select("*", _block("_row", few).alias("_i"), _each(many).alias("_j"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["_row", "band", "score", "found", "scored"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        if not len(left) or not len(right):
            return pa.table([pa.array([], t) for t in types], names)
        band = lambda name: left.column(name).combine_chunks().flatten().to_numpy().reshape(len(left), -1)
        low, high = band("_low").astype(np.int64), band("_high").astype(np.int64)
        asked = Coded.of(left, width)
        best, scored = search(asked, Coded.of(right, width), low, high, k, same)
        cost = np.zeros(len(best.slot), np.int64)
        cost[:1] = scored  # the block's number of integer scores, told once
        row, band_of = np.divmod(best.slot, low.shape[1])
        return pa.table([pa.array(asked.row[row]), pa.array(band_of.astype(np.int32)), pa.array(best.score), pa.array(best.id), pa.array(cost)], names)

    tasks = min(many * few, 1 << 15)
    return (
        asking.repartition(tasks, "_i", "_j").groupBy("_i", "_j").cogroup(dealt.repartition(tasks, "_i", "_j").groupBy("_i", "_j"))
        .applyInArrow(work, "_row long, band int, score long, found long, scored long")
    )


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, stage, anchor_every: int = ANCHOR_EVERY) -> DataFrame:
    """Hard negatives of every anchor and positive, ranked; anchors are the ids divisible by ``anchor_every``.

    Scores are exact integer inner products. An anchor's own row is no positive of it, but another row of the same id is. Rows
    repeated as a whole are anchors, positives and negatives each for itself. Anchors without rows of their label,
    and positives without a negative in the band, give no rows; so does an empty table.
    """
    rows, width = coded_rows(vectors, stage)
    asking = stage(rows.where((F.col("_id") % anchor_every == 0) & (F.col("_id") != NO_ID)).withColumns({"_low": F.array(F.lit(-SCORE_LIMIT)), "_high": F.array(F.lit(SCORE_LIMIT))}), "anchors")
    # One more than wanted, for the anchor itself, which is one of the entries with its id and own score if it is among them.
    close = _first(_met(asking, rows, width, POSITIVES + 1, True), ["_row"], POSITIVES + 1)
    close = close.join(asking.select("_row", F.col("_id").alias("anchor_id"), "_own"), "_row")
    itself = (F.col("found") == F.col("anchor_id")) & (F.col("score") == F.col("_own"))
    self_rank = F.min(F.when(itself, F.col("rank"))).over(Window.partitionBy("_row"))
    positives = close.withColumn("_self", self_rank).where("_self is null or rank <> _self").withColumn("band", F.col("rank") - F.when(F.col("rank") > F.col("_self"), 1).otherwise(0) - 1)
    positives = stage(positives.where(F.col("band") < POSITIVES).select("_row", "anchor_id", "band", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Bands of an anchor with fewer positives are empty ones.
    banded = positives.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("band", "positive_score"))).alias("_p"))
    score = lambda i: F.element_at("_p", F.lit(i))
    low = F.array(*(F.coalesce(_ceil_div(LOW * score(i), 100), F.lit(1)) for i in range(POSITIVES)))
    high = F.array(*(F.coalesce(_floor_div(HIGH * score(i), 100), F.lit(0)) for i in range(POSITIVES)))
    asking = stage(asking.drop("_low", "_high").join(banded, "_row").select("*", low.alias("_low"), high.alias("_high")).drop("_p"), "anchors")
    negatives = _first(_met(asking, rows, width, NEGATIVES, False), ["_row", "band"], NEGATIVES)
    return (
        negatives.join(positives, ["_row", "band"])
        .select("anchor_id", _id("positive_id"), "rank", _id("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def _id(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def _floor_div(value: Column, by: int) -> Column:
    return F.call_function("div", value - F.pmod(value, F.lit(by)), F.lit(by))


def _ceil_div(value: Column, by: int) -> Column:
    return -_floor_div(-value, by)


def oracle_sql() -> str:
    """The same rows for vectors of one length and ids of their own, every score computed."""
    return f"""
    WITH good AS (
        SELECT vec_id, CASE WHEN vec_id % {SHIFT_EVERY} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
            list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
        FROM good a JOIN good r ON a.vec_id % {ANCHOR_EVERY} = 0 AND a.vec_id <> r.vec_id),
    positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
    SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id)
    WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
    QUALIFY row_number() OVER w <= {NEGATIVES}"""
