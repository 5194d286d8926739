"""Language-model scores by deleted interpolation of word n-grams.

The probability of a token mixes its share after the word before it, its share among all tokens, and an equal
share for every known token and one unknown one. The weights depend on how often the word before was seen, in
buckets by powers of two, and are learned by expectation-maximisation on counts of training documents that were
left out of the estimates (one in seven). The final estimates use all training documents.

Texts are dealt into chunks of a few megabytes. A chunk sends its distinct n-grams as sorted, packed hashes, cut
into ranges of hashes; whoever owns a range adds up the counts of all chunks and answers each chunk with
totals in the order it asked in. Ranges grow in number with chunks, so no task holds more than its share,
and there are never more packed rows than n-grams.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import blocks as B

FOLDS, TEST_FOLD, WEIGHT_FOLD = 7, 2, 3
CHUNK_BYTES = 6 << 20
STEPS_PER_NAT = 4
ROUNDS = 60
NOTHING = -(1 << 20)
_START, _END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0xC2B2AE3D27D4EB4F)


def pack(values: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    values = np.ascontiguousarray(values, np.uint64)
    return zlib.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of every token, hash of the token before it, and its row: the words in lower case and then an end."""
    here, before, rows = [], [], []
    for block in B.blocks(texts):
        start, end, row = B.words(block)
        word = B.Hasher(B.code(B.lower(block.data))).of(start, end)
        counts = np.bincount(row, minlength=block.rows)
        last = np.cumsum(counts + 1) - 1
        token = np.empty(len(word) + block.rows, np.uint64)
        is_word = np.ones(len(token), bool)
        is_word[last] = False
        token[is_word], token[last] = word, _END
        context = np.empty_like(token)
        context[1:] = token[:-1]
        context[last - counts] = _START
        here.append(token)
        before.append(context)
        rows.append(np.repeat(np.arange(block.rows), counts + 1) + block.first)
    return B.concat(here, np.uint64), B.concat(before, np.uint64), B.concat(rows, np.int64)


def _pairs(token: np.ndarray, before: np.ndarray) -> np.ndarray:
    return B.mix(before * np.uint64(0x9E3779B97F4A7C15) + token)


def _range_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)


def _cuts(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins among sorted keys, and the end."""
    return np.searchsorted(_range_of(keys, ranges), np.arange(ranges + 1))


def chunked(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, int]:
    """Rows with their chunk, and the number of chunks; documents for the weights have chunks of their own."""
    fold = F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")), F.lit(FOLDS)), F.lit(-1))
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"), fold.alias("_fold"))
    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    many = 1 + size // CHUNK_BYTES
    few = 1 + many // (FOLDS - 1)
    spread = F.xxhash64(F.col("_key").cast("string"), "_text")
    chunk = F.when(F.col("_fold") == WEIGHT_FOLD, many + F.pmod(spread, F.lit(few))).otherwise(F.pmod(spread, F.lit(many)))
    return rows.withColumn("chunk", chunk.cast("int")), many


def _asked(rows: DataFrame, ranges: int) -> DataFrame:
    """For each chunk and range: its distinct words and pairs, and how often training documents hold them."""

    def count(group: pa.Table) -> pa.Table:
        token, before, row = tokens(group.column("_text").combine_chunks())
        learn = group.column("_fold").to_numpy()[row] != TEST_FOLD
        parts = []
        for keys in (token, _pairs(token, before)):
            kinds, back = np.unique(keys, return_inverse=True)
            parts.append((kinds, np.bincount(back, weights=learn, minlength=len(kinds)).astype(np.int64), _cuts(kinds, ranges)))
        chunk = group.column("chunk")[0].as_py()
        begun = int((group.column("_fold").to_numpy() != TEST_FOLD).sum())
        out = []
        for r in range(ranges):
            cells = []
            for kinds, times, cut in parts:
                span = slice(cut[r], cut[r + 1])
                cells += [pack(np.diff(kinds[span], prepend=np.uint64(0))), pack(times[span])]
            out.append((chunk, r, begun if r == 0 else 0, *cells))
        names = ["chunk", "range", "begun", "words", "word_counts", "pairs", "pair_counts"]
        kinds = (pa.int32(), pa.int32(), pa.int64(), *(pa.binary(),) * 4)
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    schema = "chunk int, range int, begun long, words binary, word_counts binary, pairs binary, pair_counts binary"
    return rows.groupBy("chunk").applyInArrow(count, schema)


ANSWER = (
    "chunk int, range int, words binary, words_left binary, pairs binary, pairs_left binary, "
    "tokens long, tokens_left long, kinds long, kinds_left long, begun long, begun_left long"
)


def _answered(asked: DataFrame, many: int) -> DataFrame:
    """For each chunk and range: counts over all training documents, and over those not left out for the weights.

    The last columns hold, once per range, its share of the totals.
    """

    def add(group: pa.Table) -> pa.Table:
        chunks = group.column("chunk").to_pylist()
        outside = np.array([c < many for c in chunks])
        sums = []
        for name, counts in (("words", "word_counts"), ("pairs", "pair_counts")):
            keys = [np.cumsum(unpack(x), dtype=np.uint64) for x in group.column(name).to_pylist()]
            times = [unpack(x).astype(np.int64) for x in group.column(counts).to_pylist()]
            sizes = np.array([len(k) for k in keys])
            kinds, back = np.unique(np.concatenate(keys), return_inverse=True)
            flat = np.concatenate(times)
            whole = np.bincount(back, weights=flat, minlength=len(kinds)).astype(np.int64)
            left = np.bincount(back, weights=flat * np.repeat(outside, sizes), minlength=len(kinds)).astype(np.int64)
            bounds = np.cumsum(np.r_[0, sizes])
            places = [back[a:b] for a, b in zip(bounds, bounds[1:])]
            sums.append((whole, left, places))
        begun = np.array(group.column("begun").to_pylist(), np.int64)
        (whole, left, places), (pair_whole, pair_left, pair_places) = sums
        totals = (whole.sum(), left.sum(), (whole > 0).sum(), (left > 0).sum(), begun.sum(), (begun * outside).sum())
        out = []
        for i, chunk in enumerate(chunks):
            answer = (pack(whole[places[i]]), pack(left[places[i]]), pack(pair_whole[pair_places[i]]), pack(pair_left[pair_places[i]]))
            out.append((chunk, group.column("range")[i].as_py(), *answer, *(int(t) if i == 0 else 0 for t in totals)))
        kinds = (pa.int32(), pa.int32(), *(pa.binary(),) * 4, *(pa.int64(),) * 6)
        names = [f.strip().split()[0] for f in ANSWER.split(",")]
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names)

    return asked.groupBy("range").applyInArrow(add, ANSWER)


def _counted(docs: pa.Table, answers: pa.Table, left: bool) -> tuple[np.ndarray, ...]:
    """Row, count, count of the pair and of the word before, for every token of a chunk."""
    token, before, row = tokens(docs.column("_text").combine_chunks())
    order = np.argsort(answers.column("range").to_numpy())
    found = []
    for name, keys in (("words", token), ("pairs", _pairs(token, before))):
        cells = answers.column(name + "_left" * left).to_pylist()
        counts = np.concatenate([unpack(cells[i]) for i in order]).astype(np.int64)
        kinds, back = np.unique(keys, return_inverse=True)
        found.append((counts[back], kinds, counts))
    (times, kinds, counts), (pair, _, _) = found
    place = np.minimum(np.searchsorted(kinds, before), len(kinds) - 1)
    context = np.where(before == _START, -1, counts[place])  # every word before is a token of the chunk, too
    return row, times, pair, context


def _bucket(context: np.ndarray) -> np.ndarray:
    """Contexts by powers of two of their counts; 0 for unseen ones."""
    return np.ceil(np.log2(context + 1.0)).astype(np.int64)


def _cells(rows: DataFrame, answers: DataFrame, many: int, seen: dict) -> DataFrame:
    """How many left-out tokens have each bucket and probabilities, on a logarithmic grid."""

    def cell(docs: pa.Table, found: pa.Table) -> pa.Table:
        names = ["bucket", "pair", "word", "n"]
        if not docs.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names)
        _, times, pair, context = _counted(docs, found, left=True)
        context = np.where(context < 0, seen["begun_left"], context)
        levels = [_bucket(context)]
        for count, total in ((pair, context), (times, np.full(len(times), seen["tokens_left"]))):
            share = np.round(STEPS_PER_NAT * (np.log(np.maximum(count, 1)) - np.log(np.maximum(total, 1)))).astype(np.int64)
            levels.append(np.where(count > 0, share, NOTHING))
        kinds, n = np.unique(np.stack(levels), axis=1, return_counts=True)
        return pa.table([pa.array(x) for x in (*kinds, n)], names)

    mine, theirs = rows.where(f"chunk >= {many}").groupBy("chunk"), answers.where(f"chunk >= {many}").groupBy("chunk")
    return mine.cogroup(theirs).applyInArrow(cell, "bucket long, pair long, word long, n long")


def learned(cells: list[tuple[int, int, int, int]], kinds: int) -> dict[int, np.ndarray]:
    """Weights of pair, word and equal shares for each bucket, by expectation-maximisation."""
    weights: dict[int, np.ndarray] = {}
    table = np.array(cells, np.int64).reshape(-1, 4)
    for bucket in range(65):
        mine = table[table[:, 0] == bucket]
        parts = np.stack([np.where(mine[:, i] == NOTHING, 0.0, np.exp(mine[:, i] / STEPS_PER_NAT)) for i in (1, 2)] + [np.full(len(mine), 1 / (kinds + 1))])
        weight = np.array([0.4, 0.5, 0.1])
        for _ in range(ROUNDS if len(mine) else 0):
            mixed = weight[:, None] * parts
            mixed *= mine[:, 3] / mixed.sum(axis=0)
            weight = mixed.sum(axis=1) / mine[:, 3].sum()
            weight = np.maximum(weight, 1e-6)
            weight /= weight.sum()
        weights[bucket] = weight
    return weights


def _scored(rows: DataFrame, answers: DataFrame, weights: dict[int, np.ndarray], seen: dict) -> DataFrame:
    kind = rows.schema["_key"].dataType.simpleString()
    table = np.stack([weights[b] for b in range(65)])

    def score(docs: pa.Table, found: pa.Table) -> pa.Table:
        row, times, pair, context = _counted(docs, found, left=False)
        context = np.where(context < 0, seen["begun"], context)
        mix = table[_bucket(context)]
        given = np.where(context > 0, pair / np.maximum(context, 1), 0.0)
        # without a context the share among all tokens takes the place of the share after it
        single = times / max(seen["tokens"], 1)
        chance = mix[:, 0] * np.where(context > 0, given, single) + mix[:, 1] * single + mix[:, 2] / (seen["kinds"] + 1)
        base = np.log10((times + 1.0) / (seen["tokens"] + (seen["kinds"] + 1)))
        size = docs.num_rows
        known = np.bincount(row, weights=times > 0, minlength=size).astype(np.int64)
        sums = [np.bincount(row, weights=x, minlength=size) for x in (base, np.log10(np.maximum(chance, 1e-300)))]
        held = docs.column("_fold").to_numpy() == TEST_FOLD
        arrays = [pa.array(x) for x in (held, np.bincount(row, minlength=size), known, np.full(size, seen["tokens"]), *sums)]
        return pa.table([docs.column("_key"), *arrays], ["_key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"_key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, schema)


def scores(docs: DataFrame, stage, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: whether it is held out, its tokens, and its log10 probabilities.

    Null texts count as empty and hold just the end. A null id is not held out. Repeated rows are
    counted and scored each. Without training documents only equal shares are left; an empty table gives an
    empty one.
    """
    rows, many = chunked(docs, text, key)
    asked = _asked(rows, many)
    answers = stage(_answered(asked, many), "ngram-answers")
    names = ("tokens", "tokens_left", "kinds", "kinds_left", "begun", "begun_left")
    seen = answers.agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names)).first().asDict()
    cells = _cells(rows, answers, many, seen).groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n"))
    weights = learned([tuple(r) for r in cells.collect()], seen["kinds_left"])  # a grid of bounded size
    done = _scored(rows, answers, weights, seen)
    return done.select(F.col("_key").alias(key), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
