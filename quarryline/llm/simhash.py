"""SimHash near-duplicates by ball hashing that meets in the middle.

Two fingerprints at two or fewer differing bits share a variant: each emits all variants within half that
distance, itself and one flipped bit. A variant is shared by at most 65 fingerprints. Three differing
bits are brought down to two by leaving a block of bits out: three blocks, and the variants of the bits that
remain. Those buckets are only searched where they hold fingerprints that are not yet connected, so a large
group of near copies costs no pairs. Equal fingerprints are one from the start.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.llm import blocks as B
from quarryline.llm.components import components
from quarryline.llm.rows import map_batches, row_key

SHINGLE = 3
SEED = 42
BITS = 64
AT_ONCE = 1 << 15
BLOCKS = ((0, 21), (21, 42), (42, 64))


def _majority(hashes: np.ndarray) -> int:
    """A fingerprint whose bits are set in more than half of the hashes."""
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), AT_ONCE):
        part = hashes[first : first + AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a whole text as a signed long; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    digest = xxhash.xxh64_intdigest
    count = len(words) - size + 1
    spans = zip(starts[:count].tolist(), ends[size - 1 :].tolist())
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, count)
    value = _majority(hashes)
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Rows with their fingerprint ``fp``; null texts count as empty."""

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text))
        return {"fp": pa.array([fingerprint(t.as_py()) for t in texts], pa.int64())}

    return map_batches(docs, work, "fp long", keep)


def _flips(value: Column, bits: list[int]) -> Column:
    """The value and all that differ from it in one of the bits."""
    signed = [b - (1 << 64) if b >> 63 else b for b in (1 << i for i in bits)]
    return F.array(value, *(value.bitwiseXOR(F.lit(b).cast("long")) for b in signed))


def _masked(value: Column) -> Column:
    """For each block of bits: the variants of the other bits, keyed by block."""
    parts = []
    for number, (low, high) in enumerate(BLOCKS):
        mask = ((1 << 64) - 1) ^ ((1 << high) - (1 << low))
        rest = value.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long"))
        parts.append(_keyed(_flips(rest, [i for i in range(BITS) if not low <= i < high]), number))
    return F.concat(*parts)


def _keyed(variants: Column, number: int) -> Column:
    return F.transform(variants, lambda v: F.xxhash64(v, F.lit(number)))


def near_links(fps: DataFrame, stage) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` at two or fewer bits."""
    variants = fps.select("fp", F.explode(_flips(F.col("fp"), list(range(BITS)))).alias("variant"))
    hub = F.min("fp").over(Window.partitionBy("variant"))
    return stage(variants.select(F.col("fp").alias("a"), hub.alias("b")).where("a <> b").distinct(), "near-links")


def far_links(labelled: DataFrame, stage) -> DataFrame:
    """Links between labels of fingerprints at exactly three bits; rows ``fp, label``."""
    variants = labelled.select("fp", "label", F.explode(_masked(F.col("fp"))).alias("key"))
    same = Window.partitionBy("key")
    mixed = variants.withColumn("_low", F.min("label").over(same)).withColumn("_high", F.max("label").over(same))
    mixed = stage(mixed.where("_low <> _high").select("key", "fp", "label"), "far-candidates")
    other = mixed.select(F.col("key").alias("_key"), F.col("fp").alias("_fp"), F.col("label").alias("_label"))
    close = (F.col("label") < F.col("_label")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= 3)
    return mixed.join(other, (F.col("key") == F.col("_key")) & close).select(F.col("label").alias("a"), F.col("_label").alias("b")).distinct()


def classes(fps: DataFrame, stage) -> DataFrame:
    """Rows ``fp, label``: each distinct fingerprint with the least one it is connected to."""
    fps = stage(fps.select("fp").distinct(), "fingerprints")
    first = _label(fps.withColumn("label", F.col("fp")), components(near_links(fps, stage), stage), stage)
    return _label(first, components(far_links(first, stage), stage), stage)


def _label(labelled: DataFrame, least: DataFrame, stage) -> DataFrame:
    found = labelled.join(least, F.col("label") == F.col("a"), "left")
    return stage(found.select("fp", F.coalesce("b", "label").alias("label")), "labels")


def near_duplicates(docs: DataFrame, stage, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: id, fingerprint in hexadecimal and the least id of its component.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Repeated rows stay
    repeated. A null id takes part in links but is no component's name unless all its members have none.
    """
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = stage(fingerprints(rows, "_text", ["_key"]), "simhash")
    lowest = rows.groupBy("fp").agg(F.min("_key").alias("_low"))
    labelled = classes(lowest, stage)
    named = labelled.join(lowest, "fp").groupBy("label").agg(F.min("_low").alias("component_id"))
    found = stage(labelled.join(named, "label").select(F.col("fp").alias("_fp"), "component_id"), "named")
    hexadecimal = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(found, F.col("fp") == F.col("_fp")).select(F.col("_key").alias(key), hexadecimal.alias("fingerprint"), "component_id")


WORDS_IN_SHINGLE = 5
SAMPLE_DOCS, COMMON, MOST_COMMON = 8_192, 3, 1 << 18
FILTER_BITS = 26
FEW = 64
ODD = 8


def _shingles(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """For each block of texts the set of hashed five-word shingles of each text, in rising order.

    A shorter text has one shingle of all its words; a text without words has none.
    """
    for block in B.blocks(texts):
        start, end, row = B.words(block)
        word = B.Hasher(B.code(B.lower(block.data))).of(start, end)
        cuts = np.searchsorted(row, np.arange(block.rows + 1))
        mine = (word[a:b] for a, b in zip(cuts, cuts[1:]))
        yield [np.unique(B.Hasher(w).windows(min(WORDS_IN_SHINGLE, len(w)))) if len(w) else w for w in mine]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(B.concat(parts, np.uint64).view(np.int64)))


def _node(shingles: np.ndarray) -> int:
    """A number for a set of shingles; copies have the same one."""
    with np.errstate(over="ignore"):
        return int(B.mix(np.array([B.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))])).view(np.int64)[0])


def _odd(sets: list[np.ndarray]) -> np.ndarray:
    """For each set, which of ``ODD`` longs' bits are hit by an odd number of its members.

    Two sets differ in at least as many members as bits, so these bits can rule a link out but never a true one.
    """
    found = np.zeros((len(sets), ODD * BITS), np.uint8)
    for i, s in enumerate(sets):
        found[i] = np.bincount((B.mix(s) % np.uint64(ODD * BITS)).astype(np.int64), minlength=ODD * BITS) & 1
    return np.packbits(found, axis=1, bitorder="little").view(np.int64).reshape(len(sets), ODD)


def _prefix(shingles: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first fifth of a set and one more, in an order that all sets share: common shingles come last.

    Of two sets with a similarity of 0.8 or more, each has at most a fifth of its members outside the other, so
    the first member they share is in both prefixes, whatever the order is.
    """
    order = shingles >> np.uint64(1)
    if len(common):
        place = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        order = np.where(common[place] == shingles, rank[place], order)
    return shingles[np.argsort(order, kind="stable")[: len(shingles) // 5 + 1]]


def _common(read: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample of texts often has, in rising order, with their place behind all others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sets in _shingles(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(B.concat(sets, np.uint64).view(np.int64))], ["shingle"])

    part = max(1, -(-read.count() // SAMPLE_DOCS))
    counts = read.where(F.pmod("_k1", F.lit(part)) == 0).select("_text").mapInArrow(work, "shingle long").groupBy("shingle").count()
    rows = counts.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "shingle").limit(MOST_COMMON).collect()  # at most MOST_COMMON
    found = np.array([r["shingle"] for r in reversed(rows)], np.int64).view(np.uint64)
    by_value = np.argsort(found)
    return found[by_value], by_value.astype(np.uint64) + np.uint64(1 << 63)


def _drawn(read: DataFrame) -> DataFrame:
    """For each row its node, the size of its set and its prefix; a task gives a node's prefix once."""
    shared = read.sparkSession.sparkContext.broadcast(_common(read))
    names = [f"m{i}" for i in range(ODD)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            first = 0
            for sets in _shingles(batch.column(3)):
                node, prefixes = [_node(s) for s in sets], []
                for n, s in zip(node, sets):
                    prefixes.append(s[:0] if n in seen or not len(s) else _prefix(s, *shared.value))
                    seen.add(n)
                kept = batch.slice(first, len(sets))
                found = [pa.array(node, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists(prefixes)]
                found += [pa.array(column) for column in _odd(sets).T]
                yield pa.RecordBatch.from_arrays([*kept.columns[:3], *found], [*kept.schema.names[:3], "node", "size", "prefix", *names])
                first += len(sets)
            batch = kept = None  # else it stays beside the next one

    kind = read.schema["_key"].dataType.simpleString()
    schema = f"_k1 long, _k2 long, _key {kind}, node long, size long, prefix array<long>, " + ", ".join(f"{n} long" for n in names)
    return read.select("_k1", "_k2", "_key", "_text").mapInArrow(work, schema)


def _sets(read: DataFrame, wanted: DataFrame, stage) -> DataFrame:
    """The whole shingle sets of the nodes of ``wanted``; a bit table of fixed size keeps most others from being moved."""
    cells = wanted.select(F.col("node").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("cell")).distinct().toPandas()["cell"]
    table = np.zeros(1 << FILTER_BITS, bool)
    table[cells.to_numpy(np.int64)] = True
    shared = read.sparkSession.sparkContext.broadcast(np.packbits(table, bitorder="little"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for sets in _shingles(batch.column(0)):
                found = []
                for s in sets:
                    n = _node(s)
                    cell = n & ((1 << FILTER_BITS) - 1)
                    if n not in seen and shared.value[cell >> 3] >> (cell & 7) & 1:
                        seen.add(n)
                        found.append((n, s))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), _lists([s for _, s in found])], ["node", "shingles"])
            batch = None

    sets = read.select("_text").mapInArrow(work, "node long, shingles array<long>")
    return stage(sets.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "shingle-sets")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs ``node, hub`` with whether the similarity of their whole sets is 0.8 or more."""
    a, b = (sets.select(F.col("node").alias(f"_{s}"), F.col("shingles").alias(f"_s{s}")) for s in "ab")
    joined = pairs.join(a, F.col("node") == F.col("_a")).join(b, F.col("hub") == F.col("_b"))
    common = F.size(F.array_intersect("_sa", "_sb"))
    return joined.select("node", "hub", (9 * common >= 4 * (F.size("_sa") + F.size("_sb"))).alias("ok"))


def _possible(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs whose bits of ``_odd`` do not rule out a similarity of 0.8."""
    a, b = (bits.select(*(F.col(c).alias(f"{s}_{c}") for c in bits.columns)) for s in "ab")
    joined = pairs.join(a, F.col("node") == F.col("a_node")).join(b, F.col("hub") == F.col("b_node"))
    differ = sum((F.bit_count(F.col(f"a_m{i}").bitwiseXOR(F.col(f"b_m{i}"))) for i in range(ODD)), F.lit(0))
    return joined.where(F.col("a_size") + F.col("b_size") >= 9 * differ).select("node", "hub")


def similar_groups(rows: DataFrame, bits: DataFrame, read: DataFrame, stage) -> DataFrame:
    """Each node that is not the least of its group with the least one, as ``a, b``.

    ``rows`` are ``key, node, size, at`` (the place in the prefix); ``bits`` those of ``_odd`` by node. Two nodes of a
    bucket (one key) are compared unless their sizes, bits, or members left behind the key, were it the first they share,
    rule a link out, or verified links connect them already. In each round the least nodes of a large bucket are compared with all others in it and only then
    leave it: one node at first, so that a large group of copies becomes one label, later more and more of them.
    A bucket whose nodes all have one label is done; small ones are compared fully from the second round on.
    """
    same = Window.partitionBy("key")
    links: list[DataFrame] = []
    checked: list[DataFrame] = []
    least, leaders, few = None, 1, 2
    names = ["size", "at"]
    both = F.col("size") + F.col("_size")
    fits = 5 * F.least("size", "_size") >= 4 * F.greatest("size", "_size")
    fits &= 9 * F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at")) >= 4 * both
    unlike = (F.col("key") == F.col("_key")) & (F.col("node") > F.col("hub")) & (F.col("label") != F.col("_label")) & fits
    while True:
        label = F.coalesce("b", "node") if least is not None else F.col("node")
        named = rows.join(least, F.col("node") == F.col("a"), "left") if least is not None else rows
        named = named.select("key", "node", *names, label.alias("label"))
        named = named.withColumn("_n", F.count("*").over(same)).withColumn("_low", F.min("label").over(same)).withColumn("_high", F.max("label").over(same))
        named = named.where("_low <> _high").withColumn("_place", F.row_number().over(same.orderBy("node")))
        named = stage(named.drop("_low", "_high"), "mixed-buckets")
        if named.isEmpty():
            break
        heads = named.where((F.col("_place") <= leaders) | (F.col("_n") <= few))
        heads = heads.select("key", F.col("node").alias("hub"), *names, "label").withColumnsRenamed({n: f"_{n}" for n in ("key", "label", *names)})
        pairs = named.join(heads, unlike).select("node", "hub").distinct()
        for known in checked:
            pairs = pairs.join(known, ["node", "hub"], "left_anti")
        pairs = stage(_possible(pairs, bits), "pairs")
        wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct()
        found = stage(_checked(pairs, _sets(read, wanted, stage)), "checked")
        links.append(found.where("ok").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        checked.append(found.where("not ok").select("node", "hub"))
        least = components(reduce(DataFrame.unionByName, links), stage)
        rows = named.where((F.col("_n") > few) & (F.col("_place") > leaders)).select("key", "node", *names)
        leaders, few = 8 * leaders, FEW
    return least if least is not None else rows.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)


def keep_least(docs: DataFrame, stage, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document with the least id of each component of fingerprints, in the columns it came with.

    Fingerprints link at three or fewer differing bits, as in :func:`near_duplicates`. Null, empty and blank texts have
    fingerprint zero and are copies of each other. Of rows equal in id and text one stays; a null id is least.
    """
    rows = _named(docs, text, key)
    read = rows.select("_k1", "_k2", F.col(f"_row.`{key}`").alias("_key"), F.col(f"_row.`{text}`").cast("string").alias("_text"))
    marked = stage(fingerprints(read, "_text", ["_k1", "_k2", "_key"]), "simhash")
    lowest = marked.groupBy("fp").agg(F.min(F.struct("_key", "_k1", "_k2")).alias("first"))
    labelled = classes(lowest, stage)
    return _chosen(rows, labelled.join(lowest, "fp").groupBy("label").agg(F.min("first").alias("f")), stage)


def _named(docs: DataFrame, text: str, key: str) -> DataFrame:
    """Each row as one struct ``_row`` beside the two longs that name it."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    return docs.select(row, *row_key(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))))


def _chosen(rows: DataFrame, firsts: DataFrame, stage) -> DataFrame:
    """The rows that ``f`` of each group names, one of each."""
    chosen = stage(firsts.select(F.col("f._k1").alias("_c1"), F.col("f._k2").alias("_c2")).distinct(), "chosen")
    stays = rows.join(chosen, (F.col("_k1") == F.col("_c1")) & (F.col("_k2") == F.col("_c2")), "left_semi")
    return stays.dropDuplicates(["_k1", "_k2"]).select("_row.*")


def keep_one(docs: DataFrame, stage, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The document with the least id of each group of near copies, in the columns it came with.

    Near copies share five-word shingles at a similarity of 0.8 or more; links between them make groups. Candidates
    share a shingle of their prefixes, which no such pair misses, and the whole sets decide, up to collisions of
    64-bit hashes. Texts without words are copies of each other. Of rows equal in id and text one stays; a null id is least.
    """
    rows = _named(docs, text, key)
    read = rows.select("_k1", "_k2", F.col(f"_row.`{key}`").alias("_key"), F.col(f"_row.`{text}`").cast("string").alias("_text"))
    bits = ["size", *(f"m{i}" for i in range(ODD))]
    drawn = stage(_drawn(read), "prefixes")
    nodes = stage(drawn.groupBy("node").agg(F.min(F.struct("_key", "_k1", "_k2")).alias("first"), *(F.min(n).alias(n) for n in bits)), "shingle-nodes")
    keys = drawn.select("node", "size", F.posexplode("prefix").alias("at", "key")).repartition("key").dropDuplicates(["key", "node"])
    shared = stage(keys.withColumn("_n", F.count("*").over(Window.partitionBy("key"))).where("_n > 1").drop("_n"), "shared-shingles")
    least = similar_groups(shared, nodes.select("node", *bits), read, stage)
    named = nodes.select("node", "first").join(least, F.col("node") == F.col("a"), "left").withColumn("group", F.coalesce("b", "node"))
    return _chosen(rows, named.groupBy("group").agg(F.min("first").alias("f")), stage)
