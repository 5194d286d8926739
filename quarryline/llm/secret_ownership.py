"""Secret scans with corpus-wide ownership frequency.

Every text is searched for three base kinds of secrets, which always count, and for further candidates: keys of known issuers,
passwords in addresses, private keys, and runs of letters and digits that look drawn at random. Only hashes of the values
leave the text. Over the whole corpus each hash gets the number of distinct repositories and owners that hold it. A
value that many owners copy is an example; one that stays with its owner and looks random is taken for live. Live
candidates are added to the base spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.rows import map_batches
from quarryline.operators.lookup import lookup

#: A value is specific to its owner with at most so many owners and repositories: the owner and one mirror.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4

# The base kinds, their least lengths, and the forms of further candidates, in the order in which they count.
BASE = {
    "assign": (re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 8),
    "access": (re.compile(r"(AKIA[A-Z0-9]+)"), 16),
    "hex": (re.compile(r"([0-9a-f]{32,})"), 32),
}
MORE = {
    "issued": re.compile(
        r"\b(gh[pousr]_[A-Za-z0-9]{30,}|glpat-[A-Za-z0-9_-]{20,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"
        r"|AIza[A-Za-z0-9_-]{35,}|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
    ),
    "login": re.compile(r"://[^\s/:@?#]+:([^\s/:@?#]{6,})@"),
    "private": re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z ]{0,40}PRIVATE KEY-----"),
    "opaque": re.compile(r"(?<![A-Za-z0-9+/_=-])([A-Za-z0-9+/_=-]{20,})"),
}
KINDS = [*BASE, *MORE]
PLACEHOLDER = re.compile(r"(?i)example|sample|placeholder|changeme|your|dummy|x{4}|0{6}|12345678|abcdef")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")
#: Texts without a match of this hold no candidate; it only saves looking at them one by one.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_=-]{20}|xox|://[^\s/:@?#]+:|-----BEGIN|eyJ"

_CLASS = bytes(1 if 48 <= c < 58 else 2 if 65 <= c < 91 else 3 if 97 <= c < 123 else 0 for c in range(128))
SPAN = "struct<kind:int,start:long,end:long,hash:string,random:boolean>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]))


def looks_random(value: str) -> bool:
    """Does a value look drawn at random: letters and digits that change often, no placeholder, no UUID?"""
    if PLACEHOLDER.search(value) or UUID.fullmatch(value):
        return False
    letters = [c for c in value.encode("ascii", "ignore").translate(_CLASS + bytes(128)) if c]
    if len(letters) < 8 or 1 not in letters or len(set(letters)) < 2:
        return False
    changes = sum(x != y for x, y in zip(letters, letters[1:], strict=False))
    counts = Counter(value).values()
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts)
    return 4 * changes >= len(letters) and entropy >= min(3.0, 0.8 * math.log2(len(value)))


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """Kind, start, end and value of every base span and of every further candidate, in no overlap with an earlier kind."""
    found, taken = [], []
    for kind, (pattern, least) in enumerate(BASE.values()):
        for m in pattern.finditer(text):
            if len(m[1]) >= least:
                found.append((kind, m.start(), m.end(), m[1]))
                taken.append((m.start(), m.end()))
    for kind, (name, pattern) in enumerate(MORE.items(), len(BASE)):
        fresh, at, reached = [], 0, 0
        taken.sort()
        for m in pattern.finditer(text):
            while at < len(taken) and taken[at][0] < m.end():
                reached = max(reached, taken[at][1])
                at += 1
            if reached <= m.start() and (name == "private" or looks_random(m[1])):
                fresh.append((kind, m.start(), m.end(), m[1]))
        found += fresh
        taken += [(start, end) for _, start, end, _ in fresh]
    return found


def written(spans) -> str:
    """Spans as ``kind:start:end`` by start, then kind, with commas between."""
    return ",".join(f"{KINDS[k]}:{start}:{end}" for k, start, end in sorted(spans, key=lambda s: (s[1], s[0])))


def candidates(docs: DataFrame, stage, owner: Column, repository: Column) -> DataFrame:
    """Each document's spans, with hashes instead of values, written: ``_row`` numbers the rows.

    A null text is empty; a null owner or repository is one of the name ''. Rows may repeat, and a row needs no id.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id"), name(owner).alias("owner"), name(repository).alias("repository"), F.col("text").cast("string").alias("_text"))

    def find(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = batch.column("_text").fill_null("")
        likely = pc.match_substring_regex(texts, ANY).to_pylist()
        spans, base = [], []
        for row, some in enumerate(likely):
            found = spans_of(texts[row].as_py()) if some else []
            base.append(hashlib.sha256(written(s[:3] for s in found if s[0] < len(BASE)).encode()).hexdigest())
            spans.append([
                {"kind": k, "start": start, "end": end, "hash": hashlib.sha256(value.encode()).hexdigest()[:32], "random": looks_random(value)}
                for k, start, end, value in found
            ])
        return {"base_sha256": pa.array(base, pa.string()), "found": pa.array(spans, _SPAN)}

    mapped = map_batches(texts, find, f"base_sha256 string, found array<{SPAN}>", ["doc_id", "owner", "repository"])
    return stage(mapped.withColumn("_row", F.monotonically_increasing_id()), "secret-candidates")


def ownership(found: DataFrame) -> DataFrame:
    """Per hash: how many places, repositories and owners hold it. A hash that stands everywhere is counted in parts first."""
    places = found.select("owner", "repository", F.explode("found.hash").alias("hash"))
    by_repository = places.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("r"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_places"), F.sum("r").alias("n_repositories"), F.count("*").alias("n_owners"))


def judged(found: DataFrame) -> DataFrame:
    """One row per span with its value's ownership; ``live``: random-looking and specific to its owner; ``base``: always a span."""
    spans = found.select("_row", "doc_id", F.inline("found"))
    live = F.col("random") & (F.col("n_owners") <= MAX_OWNERS) & (F.col("n_repositories") <= MAX_REPOSITORIES)
    return lookup(spans, ownership(found), ["hash"]).withColumns({"live": live, "base": F.col("kind") < len(BASE)})


def scan(docs: DataFrame, stage, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """All candidates of all documents, one row each: place, kind, hash, ownership, ``base`` and ``live``."""
    found = candidates(docs, stage, F.col("source") if owner is None else owner, _repository() if repository is None else repository)
    return judged(found).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)).drop("_row")


def _repository() -> Column:
    """Documents tell a source, taken for the owner; its documents of one language are taken for a repository."""
    return F.concat_ws("/", "source", "lang")


def report(docs: DataFrame, stage, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of the base kinds, a digest of the base spans, and all spans that stay.

    Documents without candidates, and null and empty texts, have zeros and an empty string. An empty table gives no rows. Columns
    other than doc_id, text, source and lang are not looked at.
    """
    found = candidates(docs, stage, F.col("source") if owner is None else owner, _repository() if repository is None else repository)
    kept = judged(found).where("base or live").select("_row", "kind", "start", "end", "live", "base")
    by_row = kept.groupBy("_row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("_s"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"),
        F.count(F.when(~F.col("base"), 1)).alias("n_added"),
    )
    names = F.array(*map(F.lit, KINDS))
    written = F.array_join(F.transform("_s", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    of_kind = lambda k: F.size(F.array_compact(F.transform("found", lambda s: F.when(s["kind"] == k, k))))
    n_base = [of_kind(k).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.join(by_row, "_row", "left").select(
        "doc_id", *n_base, "base_sha256", F.coalesce(written, F.lit("")).alias("spans"), zero("n_added"), zero("n_live"), zero("n_example")
    )
