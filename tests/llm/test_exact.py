"""Operators beside brute force on small inputs with nulls, empty texts, repeats and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quarryline.llm import catalog, decontaminate, interpolated_lm, main_text, piece_transducer, quality_rules, repeats, sharding, simhash, token_counts, url_reputation
from quarryline.llm.components import components
from quarryline.session import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, _row int, _text string, fp long, node string, n_tokens int"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(80)]
    found = [" ".join(r.choice(vocab) for _ in range(r.randint(0, 120))) for _ in range(60)]
    for i in range(20):
        edited = found[i].split()
        if edited:
            edited[r.randrange(len(edited))] = "NEW"
        found.append(" ".join(edited))
    return [*found, None, "", "  \n\t", "x", "In threen.\n" * 40, "A b" * 3000, found[0], found[0]]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, 1, "x", 2, "y", 3) for i, t in enumerate(texts)]
    rows += [(None, "no id here", "en", 1, None, None, None, None), (0, texts[0], None, 1, "x", 2, "y", 3)]
    return stage(spark.createDataFrame(rows, SCHEMA), "docs")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_quality_counts(spark, docs, empty):
    found = quality_rules.quality_report(docs, stage)
    by_id = {r["doc_id"]: r for r in found.collect()}
    assert found.count() == docs.count() and found.columns[0] == "doc_id"
    for row in docs.collect():
        text = row["text"] or ""
        w, seen, lines = WORD.findall(text), set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                lines += line in seen
                seen.add(line)
        times = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        again = {k for i in range(len(w) - 7) if times[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        got = by_id[row["doc_id"]]
        marks = sum(c in "#*$%&|<>" for c in text)
        assert tuple(got)[1:6] == (len(w), sum(map(len, w)), marks, lines, len(again))
        assert got["base_failed"] == (len(w) < 20 or 100 * len(again) > 30 * len(w))
        assert not (got["base_failed"] and got["kept"])
    assert quality_rules.quality_filter(docs, stage).columns == docs.columns
    assert quality_rules.quality_report(empty, stage).count() == 0


def test_the_band_ends_at_the_outer_fence(spark):
    rows = [("en", 2 + i / 100, False) for i in range(101)] + [("en", x, False) for x in (0.4, 0.8, 4.2, 4.6)]
    measured = spark.createDataFrame(rows, "_lang string, log_perplexity double, base_failed boolean")
    out = quality_rules.judged(measured, quality_rules.bands(measured)).where("not kept").collect()
    assert sorted(r["log_perplexity"] for r in out) == [0.4, 4.6]


def test_kneser_ney_is_a_distribution(docs):
    model = quality_rules.fit(quality_rules.packed(docs, "text"))
    chances = [math.fsum(math.e ** x for x in row) for row in model.dense().reshape(-1, quality_rules.SYMBOLS)[:200]]
    assert all(abs(c - 1) < 1e-9 for c in chances)


def test_kneser_ney_counts_characters_as_they_are(spark):
    """Marks, digits and letters beyond ASCII are told apart, and the sorted arrays answer as the formula does."""
    texts = ["ab#a é", "ab$b 12", "ba#% 21 ê", "ab ab"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    model = quality_rules.fit(quality_rules.packed(rows, "text"))
    grams = [{bytes((b" " * 2 + t.encode())[i : i + 3]) for i in range(len(t.encode()))} for t in texts]
    counts = collections.Counter(g for s in grams for g in s)
    assert [int.from_bytes(g, "big") for g in sorted(counts)] == model.grams.tolist()

    def level(seen):
        n = [sum(c == k for c in seen.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        raw = [1 - 2 * y * n[1] / n[0] if n[0] else y, 2 - 3 * y * n[2] / n[1] if n[1] else y, 3 - 4 * y * n[3] / n[2] if n[2] else y]
        cut = [0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))]

        def chance(gram, below):
            same = [c for g, c in seen.items() if g[:-1] == gram[:-1]]
            if not same:
                return below
            c = seen.get(gram, 0)
            return (max(c - cut[min(c, 3)], 0) + sum(cut[min(x, 3)] for x in same) * below) / sum(same)

        return chance

    pairs = collections.Counter(g[1:] for g in counts)
    ones = collections.Counter(g[1:] for g in pairs)
    three, two, one = level(counts), level(pairs), level(ones)
    asked = [*counts, b"ab%", b"zzz", b"a\xc3\xaa", b"#a "]
    wanted = [math.log(three(g, two(g[1:], one(g[2:], 1 / 256)))) for g in asked]
    got = model.log_probability(quality_rules.np.array([int.from_bytes(g, "big") for g in asked]))
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, wanted, strict=True))


def test_the_quality_queries_count_every_occurrence(spark, monkeypatch):
    """An n-gram that a text holds many times counts as often, in both queries' models."""
    texts = ["ab ab abc ab", "%%%%%%%% %%%", "ab ab abc ab", "x ab é é", "", None]
    rows = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    padded = [b" " * 2 + t.encode() for t in texts if t]
    counts = collections.Counter(int.from_bytes(t[i : i + 3], "big") for t in padded for i in range(len(t) - 2))
    assert max(counts.values()) > len(texts)
    assert {r["gram"]: r["n"] for r in quality_rules.gram_counts(quality_rules.packed(rows, "text")).collect()} == counts

    made, fit = [], quality_rules.fit
    monkeypatch.setattr(quality_rules, "fit", lambda *a, **k: made.append(fit(*a, **k)) or made[-1])
    found = {r["doc_id"]: r["log_perplexity"] for r in quality_rules.quality_report(rows, stage).collect()}
    quality_rules.quality_filter(rows, stage).collect()
    n1, n2, n3, n4 = (sum(c == k for c in counts.values()) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else y, 3 - 4 * y * n4 / n3 if n3 else y]
    cut = [0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))]
    assert len(made) == 2
    for model in made:
        chances = {}
        for gram, c in counts.items():
            same = [x for g, x in counts.items() if g >> 8 == gram >> 8]
            below = math.e ** model.lower[gram & 0xFFFF]
            chances[gram] = (c - cut[min(c, 3)] + sum(cut[min(x, 3)] for x in same) * below) / sum(same)
        assert model.grams.tolist() == sorted(counts)
        assert all(abs(math.e**a - chances[g]) < 1e-9 for g, a in zip(model.grams.tolist(), model.logs, strict=True))
    for i, t in enumerate(texts):
        t = b" " * 2 + (t or "").encode()
        spent = -math.fsum(math.log(chances[int.from_bytes(t[k : k + 3], "big")]) for k in range(len(t) - 2))
        assert abs(found[i] - spent / max(len(t) - 2, 1)) < 2e-6


@pytest.mark.parametrize("group_rows", [repeats.GROUP_ROWS, 2])
@pytest.mark.parametrize("length", [33, 60])
def test_repeated_strings(spark, docs, empty, monkeypatch, length, group_rows):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    times = collections.Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    expected = []
    for doc, t in rows:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if times[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        left = bytes(b for b, g in zip(t, gone) if not g)
        expected.append((doc, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    assert collections.Counter(map(tuple, repeats.removal_report(docs, stage, length).collect())) == collections.Counter(expected)
    assert repeats.removal_report(empty, stage, length).count() == 0
    assert repeats.without_repeats(docs, stage, length).columns == docs.columns


def test_fingerprints_and_components(spark, docs, empty):
    def expected(text):
        w = words(text)
        shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] * bool(w)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = docs.collect()
    prints = [expected(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[root(i)] = min(least.get(root(i), r["doc_id"]), r["doc_id"])
    wanted = collections.Counter((r["doc_id"], f"{prints[i]:016x}", least.get(root(i))) for i, r in enumerate(rows))
    assert collections.Counter(map(tuple, simhash.near_duplicates(docs, stage).collect())) == wanted
    assert simhash.near_duplicates(empty, stage).count() == 0


def test_classes_of_planted_fingerprints(spark):
    r = random.Random(5)
    found = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(12):
            found.add(x)
            for b in r.sample(range(64), r.randint(1, 3)):
                x ^= 1 << b
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in found)
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    got = simhash.classes(spark.createDataFrame([(x,) for x in signed], "fp long"), stage).collect()
    assert {r["fp"]: r["label"] for r in got} == {x: root(x) for x in signed}


def test_components_of_a_long_path(spark):
    links = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components(links, stage).collect()} == {(i, 0) for i in range(1, 61)}


def test_one_of_each_group_stays(docs, empty):
    kept = simhash.keep_one(docs, stage)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and 0 in ids and 86 not in ids and 87 not in ids
    assert simhash.keep_one(empty, stage).count() == 0


def least_of_groups(texts):
    """The least place of each group that links of similarity 0.8 or more on five-word shingles make, by brute force."""
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in map(words, texts)]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    return {root(i) for i in range(len(texts))}


def kept_places(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"] for r in simhash.keep_one(rows, stage).collect()}


def test_the_least_of_each_component_of_fingerprints_stays(spark, docs, empty):
    kept = simhash.keep_least(docs, stage)
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["component_id"] for r in simhash.near_duplicates(docs, stage).collect()}
    assert kept.columns == docs.columns and len(ids) == len(set(ids)) and groups - {None} <= set(ids)
    assert simhash.keep_least(empty, stage).count() == 0


def test_pipeline_groups_by_fingerprints(spark):
    """Texts far below a similarity of 0.8 go together where their fingerprints do, and one far copy stays."""
    r = random.Random(10)
    texts = []
    for _ in range(40):
        text = [f"w{r.randrange(900)}" for _ in range(120)]
        texts.append(" ".join(text))
        for edits in (1, 4, 30):
            edited = text[:]
            for place in r.sample(range(len(text)), edits):
                edited[place] = "NEW"
            texts.append(" ".join(edited))
    prints = [simhash.fingerprint(t) & (1 << 64) - 1 for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 3:
            a, b = root(i), root(j)
            up[max(a, b)] = min(a, b)
    expected = {root(i) for i in range(len(texts))}
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, rows, "").collect()}
    assert 0 < len(expected) < len(texts) and found == expected


def test_no_link_is_lost_in_a_large_bucket(spark):
    r = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    chains = []
    for _ in range(3):
        text = [r.choice(vocab) for _ in range(90)]
        for _ in range(50):
            chains.append(" ".join(text))
            for _ in range(r.randint(1, 3)):
                text[r.randrange(30, 90)] = r.choice(vocab)
    r.shuffle(chains)
    assert kept_places(spark, chains) == least_of_groups(chains)


def test_whole_sets_decide_near_the_threshold(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    pairs = []
    for n in range(60):
        text = [r.choice(vocab) for _ in range(100)]
        edited = text[:]
        for place in r.sample(range(5, 95, 8), 2 + n % 2):
            edited[place] = "NEW"
        pairs += [" ".join(text), " ".join(edited)]
    expected = least_of_groups(pairs)
    assert 60 < len(expected) < 120 and kept_places(spark, pairs) == expected


def test_scores(docs, empty, monkeypatch):
    monkeypatch.setattr(interpolated_lm, "CHUNK_BYTES", 3_000)
    rows = docs.collect()
    held = lambda r: r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
    seen = collections.Counter(t for r in rows if not held(r) for t in [*words(r["text"]), None])
    total, kinds = sum(seen.values()), len(seen)
    wanted = collections.Counter()
    for r in rows:
        tokens = [*words(r["text"]), None]
        base = math.fsum(math.log10((seen[t] + 1) / (total + kinds + 1)) for t in tokens)
        wanted[(r["doc_id"], held(r), len(tokens), sum(seen[t] > 0 for t in tokens), total, round(base, 6))] += 1
    got = interpolated_lm.scores(docs, stage).collect()
    assert collections.Counter((*tuple(r)[:5], round(r["base_score"], 6)) for r in got) == wanted
    assert all(r["score"] < 0 for r in got)
    assert interpolated_lm.scores(empty, stage).count() == 0


def test_weights_follow_the_better_estimate():
    weights = interpolated_lm.learned([(3, -1, -40, 90), (3, interpolated_lm.NOTHING, -8, 10)], 1000)[3]
    assert weights[0] > 0.8 and abs(weights.sum() - 1) < 1e-9


def test_edit_matching(spark, docs, empty):
    r = random.Random(9)
    item = "".join(r.choice("abcdefgh ") for _ in range(120)).strip()
    budget = decontaminate.budget_of(decontaminate.normal(item))
    near = list(item)
    for i in r.sample(range(len(near)), budget):
        near[i] = "Z"
    far = list(item)
    for i in range(0, len(far), 9):
        far[i] = "Z"
    rows = [(1, "say " + "".join(near).upper() + " end"), (2, "".join(far)), (3, None), (4, ""), (5, item)]
    table = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (8, None), (9, " "), (None, "x")], "item_id long, text string")
    assert sorted((x["doc_id"], x["item_id"]) for x in decontaminate.leaks(table, items).collect()) == [(1, 7), (5, 7)]
    assert sorted(x["doc_id"] for x in decontaminate.clean(table, items).collect()) == [2, 3, 4]
    assert decontaminate.leaks(table, items.limit(0)).count() == decontaminate.leaks(empty, items).count() == 0
    for _ in range(100):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(1, 70))) for _ in range(2))
        last = [0] * (len(b) + 1)
        for i, c in enumerate(a, 1):
            row = [i]
            for j, d in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
            last = row
        assert decontaminate.best_end(a, b) == (min(last), last.index(min(last)))


def test_pieces_equal_the_library(docs, empty):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_transducer.MODEL)
    with open(piece_transducer.MODEL, "rb") as file:
        transducer = piece_transducer.Transducer(file.read())
    r = random.Random(3)
    parts = [*"ab the ing  \n\t▁éñ日本🦜\x00\r{}()=-,.0123", "   ", "th", "tion", "ing", " "]
    cases = ["", "  a  b ", "a▁b", " ", "\xa0x", " " * 37 + "x", *("".join(r.choice(parts) for _ in range(r.randint(0, 60))) for _ in range(600))]
    for case in cases:
        assert transducer.encode(case).tolist() == library.encode(case)
        assert transducer.decode(transducer.encode(case)) == library.decode(library.encode(case))
    rows = piece_transducer.token_table(docs).collect()
    assert len(rows) == docs.count() and all(x["round_trip"] and x["n_tokens"] == len(x["token_ids"]) for x in rows)
    assert piece_transducer.encoded(empty).count() == 0
    back = piece_transducer.decoded(piece_transducer.token_table(docs)).where("_row.doc_id = 1").first()
    assert back["_decoded"] == docs.where("doc_id = 1").first()["text"]


def test_token_histogram(docs, empty):
    encode = token_counts.encoder(token_counts.VOCABULARY).encode_ordinary
    sizes = sorted(len(encode(r["text"] or "")) for r in docs.collect())
    sums = stage(token_counts.token_histogram(docs), "sums")
    for row in sums.collect():
        limit = row["n_tokens"]
        assert row["docs"] == sizes.count(limit) and row["docs_from"] == sum(s >= limit for s in sizes)
        assert row["tokens_from"] == sum(s for s in sizes if s >= limit) and row["tokens_cut"] == sum(min(s, limit) for s in sizes)
        assert row["docs_up_to"] == sum(s <= limit for s in sizes) and row["all_tokens"] == sum(sizes)
    assert token_counts.cut_totals(sums, [5, 77]).first()["cut_77"] == sum(min(s, 77) for s in sizes)
    assert token_counts.quantiles(sums, [0.5]).first()["q0"] == sizes[math.ceil(len(sizes) / 2) - 1]
    assert token_counts.token_histogram(empty).count() == 0


def test_shards(docs, empty):
    rows = sharding.shard_documents(docs, stage, 5).collect()
    assert len(rows) == docs.count() and {r["law"] for r in rows} == {"bytes"}
    for shard in range(5):
        places = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert places == list(range(len(places)))
    assert sharding.shard_documents(empty, stage, 5).count() == 0
    sizes = [(i, 1 + i * 7919 % 101) for i in range(800)]
    first = sharding.first_map(sizes, 8)
    load = [sum(s for i, s in sizes if first[i] == k) for k in range(8)]
    assert max(load) - min(load) <= 2
    grown = sharding.grown_map(first, sizes, 9)
    assert all(grown[i] in (first[i], 8) for i, _ in sizes) and sum(s for i, s in sizes if grown[i] == 8) > 0.9 * sum(load) / 9


def test_equal_rows_share_one_list_of_runs(spark):
    r = random.Random(2)
    text = "".join(r.choice("abcdefgh ") for _ in range(3_000))
    sizes = []
    for copies in (50, 400):
        rows = spark.createDataFrame([(1, text)] * copies, "doc_id long, _text string")
        named = repeats._named_runs(rows.select("*", *repeats.row_key(F.col("doc_id"), F.col("_text"))), stage, 400)
        sizes.append(named.agg(F.max(F.size("_runs"))).first()[0])
    assert sizes[0] == sizes[1] < 3_000
    report = repeats.removal_report(spark.createDataFrame([(1, text)] * 3, "doc_id long, text string"), stage).collect()
    assert [(x["n_bytes"], x["n_removed"], x["n_spans"]) for x in report] == [(3_000, 3_000, 1)] * 3


@pytest.mark.parametrize(("seed", "size"), [(1, 300), (2, 450), (3, 800)])
def test_planted_passages_beside_brute_force(spark, seed, size):
    """Passages of 300 to 800 bytes in several documents: only strings of 400 bytes and more go."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(400)[:size]
    texts = [prose(60) + (f" {passage} " if i % 4 == 0 else " ") + prose(60) for i in range(24)]
    counts = collections.Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    found = repeats.removal_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), stage)
    for row in found.collect():
        t, gone = texts[row["doc_id"]], set()
        for i in range(len(t) - 399):
            if counts[t[i : i + 400]] > 1:
                gone.update(range(i, i + 400))
        assert row["n_removed"] == len(gone) and (row["n_removed"] >= size) == (size >= 400 and row["doc_id"] % 4 == 0)
        assert row["kept_sha256"] == hashlib.sha256("".join(c for i, c in enumerate(t) if i not in gone).encode()).hexdigest()


def test_query_returns_the_text_that_is_left(spark, tmp_path):
    """A long passage is out of the query's texts, a short one and all else stay; characters that are cut in two go whole."""
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 9))) for _ in range(n))
    long, short, alone = prose(120)[:450], prose(120)[:300], prose(120)
    # the repeated bytes begin with the second byte of a character and end with the first of another
    texts = [f"1{prose(40)}1{long}1{short}1{prose(40)}1", f"2{prose(40)}2{long}2{short}2{prose(40)}2", f"one \xe9{alone}\xe7 three", f"two \u0129{alone}\xf6 four", alone[:300], "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = catalog.QUERIES["op3_suffix_dedup"](spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    left = {x["doc_id"]: x for x in found.collect()}
    assert {k: x["text"] for k, x in left.items()} == {
        0: texts[0].replace(long, ""), 1: texts[1].replace(long, ""), 2: "one  three", 3: "two  four", 4: texts[4], 5: "", 6: "",
    }
    assert [left[i]["n_removed"] for i in range(7)] == [450, 450, len(alone) + 2, len(alone) + 2, 0, 0, 0]
    assert all(hashlib.sha256(left[i]["text"].encode()).hexdigest() == left[i]["kept_sha256"] for i in (0, 1, 4, 5, 6))
    assert left[2]["kept_sha256"] == hashlib.sha256(b"one \xc3\xa7 three").hexdigest()


@pytest.mark.parametrize("same_text", [False, True])
def test_shards_are_even_when_a_third_of_the_ids_is_missing(spark, same_text):
    r = random.Random(3)
    rows = [(None if i % 3 == 0 else i, "same old text" if same_text and i % 3 == 0 else "w" * r.randint(0, 90) + str(i)) for i in range(6_000)]
    found = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), stage, 10).collect()
    expected = collections.Counter((k, len(t.encode()) + 16, zlib.crc32(t.encode())) for k, t in rows)
    assert collections.Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in found) == expected
    loads, grown = collections.Counter(), collections.Counter()
    for x in found:
        loads[x["shard"]] += x["size"]
        grown[x["rebalanced_shard"]] += x["size"]
        assert x["rebalanced_shard"] in (x["shard"], 10) and x["law"] == "bytes" and x["grown_shard"] is None
    mean = sum(loads.values()) / 10
    assert len(loads) == 10 and max(loads.values()) < 1.02 * mean and min(loads.values()) > 0.98 * mean
    assert len(grown) == 11 and 0.85 < grown[10] / (sum(grown.values()) / 11) <= 1.01
    for shard in range(10):
        assert sorted(x["slot"] for x in found if x["shard"] == shard) == list(range(sum(x["shard"] == shard for x in found)))


def test_url_rules_and_reputation(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/x?q", "http://www.example.com/en/", "https://x.net/fr/a#b", "http://bad.org/x", "http://com", "http://good.org/"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://bad.org/y") for i in range(40)] + [(200 + i, "http://good.org/y") for i in range(40)]
    labels = [(100 + i, 0, 1) for i in range(40)] + [(200 + i, 1, 0) for i in range(40)] + [(None, 1, 1)]
    table = spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, host string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.url_verdicts(table, marked, url_reputation.RULES).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[4] == ("x.net", "/fr/a", "net/fr/", "block")
    assert got[5][2:] == (None, "block") and got[6] == ("com", "", None, "allow") and got[7][2:] == (None, "allow")
    assert url_reputation.url_verdicts(table, marked.limit(0), url_reputation.RULES).where("verdict = 'block'").count() == 2


def test_main_text(spark):
    page = (
        '<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="menu"><a href=1>a</a></div>'
        '<div class="content"><h1>Title &amp; more</h1><p>First  para<br>with <b>bold</b> text and words enough.<p>Unclosed &lt;ok&gt; '
        'with <a href="x">a link</a>.</p><div class="ad-box">buy</div><form><p>Your name</p></form><ul><li>one item</li></ul></div>'
        '<aside><p>Side text</p></aside><section id="comments"><p>Reader says very long long comment text</p></section>'
        "<footer>foot</footer><script>if(a<b){}</script></body></html>"
    )
    assert main_text.main_text(page) == "Title & more\n\nFirst para with bold text and words enough.\n\nUnclosed <ok> with a link.\n\none item"
    assert main_text.main_text("<article><p>cut &am") == "cut &am"
    rows = spark.createDataFrame([(1, "u", None, "t"), (1, None, "", "t"), (None, "u", page, "t"), (3, "u", "<" * 9, "t")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in main_text.extract(rows).collect())[:2] == [0, 0]
    assert main_text.extract(rows.limit(0)).count() == 0
