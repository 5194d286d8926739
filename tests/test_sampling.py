from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from quarryline.functions.text import blake2b_fraction, is_blank, md5_fraction, strip, tokens
from quarryline.operators import manifests, placement, quality, sampling

# Everything str.strip removes.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"


def _one(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", ["", " ", SPACES, None])
def test_blank(spark, text):
    assert _one(spark, text, is_blank) is True


@pytest.mark.parametrize("text", ["a", f"{SPACES}x{SPACES}", "​", "0"])
def test_not_blank(spark, text):
    assert _one(spark, text, is_blank) is False
    assert _one(spark, text, strip) == text.strip()


def test_tokens(spark):
    assert _one(spark, " a\tb\n\nc  d ", tokens) == ["a", "b", "c", "d"]
    assert _one(spark, "  ", tokens) == []


def test_blake2b_matches_hashlib(spark):
    keys = [f"42|{i}" for i in range(300)] + ["42|é漢"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(blake2b_fraction(F.col("k"))).collect()]
    expected = [int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") / 2**64 for k in keys]
    assert got == expected


def test_md5_fraction(spark):
    got = _one(spark, "42|7", md5_fraction)
    assert got == int(hashlib.md5(b"42|7").hexdigest()[:13], 16) / 2**52


def test_sample_is_stable_under_repartitioning_and_near_the_ratio(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("id"))
    first = {r[0] for r in sampling.hash_sample(df, F.col("id"), 0.165).collect()}
    second = {r[0] for r in sampling.hash_sample(df.repartition(7), F.col("id"), 0.165).collect()}
    other = {r[0] for r in sampling.hash_sample(df, F.col("id"), 0.165, seed=1).collect()}
    assert first == second
    assert first != other
    assert abs(len(first) / 20_000 - 0.165) < 0.01
    assert sampling.hash_sample(df, F.col("id"), 1.0).count() == 20_000


def test_sample_nests_by_ratio(spark):
    df = spark.range(5_000).select(F.col("id").cast("string").alias("id"))
    small = {r[0] for r in sampling.hash_sample(df, F.col("id"), 0.1).collect()}
    large = {r[0] for r in sampling.hash_sample(df, F.col("id"), 0.3).collect()}
    assert small < large


@pytest.mark.parametrize("ratio", [0, -0.1, 1.1])
def test_ratio_range(ratio):
    with pytest.raises(ValueError):
        sampling.keep_condition(F.lit("a"), ratio)


def test_row_key_falls_back_where_id_is_null(spark):
    df = spark.createDataFrame([("a", "c1", 3, "x" * 200), (None, "c1", 4, "hello")], "id string, config string, source_row bigint, text string")
    assert [r[0] for r in df.select(sampling.row_key(df)).collect()] == ["a", "c1:4:hello"]
    without = df.drop("id")
    assert without.select(sampling.row_key(without)).first()[0] == "c1:3:" + "x" * 128


def test_composite_score_fills_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (None, 2.0, 4.0), (float("nan"), 1.0, 1.0), (None, None, None)], "a double, b double, c double")
    got = [r["score"] for r in quality.composite_score(df, ("a", "b", "c")).collect()]
    assert got == [2.0, 2.0, 2.0 / 3, 0.0]
    with pytest.raises(ValueError, match="missing columns"):
        quality.composite_score(df, ("a", "z"))


def test_profile_ignores_nulls_but_the_score_profile_does_not(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 5.0)], "a double, b double")
    rows = {r["key"]: (r["min"], r["max"], r["mean"]) for r in quality.quality_profile(df, ("a", "b")).collect()}
    assert rows == {"a": (1.0, 3.0, 2.0), "b": (5.0, 5.0, 5.0)}
    scored = quality.composite_score(df, ("a", "b"))
    assert quality.score_profile(scored).first().asDict() == {"min": 0.5, "max": 4.0, "mean": 2.25}


def test_resolve_text_column(spark):
    df = spark.createDataFrame([(None, "x"), (None, None)], "text string, content string")
    assert quality.resolve_text_column(df) == "content"
    with pytest.raises(ValueError, match="available"):
        quality.resolve_text_column(df.select(F.col("content").alias("body")))


def test_token_budget(spark):
    df = spark.createDataFrame([("f1", 10), ("f1", None), ("f2", 7)], "file string, token_count int")
    assert sampling.token_budget(df, batch=8).first().asDict() == {
        "status": "ok", "message": None, "files": 2, "rows": 3, "tokens": 17, "total_batch_size": 8, "num_iterations": 3,
    }
    assert sampling.token_budget(df.filter("token_count is null"), batch=8).first()["num_iterations"] == 0
    missing = sampling.token_budget(df, token_col="tokens").first()
    assert missing["status"] == "missing_token_col"
    assert "token_count" in missing["message"]
    with pytest.raises(ValueError):
        sampling.token_budget(df, batch=0)


def test_report_counts_blanks_as_seen(spark):
    df = spark.createDataFrame([("a", "1", "x"), ("a", "2", " "), ("b", "3", "y")], "config string, id string, text string")
    rows = {r["config"]: (r["seen"], r["kept"]) for r in sampling.sampling_report(df, F.col("id"), 1.0, 10).collect()}
    assert rows == {"a": (2, 1), "b": (1, 1), "(all)": (3, 2)}


def test_ranks_read_every_group_once_and_none_starves(spark):
    files = spark.createDataFrame([(f"f{i:02d}", 1, 10, 100) for i in range(16)], "name string, n_groups int, docs bigint, tokens bigint")
    groups = placement.row_groups(placement.file_index(files))
    assigned = placement.rank_assignment(groups, 8).collect()
    assert len(assigned) == 16
    assert {r["rank"] for r in assigned} == set(range(8))
    balance = placement.rank_balance(groups, 8).collect()
    old = [r for r in balance if r["rule"] == "by_group"]
    new = [r for r in balance if r["rule"] == "by_file_or_group"]
    assert sum(r["starving"] for r in old) == 7 and old[0]["skew"] == 8.0
    assert not any(r["starving"] for r in new) and new[0]["skew"] == 1.0
    assert placement.rank_assignment(groups, 3, "val").count() == 48


def test_reconcile_and_progress(spark):
    def listing(rows):
        return spark.createDataFrame(rows, "name string, length bigint")

    source, local = listing([("a", 10), ("b", 20), ("c", 30)]), listing([("a", 10), ("b", 5)])
    destination = listing([("x", 1)])
    rows = {r["name"]: (r["local_state"], r["dest_state"]) for r in manifests.manifest_reconcile(source, local, destination).collect()}
    assert rows == {"a": ("complete", "missing"), "b": ("partial", "missing"), "c": ("missing", "missing"), "x": ("absent", "extra")}
    progress = {r["place"]: r for r in manifests.transfer_progress(source, local, destination).collect()}
    assert progress["local"]["bytes_percent"] == 25.0
    nothing = {r["place"]: r for r in manifests.transfer_progress(listing([]), local, listing([])).collect()}
    assert nothing["local"]["files_percent"] is None
    assert nothing["destination"]["files"] == 0


def test_comparability(spark):
    df = spark.createDataFrame([("r1", 26, 5), ("r2", 26, None), ("r3", 26, 6)], "run string, depth int, batch int")
    rows = {r["field"]: r["comparable"] for r in sampling.comparability_check(df, "run", ["depth", "batch"]).collect()}
    assert rows == {"depth": True, "batch": False}
