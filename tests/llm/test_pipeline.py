"""The pipeline end to end, and the registered queries beside their SQL."""

from __future__ import annotations

import pytest

import corpus_pipeline
from quarryline.llm import catalog, decontaminate, quality_rules, repeats, simhash
from quarryline.session import stage
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    result = corpus_pipeline.run(spark, SF)
    assert result.columns[: len(docs.columns)] == docs.columns
    kept = {r["doc_id"] for r in result.collect()}
    assert kept and kept <= {r["doc_id"] for r in docs.collect()} and len(kept) == result.count()


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_sql(spark, name):
    assert differences(catalog.QUERIES[name](spark, SF), connect(SF), catalog.ORACLE[name]) == []


def test_stages_leave_clashing_columns_alone(spark):
    """Columns named as the operators' own pass through every filtering stage."""
    names = ["_k1", "_k2", "_key", "_row", "_text", "_lang", "_found", "n_words", "group", "node"]
    texts = [" ".join(f"word{i}{j}" for j in range(60)) for i in range(6)]
    rows = [(i, t, "en", *range(len(names))) for i, t in enumerate([*texts, texts[0], None, ""])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"`{n}` int" for n in names))
    items = spark.createDataFrame([(1, texts[5][:200])], "item_id long, text string")
    kept = simhash.keep_one(docs, stage)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 7]
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    kept = quality_rules.quality_filter(docs, stage)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} <= set(range(7))
    cut = repeats.without_repeats(docs, stage, 240)
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect() if r["doc_id"] in (1, 7)} == {1: texts[1], 7: None}
    for stage_of in (lambda d: simhash.keep_one(d, stage), lambda d: quality_rules.quality_filter(d, stage), lambda d: decontaminate.clean(d, items)):
        assert stage_of(docs.limit(0)).count() == 0
