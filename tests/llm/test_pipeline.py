"""The stages in turn, each against what it must do to its input, and the registered SQL."""

import corpus_pipeline
import pytest
from llm.conftest import CLASHING
from oracle import compare, connection

from formline.llm import packing, pii
from formline.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), connection(sf), ORACLES[name]) == []


def test_one_query_per_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 14)] == [1] * 13
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "personal_data", "packing"]


def test_stages_hand_on_what_they_keep(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, sf).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert after.select("doc_id").distinct().count() == before.count()
            assert after.agg({"length": "sum"}).first()[0] == packing.pack_documents(before, corpus_pipeline.TOKENIZER).agg({"length": "sum"}).first()[0]
            break
        assert after.columns == docs.columns and 0 < after.count() <= before.count()
        assert after.filter("text is not null and n_chars <> length(text)").isEmpty()
        if name == "near_dedup":
            assert after.select("text").distinct().count() == after.count()
        if name == "personal_data":
            assert not any(s[0] in pii.BASE for r in after.select("text").collect() for s in pii.spans(r[0] or ""))
        before = after


def test_stages_on_odd_rows(spark, make, odd, sf):
    docs = make(odd, [*CLASHING, "removed_places", "_id"])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        assert stage(spark, docs, sf).count() <= len(odd)
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
