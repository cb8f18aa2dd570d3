from __future__ import annotations

from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import queries
from pulsegrid.llm.support import table

from .conftest import SF


def test_stages_keep_columns_and_clean_documents(spark):
    docs = table(spark, SF, "documents")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns, name
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
        docs, before = out, after
    tokens = corpus_pipeline.token_ids(spark, docs, SF).collect()
    assert len(tokens) == docs.count()
    at = 0
    for r in sorted(tokens, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_empty_input(spark):
    none = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_every_operator_has_a_query(spark):
    names = queries.queries()
    assert [n for k in range(1, 11) if not any(x.startswith(f"op{k}_") for x in names) for n in [k]] == [] and "pipeline" in names
    hashes = queries.op4_decontamination(spark, SF)
    assert hashes.where("n_items = 0").select("items_sha256").distinct().collect()[0][0] == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert hashes.agg(F.count_if("contaminated")).first()[0] > 0
