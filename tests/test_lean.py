"""Passes hand on only what is asked for: the same results as by arrays of spans, from one pass, in small batches."""

import pytest
from pyspark.sql import functions as F

from maskwell import ARROW_BYTES
from maskwell import queries as Q
from maskwell.operators import scan as P
from maskwell.operators import spans as S
from maskwell.plans import engine

SF = "/root/testdata/sf0.001"
TEXTS = [None, "", "Ann Lee, SSN 123-45-6780, mail a@b.org and 4111-1111-1111-1111", "no capital é\U0001f600 words at 10.0.0.1 or 555-123-4567", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("strict", [False, True])
def test_redact_docs(docs, strict):
    want = engine.redact(engine.detect(docs, strict=strict)).select("doc_id", "redacted_text", "redaction_count")
    got = engine.redact_docs(docs, strict=strict)
    assert got.columns == ["doc_id", "redacted_text", "redaction_count"]
    assert got.collect() == want.collect()
    assert engine.redaction_counts(docs, strict=strict).collect() == want.drop("redacted_text").collect()


@pytest.mark.parametrize("batch", [1, 1 << 18])
def test_rows(docs, monkeypatch, batch):
    monkeypatch.setattr(P, "BATCH_BYTES", batch)
    want = S.explode(engine.detect(docs, around_col="around"), "doc_id", around_col="around")
    got = engine.detect_rows(docs, "doc_id", columns=(*S.COLUMNS, "context"))
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert got.collect() == want.collect() and got.count() > 5


@pytest.mark.parametrize("name", ["redaction_type_counts", "redact_documents", "redact_strict", "redact_conversations", "audit_entries", "output_files", "output_forms"])
def test_one_pass(spark, name):
    """Before, the optimizer's filter of an exploded map ran the cut a second time, and each kind of file ran the detection anew."""
    text = plan(Q.QUERIES[name](spark, SF))
    assert text.count("MapInArrow") == 1 and "EvalPython" not in text


def test_batches(spark):
    """Before, only the operators in llm/ bounded a batch by bytes."""
    was = spark.conf.get(ARROW_BYTES, None)
    spark.conf.unset(ARROW_BYTES)
    try:
        Q.QUERIES["redact_strict"](spark, SF)
        assert int(spark.conf.get(ARROW_BYTES)) == 4 << 20
        assert spark.sparkContext.environment["MALLOC_ARENA_MAX"] == "1"
    finally:
        spark.conf.set(ARROW_BYTES, was or str(4 << 20))


def test_files_need_no_spans(docs):
    from maskwell.sources import writers

    done = engine.redact_docs(docs)
    assert writers.formatted(done, "pdf", "docx").count() == 2 * len(TEXTS)
    with pytest.raises(ValueError):
        writers.formatted(done, "json")
    assert [r.n for r in writers.formatted(done, "pdf", "docx").filter("success").groupBy("format").agg(F.count(F.lit(1)).alias("n")).collect()] == [len(TEXTS) - 1] * 2


@pytest.mark.parametrize("name", ["kb_keyword_join", "kb_context_range_join", "validation_reasons", "ssn_pan_ids", "mrz_zones"])
def test_customers_are_dealt_out(spark, name):
    """Before, a file of one row group was one task's work."""
    df = Q.QUERIES[name](spark, SF)
    assert "RoundRobinPartitioning" in plan(df) and df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


def test_knowledge_rows(spark):
    """Matches and phrases by themselves are those of the whole detection."""
    from maskwell.operators import knowledge as K

    docs = spark.createDataFrame([(1, "Contact email of Ann Lee: ann@mail.org, phone number 555-123-4567"), (2, None), (3, "Company name: Acme Corp. at the address of Bob Stone")], "id long, text string")
    rows = K.detect(docs, None, "id").collect()
    assert {r.source for r in rows} == {"rag", "rag_context"}
    assert sorted(map(tuple, K.pattern_spans(docs, None, "id").collect())) == sorted((r.id, *(r[c] for c in K.HIT.names if c != "source")) for r in rows if r.source == "rag")
    assert sorted(map(tuple, K.context_spans(docs, None, "id").collect())) == sorted((r.id, r.start_char, r.end_char, r.entity, r.type, r.confidence) for r in rows if r.source == "rag_context")
    called = K.called(docs, None, "id").filter("keywords > 0").select("id", "entity_type", "keywords").collect()
    assert sorted(map(tuple, K.keyword_hits(docs, None, "id").collect())) == sorted(map(tuple, called)) != []


def test_zones_are_read_once(spark):
    """Before, the filter and each field evaluated the whole expression anew."""
    assert plan(Q.QUERIES["mrz_zones"](spark, SF)).count("zones(") == 1


@pytest.mark.parametrize("name", ["pdf_lines", "block_totals", "output_files"])
def test_documents_are_dealt_out(spark, name):
    """Before, a file of one row group was one task's work, and files written were handed from one Python worker to another."""
    df = Q.QUERIES[name](spark, SF)
    text = plan(df)
    assert "RoundRobinPartitioning" in text and text.count("MapInArrow") == 1 and "EvalPython" not in text
