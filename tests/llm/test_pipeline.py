import numpy as np
import public_tokenizers as P

import corpus_pipeline as cp
from maskwell.llm import queries as Q


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns and 0 < docs.count() <= before, name
        docs = cp.materialize(spark, docs)
    texts = [r.text for r in docs.collect()]
    assert len(texts) == len(set(texts))
    packed = cp.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


def test_names():
    assert [n.split("_")[0] for n in Q.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_pack_hands_ids_on(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [None, "", "Some text here.", "One.<|endoftext|> Two <|endoftext|>", "é alpha beta " * 1500]
    rows = cp.pack(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), sf).collect()
    placed: dict = {}
    for r in rows:
        assert len(r.ids) == r.length
        for k, x in enumerate(r.ids):
            assert placed.setdefault((r.sequence_id, r.offset + k), x) == x
    assert len(placed) == sum(r.length for r in rows)
    for i, t in enumerate(texts):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        got = np.array([placed[r.sequence_id, r.offset + k] for r in own for k in range(r.length)])
        assert got.tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
