"""Plug-in detectors, tagging models, label tables, token windows, file structure and counters."""

import json
import sys

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F

from maskwell import queries as Q
from maskwell.functions import tokens
from maskwell.operators import plugins as P
from maskwell.operators import spans as S
from maskwell.plans import catalog as C
from maskwell.plans import engine
from maskwell.sources import readers, structure, writers
from maskwell.streaming import streams

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def words(types):
    def find(text):
        at = 0
        for w in text.split(" "):
            if w in types:
                yield at, at + len(w), types[w], 0.9
            at += len(w) + 1

    return find


def broken():
    raise OSError("no model")


def test_a_raising_detector_costs_its_own_spans(spark):
    def picky(text):
        yield 0, 1, "custom", 0.7
        if "bad" in text:
            raise ValueError("bad text")

    r = P.Registry(P.of_function("words", ["person"], words({"Ann": "person"})), P.of_function("picky", ["custom"], picky), P.Detector("lost", ("x",), broken), P.of_patterns("rules", [p for p in C.LEGACY if p.type == "email"]))
    df = spark.createDataFrame([(1, "Ann ann@mail.org"), (2, "Ann bad"), (3, None), (4, "")], "id int, text string")
    got = {x.id: x for x in r.detect(df).collect()}
    spans = lambda i: sorted((s.start, s.end, s.type, s.source, s.text) for s in got[i].spans)
    assert spans(1) == [(0, 1, "custom", "picky", "A"), (0, 3, "person", "words", "Ann"), (4, 16, "email", "rules", "ann@mail.org")]
    assert spans(2) == [(0, 3, "person", "words", "Ann")]
    assert [(e.detector, e.error) for e in got[2].errors] == [("picky", "ValueError: bad text"), ("lost", "OSError: no model")]
    assert [e.detector for e in got[1].errors] == ["lost"] and (got[3].spans, got[3].errors) == ([], [])
    assert [e.error for e in got[4].errors if e.detector == "picky"] == ["ValueError: a span outside the text"]
    r.enable("lost", False)
    assert r.remove("picky") and not r.remove("picky") and set(r.types()) == {"words", "rules"}
    assert [x.errors for x in r.detect(df).collect()] == [[]] * 4
    assert {s.type for x in r.detect(df, types={"email"}).collect() for s in x.spans} == {"email"}


def test_registry_equals_the_engine_on_patterns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.spans for r in P.Registry(P.of_patterns("rule_based", C.LEGACY)).detect(docs, merge_at=0.7).collect()}
    assert got == {r.doc_id: r.spans for r in S.extract_all(docs, C.LEGACY, merge_at=0.7, least=0.5).collect()}


def test_tags_fold_into_spans():
    tagged = [(0, 3, "B-PER", 0.9), (4, 7, "I-PER", 0.7), (8, 9, "O", 1.0), (10, 12, "I-per", 0.5), (13, 15, "B-PER", 0.5), (16, 18, "I-ORG", 0.4), (19, 20, "ORG", 0.2), (21, 22, "O", 1.0), (23, 24, "LOC", 1.0)]
    assert P.folded(tagged) == [(0, 7, "PER", pytest.approx(0.8)), (10, 12, "PER", 0.5), (13, 15, "PER", 0.5), (16, 20, "ORG", pytest.approx(0.3)), (23, 24, "LOC", 1.0)]


@given(st.lists(st.sampled_from(["word", ". ", ".", " ", "x" * 30, ""]), max_size=30).map("".join), st.integers(5, 40))
def test_pieces_cover_the_text(text, most):
    got = P.pieces(text, most)
    assert "".join(t for _, t in got) == text and all(len(t) <= most and text[a : a + len(t)] == t for a, t in got)


def test_tagger_keeps_true_offsets(spark):
    text = "Filler words here. " * 40 + "Then Ann Lee spoke. " + "x" * 700 + " Bob"

    def load():
        def tag(piece):
            at = 0
            for w in piece.split(" "):
                yield at, at + len(w), {"Ann": "B-PER", "Lee": "I-PER", "Bob": "B-XYZ"}.get(w, "O"), 0.8
                at += len(w) + 1

        return tag

    for default, want in ((None, ["Ann Lee"]), ("custom", ["Ann Lee", "Bob"])):
        row = P.Registry(P.tagger("ner", load, default=default)).detect(spark.createDataFrame([(text,)], "text string")).first()
        assert sorted(s.text for s in row.spans) == want and all(text[s.start : s.end] == s.text for s in row.spans) and row.errors == []


def test_label_tables(spark):
    assert (len(C.MODEL_LABELS), len(C.KNOWLEDGE_TYPES), len(C.CONTEXT_TYPES)) == (26, 12, 5)
    df = spark.createDataFrame([("B-PER",), ("i-gpe",), ("ORG",), ("MISC",), ("PAN",), ("Contact",)], "x string")
    rows = df.select(P.label_type(F.col("x")).alias("a"), P.label_type(F.col("x"), C.OWN_MODEL_LABELS, "custom").alias("b"), P.knowledge_type(F.col("x")).alias("c"), P.context_type(F.col("x")).alias("d")).collect()
    assert [tuple(r) for r in rows] == [("person", "custom", "custom", None), ("location", "custom", "custom", None), ("organization", "custom", "custom", None), (None, "custom", "custom", None), (None, "custom", "pan", None), (None, "email", "custom", "person")]


def test_token_windows(spark):
    text = "at noon, the CEO of Acme (Ann Lee) met us in Rome."
    rows = [(text, text.index(w), text.index(w) + len(w), label, w) for w, label in (("Ann Lee", "PERSON"), ("Acme", "ORG"), ("Rome", "GPE"), ("CEO", "ORG"))]
    df = spark.createDataFrame(rows, "t string, a int, b int, label string, w string")
    near = df.withColumn("around", tokens.window(F.col("t"), F.col("a"), F.col("b"))).withColumn("strong", tokens.strong_context(F.col("label"), F.col("around")))
    got = near.select("around", "strong", tokens.tagged_confidence(F.col("label"), F.col("w"), F.col("strong")).alias("c")).collect()
    assert [r.around for r in got[:2]] == [["of", "acme", "(", "ann", "lee", ")", "met", "us"], ["the", "ceo", "of", "acme", "(", "ann", "lee"]]
    assert [(r.strong, r.c) for r in got] == [(False, 0.9), (False, 0.9), (True, 0.9), (False, 0.75)]
    flags = spark.createDataFrame([("Ann Lee",), ("ann",), ("ANN",), ("McKay",), ("12 Long Street",), ("x",)], "w string").select(tokens.title_case(F.col("w")), tokens.all_capitals(F.col("w")), tokens.looks_like_address(F.col("w"))).collect()
    assert [tuple(r) for r in flags] == [(True, False, False), (False, False, False), (False, True, False), (False, False, False), (True, False, True), (False, False, False)]


def test_plugin_query(spark, sf):
    rows = Q.QUERIES["plugin_detection"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    assert {r.doc_id for r in rows if r.errors} == {i for i, t in texts.items() if t and "\t" in t} and {r.errors for r in rows} <= {"", "capitals"}
    assert any("capitals" in r.sources for r in rows) and any("rules" in r.sources for r in rows)


# ---------------------------------------------------------------- structure


def test_csv_and_json():
    text, shape = structure.csv_file('name,n\n"Lee, Ann",1\ncaf\xe9,2\n\nshort\n'.encode("latin-1"))
    assert text == "name\tn\nLee, Ann\t1\ncafé\t2\nshort" and shape == {"columns": ["name", "n"], "rows": 3, "sample": [{"name": "Lee, Ann", "n": "1"}, {"name": "café", "n": "2"}, {"name": "short", "n": None}], "encoding": "latin1"}
    assert structure.csv_file("﻿a\n".encode()) == ("a", {"columns": ["a"], "rows": 0, "sample": [], "encoding": "utf-8"})
    assert structure.json_file(b'[{"a": 1, "b": [2]}, 3]') == ('[\n  {\n    "a": 1,\n    "b": [\n      2\n    ]\n  },\n  3\n]', {"type": "array", "length": 2, "sample_keys": ["a", "b"]})
    assert structure.json_file(b'{"k": "\xc3\xa9"}')[1] == {"type": "object", "keys": ["k"]} and structure.json_file(b"7")[1] == {}


def test_ingest_structured_files(spark):
    rows = [("a.csv", b"x,y\n1,2\n"), ("b.json", b'{"k": 1}'), ("c.csv", b"x\n1,2\n"), ("d.json", b"{"), ("e.csv", b""), ("f.txt", b"plain"), ("g.xls", b"old")]
    got = {r.path: r for r in readers.ingest(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.csv"].text == "x\ty\n1\t2" and json.loads(got["a.csv"].meta["structure"])["rows"] == 1
    assert got["b.json"].text == '{\n  "k": 1\n}' and "structure" not in got["f.txt"].meta
    assert {p for p, r in got.items() if r.error} == {"c.csv", "d.json", "e.csv", "g.xls"} and all(got[p].text is None for p in ("c.csv", "d.json", "e.csv", "g.xls"))


def test_headers_and_properties(spark):
    import io
    import struct
    import zipfile

    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    jpeg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xc2\0\x0b\x08" + struct.pack(">HH", 5, 7) + b"\x03"
    assert structure.image(png) == {"format": "PNG", "width": 30, "height": 20} and structure.image(jpeg) == {"format": "JPEG", "width": 7, "height": 5}
    assert structure.image(b"GIF89a" + struct.pack("<HH", 3, 4)) == {"format": "GIF", "width": 3, "height": 4} and structure.image(b"BM" + bytes(16) + struct.pack("<ii", 9, -8)) == {"format": "BMP", "width": 9, "height": 8}
    out = io.BytesIO(writers.docx("hello"))
    with zipfile.ZipFile(out, "a") as z:
        z.writestr("docProps/core.xml", '<c xmlns:d="d"><d:creator>Ann</d:creator><d:title/><d:revision>3</d:revision><d:other>x</d:other></c>')
    rows = [("a.png", png), ("b.docx", out.getvalue()), ("c.jpg", b"x")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: r for r in readers.ingest(df).collect()}
    assert got["a.png"].error == "no reader for image" and json.loads(got["a.png"].meta["structure"])["width"] == 30
    assert got["b.docx"].text == "hello" and json.loads(got["b.docx"].meta["structure"])["document_properties"] == {"author": "Ann", "revision": "3"}
    assert got["c.jpg"].error == "no reader for image" and got["c.jpg"].meta["structure"] == "{}"
    assert readers.ingest(df.filter("path = 'a.png'"), {"image": lambda raw: "seen"}).first().text == "seen"


# ---------------------------------------------------------------- results


def test_report_and_failing_inputs(spark):
    rows = [(1, "mail ann@mail.org or not b@test.com, Ann Lee"), (2, ""), (3, None), (4, "nothing here")]
    df = spark.createDataFrame(rows, "id int, text string")
    results = engine.report(df, "id", strict=True)
    got = {r.id: r for r in engine.redact_result(results).collect()}
    spans = {r.id: r.spans for r in engine.detect(df, strict=True).collect()}
    one = got[1]
    assert [(c.start_char, c.end_char, c.type, c.source, c.confidence) for c in one.candidates] == [(s.start, s.end, s.type, s.source, s.confidence) for s in spans[1]]
    assert one.summary.total_entities == len(spans[1]) and sum(one.summary.risk_distribution.values()) == len(spans[1]) and one.summary.entities_by_type["person_name"] == 1
    assert one.summary.detection_coverage == round(100 * len(spans[1]) / 7, 2) and len({c.id for c in one.candidates}) == len(spans[1])
    assert all(c.metadata.context in rows[0][1] and c.metadata.risk_level and 0 <= c.metadata.adjusted_confidence <= 1 for c in one.candidates)
    assert one.metadata.pipeline_settings.merge_threshold == 0.7 and len(one.metadata.detectors_used) == 4
    assert [(got[i].success, got[i].redaction.success, got[i].redaction.error, got[i].redaction.redacted_text) for i in (2, 3, 4)] == [(True, False, "No text to redact", ""), (False, False, "Invalid detection result", ""), (True, True, None, "nothing here")]
    assert "ann@mail.org" not in one.redaction.redacted_text and "Ann Lee" not in one.redaction.redacted_text
    failed = engine.redact_result(results.withColumn("success", F.lit(False))).collect()
    assert {r.redaction.error for r in failed} == {"Invalid detection result"}


def test_report_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: (len(r.spans), sum(s.confidence >= 0.8 for s in r.spans)) for r in engine.detect(docs, strict=True).collect()}
    redacted = {r.doc_id: r.redacted_text for r in Q.QUERIES["redact_strict"](spark, sf).collect()}
    rows = Q.QUERIES["detection_report"](spark, sf).collect()
    assert {r.doc_id: (r.total_entities, r.high_confidence_entities) for r in rows} == want
    assert all(r.as_json and (r.redacted_text == redacted[r.doc_id] or r.error) for r in rows)
    assert all(sum(json.loads(r.entities_by_type).values()) == sum(json.loads(r.risk_distribution).values()) == r.total_entities for r in rows)


# ---------------------------------------------------------------- counters


def test_counters_reset(spark, tmp_path):
    counters = streams.Counters(spark, f"{tmp_path}/ck", f"file://{tmp_path}/bases")

    def feed(*rows):
        spark.createDataFrame(rows, "source string, type string, confidence double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema("source string, type string, confidence double").parquet(f"{tmp_path}/in")
        q = counters.stream(source).writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(90)

    seen = lambda: {(r.kind, r.name): r.n for r in counters.get().collect()}
    feed(("r", "email", 0.95), ("r", "phone", 0.5))
    assert seen() == {("detector", "r"): 2, ("type", "email"): 1, ("type", "phone"): 1, ("confidence", "90%-99%"): 1, ("confidence", "50%-59%"): 1}
    assert counters.reset() == 1 and seen() == {}
    feed(("s", "email", 0.95))
    assert seen() == {("detector", "s"): 1, ("type", "email"): 1, ("confidence", "90%-99%"): 1}
    assert counters.reset() == 2 and seen() == {}
