"""Whole outputs with audit, explained validation, machine-readable zones."""

import csv
import datetime
import io
import json

import pytest
from pyspark.sql import functions as F

from maskwell import queries as Q
from maskwell.functions import validate
from maskwell.operators import spans as S
from maskwell.plans import catalog as C
from maskwell.plans import engine
from maskwell.sources import readers, writers

TEXTS = {1: 'mail ann@mail.org, "x" and\nbob@mail.org', 2: "nothing", 3: "", 4: None, 5: "long ann@mail.org " * 3000}
AT = "2024-02-03 04:05:06"


@pytest.fixture(scope="module")
def redacted(spark):
    docs = spark.createDataFrame([(k, t, "clash") for k, t in TEXTS.items()], "doc_id long, text string, format string")
    return engine.redact(S.extract_all(docs, [p for p in C.LEGACY if p.type == "email"]), custom={"email": 'a,"b"'})


def test_all_forms(redacted):
    out = writers.formatted(redacted, *writers.FORMS, at=F.lit(AT).cast("timestamp"), user="u", frameworks=("GDPR",), metadata={"m": "1"}, path="p", custom={"email": 'a,"b"'})
    got = {(r.doc_id, r.format): r for r in out.collect()}
    assert len(got) == len(TEXTS) * len(writers.FORMS)
    for (doc, form), r in got.items():
        text = TEXTS[doc]
        if text is None:
            assert (r.success, r.error, r.content, r.size_bytes, r.row_count, r.audit.success) == (False, "No text to redact", None, None, None, False)
            continue
        want, n = text.replace("ann@mail.org", 'a,"b"').replace("bob@mail.org", 'a,"b"'), text.count("@")
        assert r.success and r.error is None and r.size_bytes == len(r.content)
        assert (r.audit.operation, r.audit.user_id, r.audit.document_id, r.audit.entity_count, r.audit.compliance_frameworks) == (f"redact_{form}", "u", str(doc), n, ["GDPR"])
        assert r.audit.timestamp == datetime.datetime(2024, 2, 3, 4, 5, 6) and r.audit.pii_types_processed == (["email"] if n else []) and r.audit.metadata.output_path == "p"
        body = bytes(r.content)
        if form == "text":
            assert body.decode().endswith("\n\n" + want) and f"Document ID: {doc}\n" in body.decode()
        elif form == "json":
            row = json.loads(body)
            assert row["redacted_text"] == want and row["metadata"] == {"m": "1"} and row["processed_at"] == "2024-02-03T04:05:06" and row["redaction_count"] == ({"email": n} if n else {})
            assert all(text[e["start_position"] : e["end_position"]] == e["original_text"] and e["redacted_text"] == 'a,"b"' for e in row["detected_entities"]) and len(row["detected_entities"]) == n
        elif form == "api_response":
            row = json.loads(body)
            assert row["success"] is True and row["redacted_text"] == want and row["redaction_statistics"] == {"total_redactions": n, "by_type": {"email": n} if n else {}}
        elif form == "csv":
            head, *rows = csv.reader(io.StringIO(body.decode()))
            assert tuple(head) == writers.ENTITY_COLUMNS and len(rows) == n == r.row_count
            assert all(x[0] == "email" and x[2] == 'a,"b"' and text[int(x[5]) : int(x[6])] == x[1] for x in rows)
        elif form == "docx":
            read = readers.docx_text(body)
            assert read.startswith(f"Redacted Document\nProcessed: 2024-02-03 04:05:06\nDocument ID: {doc}\n") and read.endswith("PII Type | Count" + (f"\nemail | {n}" if n else "")) and all(line in read for line in want.split("\n"))
        else:
            assert f"Document ID: {doc}" in readers.pdf_text(body) and (f"email: {n}" in readers.pdf_text(body)) == (n > 0)


def test_bad_form_and_save(redacted, tmp_path):
    assert {(r.success, r.error) for r in writers.formatted(redacted.filter("doc_id < 3"), "odt").collect()} == {(False, "Unsupported format type: odt")}
    back = writers.save(redacted, str(tmp_path / "out"), "json", "pdf", at=F.lit(AT).cast("timestamp"))
    assert back.count() == 2 * len(TEXTS) and {r.audit.metadata.output_path for r in back.collect()} == {str(tmp_path / "out")}
    assert writers.formatted(redacted.limit(0), *writers.FORMS).count() == 0


def test_equal_bytes():
    assert writers.docx("a\x00b", ("T", "f"), {"email": 1}) == writers.docx("a\x00b", ("T", "f"), {"email": 1})


def test_output_files(spark, sf):
    rows = Q.QUERIES["output_files"](spark, sf).collect()
    counts = {r.doc_id: r.redactions for r in Q.QUERIES["redact_strict"](spark, sf).collect()}
    assert len(rows) == 2 * len(counts) and all(r.entity_count == (counts[r.doc_id] or 0) and r.success == (r.digest is not None) for r in rows)


@pytest.mark.parametrize(
    "type_,text,want",
    [
        ("credit_card", "4111 1111 1111 1111", (True, "luhn", None)), ("credit_card", "4111 1111 1111 1112", (False, None, "Failed Luhn check")), ("credit_card", "4111", (False, None, "Invalid length")),
        ("email", "a@b.co", (True, "format", None)), ("email", "a@Test.com", (False, None, "Test domain")), ("email", "a@b", (False, None, "Invalid format")), ("ssn", "123-45-6789", (True, "format", None)),
        ("ssn", "666-45-6789", (False, None, "Invalid first group")), ("ssn", "923-45-6789", (False, None, "Invalid first digit")), ("ssn", "123-00-6789", (False, None, "Invalid second group")),
        ("ssn", "123-45-0000", (False, None, "Invalid third group")), ("ssn", "12", (False, None, "Invalid length")), ("date", "12/31/1999", (True, "format", None)), ("date", "33/33/1999", (False, None, "Failed to parse date")),
        ("phone", "555", (None, None, "No validation available")), ("ssn", "1", (None, None, "Text too short")), ("ssn", None, (None, None, "Text too short")),
    ],
)
def test_explained(spark, type_, text, want):
    row = spark.createDataFrame([(type_, text)], "t string, c string").select(validate.explained(F.col("t"), F.col("c")).alias("v")).first().v
    assert tuple(row) == want


def test_zones(spark, sf):
    rows = Q.QUERIES["mrz_zones"](spark, sf).collect()
    assert {r.kind for r in rows} == set(validate.ZONES) and {r.valid for r in rows} == {True, False}
    own = [("none", None), ("empty", ""), ("short", "P<UTO\nL898902C36"), ("long", "A" * 45 + "\n" + "B" * 44)]
    found = spark.createDataFrame(own, "k string, text string").select("k", validate.mrz_zone(F.col("text")).alias("z"))
    assert all(r.z is None for r in found.collect())
