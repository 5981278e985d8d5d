import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwell.functions import normalize, redact, score, validate
from maskwell.operators import spans as S
from maskwell.plans import catalog as C
from maskwell.plans import engine


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(expr(F.col("x"))).collect()]


def test_offsets_equal_finditer(spark):
    texts = ["a@b.co x", "", "no", "ä 1.2.3.4 é a.b@c.dd\n9.9.9.9", "1.1.1.11.1.1.1", None]
    for p in (C.EMAIL, C.IPV4):
        got = one(spark, lambda c: S.matches(c, p), *texts)
        want = [[(m.start(), m.end(), m.group()) for m in re.finditer(p, t or "")] for t in texts]
        assert [[tuple(x) for x in g or []] for g in got] == want


@pytest.mark.parametrize(
    "text, legacy, enhanced",
    [
        ("123-45-6789", None, 0.84), ("987-65-4321", None, 0.35), ("000-00-0000", None, 0.35), ("456-78-9012", 0.95, 0.84),
    ],
)
def test_ssn_table(spark, text, legacy, enhanced):
    df = spark.createDataFrame([(text,)], "text string")
    found = lambda ps: [r.confidence for r in S.explode(S.extract(df, [p for p in ps if p.type == "ssn"]), "text").collect()]
    assert found(C.LEGACY) == ([legacy] if legacy else [])
    assert found(C.ENHANCED) == [enhanced]


def test_cards(spark):
    text = "4111 1111 1111 1111 and 4532 1234 5678 9012"
    df = spark.createDataFrame([(text,)], "text string")
    got = lambda ps: sorted((r.start_char, r.confidence) for r in S.explode(S.extract(df, [p for p in ps if p.type == "credit_card"]), "text").collect())
    assert got(C.LEGACY) == [(0, 0.85)]
    assert got(C.ENHANCED) == [(0, 0.84), (0, 1.0), (24, 0.35), (24, 0.46)]


def test_masks(spark):
    assert one(spark, redact.mask_card, "4111-1111-1111-1234", "4111111111111234") == ["XXXX-XXXX-XXXX-1234", "XXXXXXXXXXXX1234"]
    assert one(spark, redact.mask_ssn, "456-78-9012", "456 78 9012") == ["XXX-XX-9012", "XXXXX9012"]
    assert one(spark, redact.mask_phone, "(555) 123-4567") == ["(XXX) XXX-4567"]
    assert one(spark, redact.mask_email, "ann@x.org", "a@x.org") == ["aXX@x.org", "aXXXXXg"]
    assert one(spark, redact.mask_name, "Ann B Lee") == ["AXX B LXX"]
    assert one(spark, redact.mask_default, "abcd", "ab", "a") == ["aXXd", "aX", "X"]
    assert one(spark, lambda c: redact.full_mask(c, preserve_length=False), "abc") == ["XXXXX"]


def test_merge_example():
    spans = [{"start": a, "end": b, "confidence": c, "source": s} for a, b, c, s in ((5, 12, 0.7, "e"), (5, 12, 0.95, "r"), (6, 12, 0.9, "k"), (20, 24, 0.9, "h"))]
    got = S.fold(spans, 0.7)
    assert [(x["start"], x["end"], x["source"]) for x in got] == [(5, 12, "e+r+k"), (20, 24, "h")]
    assert got[0]["confidence"] == pytest.approx(0.859615, abs=1e-6)


def naive(spans, threshold):
    done = []
    for s in sorted(spans, key=lambda x: x["start"]):
        for i, e in enumerate(done):
            inter = min(e["end"], s["end"]) - max(e["start"], s["start"])
            if inter > 0 and inter / (max(e["end"], s["end"]) - min(e["start"], s["start"])) >= threshold:
                done[i] = S.fold([e, s], 0.0)[0]
                break
        else:
            done.append(s)
    return done


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=20))
def test_fold_equals_naive(pairs):
    spans = [{"start": a, "end": a + n, "confidence": 0.5, "source": str(i)} for i, (a, n) in enumerate(pairs)]
    assert S.fold(spans, 0.7) == naive(spans, 0.7)


def test_overlaps_are_resolved_before_splicing(spark):
    df = spark.createDataFrame([("call 555-123-4567 or ann@x.org",)], "text string")
    rules = engine.Rules()
    assert rules.add(r"123-4567 or", "custom") and not rules.add("(", "x") and not rules.add("a", "x", 2.0)
    found = engine.detect(df, ("rule_based",), rules=rules, merge_at=None)
    row = engine.redact(found).first()
    assert row.redacted_text == "call XXX-XXX-4567 or aXX@x.org"
    assert row.redaction_count == {"phone": 1, "email": 1}


def test_scores(spark):
    row = spark.createDataFrame([("ssn", "entity", 0.95), ("ssn", "entity", 0.84), ("ssn", "entity", 0.6), ("ssn", "pii", 0.95), ("ssn", "pii", 0.84)], "t string, s string, c double")
    assert [r[0] for r in row.select(score.risk(F.col("t"), F.col("s"), F.col("c"))).collect()] == ["critical", "high", "low", "medium", "low"]
    assert [r[0] for r in row.select(score.decile_label(F.col("c"))).take(1)] == ["90%-99%"]


def test_normalize(spark):
    assert one(spark, lambda c: normalize.remove_control_chars(c), "a\x07b\tc") == ["ab\tc"]
    assert one(spark, normalize.fix_ocr, "burn 0 tail S$5") == ["bum O tai1 $5"]
    assert one(spark, normalize.clean_boilerplate, "x Page 1 of 2 y") == ["x" + " " * 13 + "y"]
    assert one(spark, normalize.normalize_unicode, "ﬁne", "plain") == ["fine", "plain"]
    assert one(spark, lambda c: normalize.character_map(c, "[ab]"), "axby") == [[1, 3]]


def test_dates_and_ips(spark):
    assert one(spark, validate.iso_date, "1/31/1990", "31.1.1990", "2/30/1990") == ["1990-01-31", "1990-01-31", None]
    assert one(spark, validate.ip, "1.2.3.4", "1.2.3.256", "1.2.3", "1.2.3.") == [True, False, False, False]


def test_chunks(spark):
    text = "One two. Three four. Five six seven. " * 5
    got = one(spark, lambda c: S.chunks(c, 50), text)[0]
    assert "".join(x.text for x in got) == text and all(len(x.text) <= 50 and text[x.start : x.start + len(x.text)] == x.text for x in got)


def test_mrz(spark):
    assert one(spark, validate.mrz_check_digit, "L898902C3", "D23145890734", "<") == [6, 9, 0]
