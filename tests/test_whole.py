"""Queries over whole texts and all types, the one-pass scan and the offset maps against brute force on small fixtures."""

import hashlib
import re
import unicodedata
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwell import queries as Q
from maskwell.functions import normalize, offsets, plain, redact, validate
from maskwell.operators import knowledge
from maskwell.operators import scan as P
from maskwell.operators import spans as S
from maskwell.plans import catalog as C
from maskwell.plans import engine

LONG = "Plain words rn go on. " * 30  # past 400 characters
TEXTS = [None, "", "short  text", LONG + "\x01late\x02 tail 0\n\n  \nPage 7 of 9 é www.late-site.org\tlast S$5", LONG + "\n\nPowered by late\n\nburn  all\t\tCONFIDENTIAL l"]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return path


def spaced(i, t):
    return None if t is None else f"Page 1 of {i}\n" + t.replace(" ", "  ") + "\t\tburn 0 tail\n\nPowered by x\n\nwww.site.org \x07CONFIDENTIAL"


def blanked(t):
    for p in normalize.BOILERPLATE:
        t = re.sub("(?i)" + p, lambda m: " " * len(m[0]), t)
    return t


def fixed(t):
    t = re.sub(r"[^\x00-\x7F]", "_", t)
    for p, put in normalize.OCR_FIXES:
        t = re.sub(p, lambda m, put=put: put, t)
    return t.replace("  ", " ")


def cleaned(t):
    return "".join(c for c in t if c in "\t\n\r" or unicodedata.category(c)[0] != "C")


@pytest.mark.parametrize("name, force", [("whitespace_norm", lambda t: re.sub(r"[ \t]+", " ", t)), ("boilerplate", blanked), ("ocr_fix", fixed), ("control_chars", cleaned)])
def test_whole_text(spark, small, name, force):
    got = {r.doc_id: r.text for r in Q.QUERIES[name](spark, small).collect()}
    assert got == {i: None if t is None else force(spaced(i, t)) for i, t in enumerate(TEXTS)}


def test_whole_removed(spark, small):
    got = {r.doc_id: r.removed for r in Q.QUERIES["control_chars"](spark, small).collect()}
    assert got == {0: None, 1: 1, 2: 1, 3: 3, 4: 1}


def test_whole_segments(spark, small):
    want = []
    for i, t in enumerate(TEXTS):
        at = 0
        for p in re.split(r"\n\s*\n", spaced(i, t)) if t is not None else []:
            if p.strip(" "):
                want.append((i, at, at + len(p), p))
            at += len(p) + 2
    assert sorted(tuple(r) for r in Q.QUERIES["segments"](spark, small).collect()) == sorted(want)


# ---------------------------------------------------------------- detection

PEOPLE = [None, "", "Ann Lee met Bob J. Stone on 12/31/1990, DOB: 01/02/1980", "mail ann@mail.org or 10.0.0.1 by 2001-13-40", "member AB123456 é Ann Lee"]


def people(spark):
    return spark.createDataFrame(list(enumerate(PEOPLE)), "doc_id long, text string")


def places(patterns, text):
    return sorted((m.start(p.group), m.end(p.group), p.type, m[p.group]) for p in patterns for m in re.finditer(p.full, text or "") if len(m[p.group]) >= 2)


def test_detect_finds_names(spark):
    found = engine.detect(people(spark), types={"person_name"}, merge_at=None)
    got = {r.doc_id: sorted((s.start, s.end, s.type, s.text) for s in r.spans) for r in found.collect()}
    names = [p for p in C.ENHANCED if p.type == "person_name"]
    assert got == {i: places(names, t) for i, t in enumerate(PEOPLE)}
    assert (0, 7, "person_name", "Ann Lee") in got[2]


def test_extract_all_keeps_the_order_of_patterns(spark):
    got = S.extract_all(people(spark), C.ENHANCED).collect()
    for r in got:
        own = [(m.start(), m.end(), p.type) for p in C.ENHANCED for m in re.finditer(p.full, r.text or "") if len(m[0]) >= 2]
        assert [(s.start, s.end, s.type) for s in r.spans] == own
    assert {"date", "date_of_birth", "person_name", "health_insurance_id"} <= {s.type for r in got for s in r.spans}


def test_detect_merges_dense_with_sparse(spark):
    merged = {r.doc_id: r.spans for r in engine.detect(people(spark), ("enhanced",)).collect()}
    for r in S.extract_all(people(spark), C.ENHANCED).collect():
        want = [s for s in S.fold([s.asDict() for s in r.spans], 0.7) if s["confidence"] >= 0.5]
        key = lambda s: (-s["confidence"], s["start"], s["end"], s["source"])
        assert [key(s.asDict()) for s in sorted(merged[r.doc_id], key=lambda s: key(s.asDict()))] == sorted(map(key, want))


def test_enhanced_queries(spark, tmp_path):
    people(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for name, patterns in (("person_name_spans", [p for p in C.ENHANCED if p.type == "person_name"]), ("enhanced_detector", C.ENHANCED)):
        got = sorted((r.doc_id, r.start_char, r.end_char, r.type, r.entity) for r in Q.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted((i, *x) for i, t in enumerate(PEOPLE) for x in places(patterns, t))


# ---------------------------------------------------------------- redaction

PRIVATE = [None, "", "zz", "Ann Lee pays 4111111111111111 at 10.0.0.1, SSN 456-78-9012 or ann@mail.org", "acct 12345678901 GB29NWBK60161331926819 0x" + "ab" * 20, "é call 555-123-4567 on 12/31/1990"]


def validated(p, text):
    """The span's confidence under the detector's own rules, None if it drops the match."""
    if p.detector == "rule_based":
        return p.confidence if plain.LEGACY_KEEPS.get(p.type, lambda _: True)(text) else None
    if p.detector == "enhanced" and p.type in plain.BY_TYPE:
        return min(1.0, round(p.confidence * 1.2, 6)) if plain.BY_TYPE[p.type](text) else round(p.confidence * 0.5, 6)
    return p.confidence


def forced(patterns, text):
    """All places of all patterns, in order."""
    out = []
    for p in patterns:
        for m in re.finditer(p.full, text or ""):
            sure = validated(p, m[p.group])
            if sure is not None and (p.detector != "enhanced" or len(m[p.group]) >= 2):
                out.append({"start": m.start(p.group), "end": m.end(p.group), "type": p.type, "space": p.space, "source": p.detector, "confidence": sure, "text": m[p.group], "subtype": p.subtype})
    return out


def detected(texts, strict=False):
    """By force: merged by the naive order, and those of 0.5 and more, the surest first."""
    patterns = S.select_patterns(dense=True)
    patterns = engine.strict_patterns(patterns) if strict else patterns
    return {i: sorted((s for s in S.fold(forced(patterns, t), 0.7) if s["confidence"] >= 0.5), key=lambda s: -s["confidence"]) for i, t in enumerate(texts)}


def masked(spark, text, spans):
    """Left to right, of overlapping spans the first and longest."""
    own, at, out, types = [], 0, "", Counter()
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if not own or s["start"] >= own[-1]["end"]:
            own.append(s)
    if not own:
        return text, types
    puts = spark.createDataFrame([(i, s["type"], s["text"]) for i, s in enumerate(own)], "i int, t string, c string").select("i", redact.replacement(F.col("t"), F.col("c")).alias("p"))
    for s, r in zip(own, sorted(puts.collect()), strict=True):
        out, at = out + text[at : s["start"]] + r.p, s["end"]
        types[s["type"]] += 1
    return out + text[at:], types


@pytest.fixture(scope="module")
def private(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("private"))
    rows = list(enumerate(PRIVATE))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i // 3, i % 3, t) for i, t in rows], "conv_id long, turn int, text string").write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(i, t and f"<p>{t}</p>") for i, t in rows], "page_id long, html string").write.parquet(f"{path}/pages.parquet")
    spans = detected(PRIVATE)
    return path, spans, {i: masked(spark, t, spans[i]) for i, t in rows}


def test_redact_whole(spark, private):
    path, _, want = private
    got = {r.doc_id: (r.redacted_text, r.redactions) for r in Q.QUERIES["redact_documents"](spark, path).collect()}
    assert got == {i: (text, sum(types.values())) for i, (text, types) in want.items()}
    for secret in ("4111111111111111", "Ann Lee", "456-78-9012", "12345678901", "GB29NWBK60161331926819", "0x" + "ab" * 20):
        assert not any(secret in (text or "") for text, _ in got.values()), secret
    counts = {r.type: r.n for r in Q.QUERIES["redaction_type_counts"](spark, path).collect()}
    assert counts == sum((types for _, types in want.values()), Counter())


def test_redact_conversations_whole(spark, private):
    path, _, want = private
    got = {r.conv_id: (r.turns, r.redactions, r.digest) for r in Q.QUERIES["redact_conversations"](spark, path).collect()}
    for c in (0, 1):
        own = [want[i] for i in range(3 * c, 3 * c + 3)]
        assert got[c] == (3, sum(sum(t.values()) for _, t in own), hashlib.md5("|".join(x for x, _ in own if x is not None).encode()).hexdigest())


def test_entities_whole(spark, private):
    path, spans, _ = private
    want = sorted((i, s["start"], s["end"], s["type"]) for i, own in spans.items() for s in own)
    assert sorted((r.doc_id, r.start_position, r.end_position, r.pii_type) for r in Q.QUERIES["entity_csv"](spark, path).collect()) == want
    assert sorted((r.page_id, r.start_char, r.end_char, r.type) for r in Q.QUERIES["html_pii"](spark, path).collect()) == want


def test_audit_whole(spark, tmp_path):
    texts = [f"mail ann{i}@mail.org" for i in range(45)] + ["zz", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["audit_entries"](spark, str(tmp_path)).collect()
    assert sorted(int(r.document_id) for r in got) == list(range(45))
    assert all(r.operation == "redact_json" and "email" in r.types.split(",") and r.entity_count > 0 for r in got)


def test_detect_pipeline(spark, private):
    path, spans, _ = private
    key = lambda r: (r[0], r[1], r[2], r[3], r[4], round(r[5], 6))
    got = Q.QUERIES["detect_pipeline"](spark, path).collect()
    assert sorted(key((r.doc_id, r.start_char, r.end_char, r.type, r.source, r.confidence)) for r in got) == sorted(key((i, s["start"], s["end"], s["type"], s["source"], s["confidence"])) for i, own in spans.items() for s in own)
    assert all(r.adjusted is not None and r.risk for r in got)


def test_strict_keeps_prose(spark, private):
    path, _, _ = private
    spans = detected(PRIVATE, strict=True)
    want = {i: masked(spark, t, spans[i])[0] for i, t in enumerate(PRIVATE)}
    got = {r.doc_id: r.redacted_text for r in Q.QUERIES["redact_strict"](spark, path).collect()}
    assert got == want
    prose = spark.createDataFrame([("a member of parliament spoke about elections; Ann Lee AB123456",)], "text string")
    assert engine.redact(engine.detect(prose, strict=True)).first().redacted_text == "a member of parliament spoke about elections; AXX LXX AXXXXXX6"


# ---------------------------------------------------------------- the scan


WORDS = ["MRN: 12345", "mrn", "Patİent 12345A", "ſwift: ABCDEF12", "Patient ID A12345", "exp 12/27", "4111-1111-1111-1111", "4111111111111112", "ann@mail.org", "b@test.com", "1.2.3.4", "300.1.1.1", "SSN: 456-78-9012", "000-12-3456", "12/31/1990", "2001-02-30", "DOB: 01/02/1980", "Ann Lee", "AB123456", "GB29NWBK60161331926819", "0x" + "ab" * 20, "http://a.org/x", "é", " ", "\n", ",", "45.1, -120.5", "12 Long Street", "٣٤٥-٦٧٨-٩٠١٢", "J45.1", "+1-555-123-4567", "12345678901", "2001:db8:0:0:0:0:0:1", "ABCDE1234F"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(WORDS), max_size=9).map(" ".join))
def test_scan_skips_nothing(text):
    """Patterns that the scan does not try would not match."""
    patterns = [*S.select_patterns(dense=True), *C.SIMPLE, *C.RULER]
    starts, ends, which, sure = P.Scanner(patterns).spans(text)
    assert [(a, b, patterns[i].type, patterns[i].detector, c) for a, b, i, c in zip(starts, ends, which, sure, strict=True)] == [(s["start"], s["end"], s["type"], s["source"], s["confidence"]) for s in forced(patterns, text)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12), st.sampled_from([0.5, 0.7, 0.9])), max_size=20))
def test_merge_of_numbers(rows):
    spans = [{"start": a, "end": a + n, "confidence": c, "source": str(i), "text": str(i)} for i, (a, n, c) in enumerate(rows)]
    a, b, c, base, parts = P.merged([s["start"] for s in spans], [s["end"] for s in spans], [s["confidence"] for s in spans], 0.7)
    got = [(x, y, z, str(w), "+".join(map(str, p))) for x, y, z, w, p in zip(a, b, c, base, parts, strict=True)]
    assert got == [(s["start"], s["end"], s["confidence"], s["text"], s["source"]) for s in S.fold(spans, 0.7)]


VALUES = ["", "a@b.co", "a@b", "@", "a@Test.com", "4111 1111 1111 1111", "4111-1111-1111-1112", "123", "456-78-9012", "SSN: 456 78 9012", "000-12-3456", "666123456", "987654321", "123456789", "1.2.3.4", "1.2.3.256", "1.2.3.", "01.2.3.4", "1.2.3.99999999999", "1/31/1990", "31/1/1990", "2/30/1990", "1-2-90", "1990.2.28", "1990/2/29", "1/2-1990", "12/31/19900", "٣/٤/١٩٩٠"]


def test_plain_validators_equal_the_columns(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "x string")
    x = F.col("x")
    rows = df.select("x", validate.luhn_legacy(x).alias("luhn_legacy"), validate.card(x).alias("card"), validate.email(x).alias("email"), validate.ssn(x).alias("ssn"), validate.ssn_legacy(x).alias("ssn_legacy"), validate.ip(x).alias("ip"), validate.iso_date(x).isNotNull().alias("a_date")).collect()
    for r in rows:
        for name in ("luhn_legacy", "card", "email", "ssn", "ssn_legacy", "ip", "a_date"):
            assert bool(r[name]) == getattr(plain, name)(r.x), (name, r.x)


def test_contexts_and_edge_cases(spark):
    text = "x" * 60 + " ann@mail.org " + "y" * 60
    df = spark.createDataFrame([(1, text, "k"), (2, None, None), (3, "", "k")], "id long, text string, spans string")
    rows = {r.id: r for r in engine.detect(df, types={"email"}, around_col="around").collect()}
    assert [len(rows[i].spans) for i in (1, 2, 3)] == [1, 0, 0] and rows[1].around == [text[11:123]] and rows[2].text is None
    assert engine.redact(engine.detect(df.limit(0))).count() == 0
    assert [r.redacted_text for r in engine.redact(engine.detect(df, types={"email"})).orderBy("id").collect()][1:] == [None, ""]


# ---------------------------------------------------------------- offsets through the steps


PARTS = ["ann@mail.org", "a\x07nn@ma\u200bil.org", " ", "  \t ", "\n", "ﬁne", "e\u0301", "é", "ｱﾞ", "한", "각", "１２", "½", "rn", "l ", " 0 ", "S$", "，", "Page 1 of 2", "CONFIDENTIAL", "www.a-site.org", "x", "Å", "\u0344", "Powered by z"]
ALL_STEPS = list(offsets.CHANGES)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=10).map("".join), st.permutations(ALL_STEPS), st.integers(0, 5))
def test_offset_maps(text, order, n):
    """Each step gives what it says; a place maps to where a map kept for every character has it."""
    steps, now, origin = order[:n], text, [(i, i + 1) for i in range(len(text))]
    for step in steps:
        for find in offsets.CHANGES[step]:
            changes, out, at, new_origin = find(now), [], 0, []
            for a, b, put in changes:
                new_origin += origin[at:a]
                whole = (origin[a][0], origin[b - 1][1])
                new_origin += [origin[a + i] if len(put) == b - a else whole for i in range(len(put))]
                out += [now[at:a], put]
                at = b
            new_origin += origin[at:]
            now, origin = "".join([*out, now[at:]]), new_origin
        if step == "normalize_unicode":
            assert unicodedata.is_normalized("NFKC", now)
        if step == "clean_boilerplate":
            assert len(now) == len(origin)
    seen, maps = offsets.through(text, steps)
    assert seen == now
    for a in range(len(now)):
        for b in range(a + 1, len(now) + 1):
            assert offsets.back(maps, a, b) == (origin[a][0], max(origin[a][0], origin[b - 1][1])), (a, b)


def test_unicode_step_is_nfkc():
    for text in ["ﬁ e\u0301\u0323 ｱﾞ 한 각 ½ Å \u0344 a\u0315\u0300", "\u0300x", "क\u093c", "\u0bc6\u0bbe", "\u1100\u1161\u11a8", "ᄒ" + "ᅡ" + "ᆫ", "ﾊﾟ", "´"]:
        assert offsets.through(text, ["normalize_unicode"])[0] == unicodedata.normalize("NFKC", text)


def test_spans_stand_in_the_original(spark):
    texts = [None, "", "mail  ann\x07@ma\u200bil.org   now", "ﬁﬁ １０.0.0.1 end", "a\t\tb ann@mail.org", "plain ann@mail.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    found = engine.detect(df, types={"email", "ip_address"}, steps=["remove_control_chars", "normalize_whitespace", "normalize_unicode"])
    rows = {r.id: r for r in found.collect()}
    assert found.columns == ["id", "text", "spans"] and {i: r.text for i, r in rows.items()} == dict(enumerate(texts))
    assert all(s.text == r.text[s.start : s.end] for r in rows.values() for s in r.spans)
    assert {i: sorted({s.text for s in r.spans}) for i, r in rows.items()} == {0: [], 1: [], 2: ["ann\x07@ma\u200bil.org"], 3: ["１０.0.0.1"], 4: ["ann@mail.org"], 5: ["ann@mail.org"]}
    assert engine.redact(found).filter("id = 2").first().redacted_text == "mail  aXXX@ma\u200bil.org   now"


def test_unknown_step_is_skipped(spark):
    df = spark.createDataFrame([("ann@mail.org",)], "text string")
    with pytest.warns(UserWarning, match="unknown preprocessing step: polish"):
        assert len(engine.detect(df, types={"email"}, steps=["polish"]).first().spans) == 1


# ---------------------------------------------------------------- knowledge base

KNOWN = [None, "", "mr John Smith of Acme Tools Corp lives at 12 Long Oak Street, see http://a.example/x", "the Corp and the Road 5 mail j@x.org 10.0.0.1 on 1/2/1990" + " filler" * 20]


def test_kb_whole(spark, tmp_path):
    spark.createDataFrame(list(enumerate(KNOWN)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    hits, sure = [], []
    for i, t in enumerate(KNOWN):
        for d in C.KNOWLEDGE:
            for m in (m for p in d.patterns for m in re.finditer("(?i)" + p, t or "")):
                around = t[max(0, m.start() - 50) : m.end() + 50].lower()
                near = any(k.lower() in around for k in d.keywords)
                hits.append((i, m.start(), m.end(), m[0], d.entity_type, d.sensitivity, near))
                sure.append((i, m.start(), d.entity_type, round(min(1.0, 0.7 + C.SENSITIVITY_BOOST[d.sensitivity] + 0.15 * near + 0.1 * (m[0].lower() in [e.lower() for e in d.examples])), 6)))
    got = sorted(tuple(r) for r in Q.QUERIES["kb_pattern_hits"](spark, str(tmp_path)).select("doc_id", "start_char", "end_char", "entity", "type", "sensitivity", "context_match").collect())
    assert got == sorted(hits) and {"person", "organization", "address", "url"} <= {r[4] for r in got}
    assert sorted(tuple(r) for r in Q.QUERIES["kb_confidence"](spark, str(tmp_path)).collect()) == sorted(sure)


def test_kb_phrases_and_relevance(spark):
    texts = ["The social security number and a credit card", "insocial security", "SOCIAL SECURITY, payment", None, "", "call mobile now please " + "filler words " * 20 + "company Acme Tools"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    hits = {(r.id, r.entity_type): r.keywords for r in knowledge.keyword_hits(df, None, "id").collect()}
    assert hits[0, "ssn"] == 2 and hits[0, "credit_card"] == 1 and (1, "ssn") not in hits and hits[2, "ssn"] == 1 and hits[2, "credit_card"] == 1
    rows = {(r.id, r.entity_type): r for r in knowledge.called(df, None, "id").collect()}
    assert rows[5, "phone"].token_score == 1 and rows[5, "phone"].relevant  # among the first ten tokens
    assert rows[5, "organization"].keywords == 1 and rows[5, "organization"].token_score == 0


def test_kb_near_phrases_are_the_windows(spark):
    person = next(d for d in C.KNOWLEDGE if d.entity_type == "person")
    text = "name " + "x" * 44 + " Anna Leeson Name Tom Ray, mr Bob"
    want = set()
    for k in person.keywords:
        for m in re.finditer(rf"\b{re.escape(k)}\b", text, re.IGNORECASE):
            a = max(0, m.start() - 50)
            for x in re.finditer(knowledge.PHRASES["person"], text[a : m.end() + 50]):
                if x.group().lower() not in person.keywords:
                    want.add((a + x.start(), a + x.end(), x.group()))
    got = knowledge.context_spans(spark.createDataFrame([(1, text)], "id long, text string"), [person], "id").collect()
    assert {(r.start_char, r.end_char, r.entity) for r in got} == want and len(got) == len(want)


def test_kb_organisation_runs():
    pattern = next(d for d in C.KNOWLEDGE if d.entity_type == "organization").patterns[0]
    find, whole = knowledge.finder(pattern), re.compile(pattern, re.IGNORECASE).finditer
    for text in ["Acme Inc", "7Acme Inc. and LLC", "aInc x Corp", "Incs, Corp,", "é Inc Inc", "A inc\nB llc (c College", "word " * 50 + "Inc x" + " y" * 50]:
        assert [m.span() for m in find(text)] == [m.span() for m in whole(text)], text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 8)), max_size=12), st.integers(-5, 30), st.integers(0, 12))
def test_kb_union_and_windows(rows, low, n):
    places = [(a, a + m) for a, m in rows]
    covered = {i for a, b in places for i in range(a, b)}
    intervals, total = knowledge.union(iter(places))
    assert total == len(covered)
    merged = []
    for a, b in sorted(places):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    assert intervals == len(merged)
    assert knowledge._within(sorted(places), low, low + n) == any(low <= a < low + n and b <= low + n for a, b in places)


def test_kb_coverage(spark):
    text = "mr John Smith mr, mail ann@mail.org"
    df = spark.createDataFrame([(1, text), (2, None)], "id int, text string")
    own = {}
    for r in knowledge.detect(df, None, "id").collect():
        own.setdefault((r.id, r.type), []).append((r.start_char, r.end_char))
    got = {(r.id, r.type): (r.spans, r.intervals, r.covered) for r in knowledge.coverage(df, None, "id").collect()}
    assert got == {k: (len(v), *knowledge.union(v)) for k, v in own.items()} and {"person", "email"} <= {t for _, t in got}
