"""Registered queries over the given tables and the same results in DuckDB SQL.

The two sides are written apart: SQL finds spans from the lengths of matches and gaps of RE2 (whose word boundary is
ASCII, so non-ASCII letters are folded to ``_`` first), Spark with its own expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dealt, ship
from .functions import normalize, redact, score, tokens, validate
from .operators import knowledge, plugins, report
from .operators import spans as S
from .plans import catalog as C
from .plans import engine
from .sources import blocks, readers, store, writers
from .streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ROWS_ONLY: set[str] = set()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        else:
            ROWS_ONLY.add(name)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ---------------------------------------------------------------- inputs

DOCS = "SELECT doc_id, text FROM documents"
# Sentences for detectors that the documents have nothing for; the same expressions run on both sides.
MEDICAL = "concat('Patient ID: P', lpad(CAST(c_custkey AS STRING), 6, '0'), ' MRN: ', lpad(CAST(c_custkey AS STRING), 7, '0'), ' Insurance ID AB', lpad(CAST(c_custkey AS STRING), 8, '0'), ' DX J45.', CAST(c_custkey % 10 AS STRING))"
FINANCE = "concat('Account: ', lpad(CAST(c_custkey AS STRING), 10, '1'), ' Routing: ', lpad(CAST(c_custkey AS STRING), 9, '0'), ' SWIFT: ABCDEF', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), ' CVV: ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ' Exp: 0', CAST(1 + c_custkey % 9 AS STRING), '/27 IBAN: GB29NWBK', lpad(CAST(c_custkey AS STRING), 14, '6'), ' EIN: 12-', lpad(CAST(c_custkey AS STRING), 7, '3'))"
IDS = "concat('SSN ', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 90 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey AS STRING), 4, '0'), ' pan ABCDE', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), 'F card 4111-1111-1111-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), ' call ', lpad(CAST(c_custkey AS STRING), 3, '5'), '-555-', lpad(CAST(c_custkey AS STRING), 4, '0'), ' for Dr. Ann Lee at ann', CAST(c_custkey AS STRING), '@', CASE WHEN c_custkey % 3 = 0 THEN 'example.com' ELSE 'mail.org' END)"
SPACED = "concat('Page 1 of ', CAST(doc_id AS STRING), chr(10), replace(text, ' ', '  '), chr(9), chr(9), 'burn 0 tail', chr(10), chr(10), 'Powered by x', chr(10), chr(10), 'www.site.org ', chr(7), 'CONFIDENTIAL')"


def _customers(spark, sf_dir, text: str) -> DataFrame:
    """Short rows are few bytes, so their files have few row groups, each a task's at best; dealt out, all cores work on them."""
    return dealt(_table(spark, sf_dir, "customer")).selectExpr("c_custkey", f"{text} AS text")


def _spaced(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "documents").selectExpr("doc_id", f"{SPACED} AS text")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------- SQL of spans


def _found_sql(p: C.Pattern, source: str, key: str, more: str = "") -> str:
    """key, text, start_char, end_char, entity and constants of one pattern; ``key`` is unique in ``source``."""
    f = "regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')"
    r = _q(p.full)
    low = " + instr(h, c) - 1" if p.group else ""
    return (
        f"SELECT {key}, text, CAST(a AS INT) AS start_char, CAST(a + length(c) AS INT) AS end_char, substring(text, CAST(a + 1 AS BIGINT), length(c)) AS entity, {_q(p.type)} AS type, {_q(p.space)} AS space, {_q(p.detector)} AS source, CAST({p.confidence} AS DOUBLE) AS base, {_q(p.subtype)} AS subtype{more} "
        f"FROM (SELECT {key}, c, sum(length(g)) OVER (PARTITION BY {key} ORDER BY i) + coalesce(sum(length(h)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0){low} AS a "
        f"FROM (SELECT {key}, unnest(h) AS h, unnest(c) AS c, unnest(g[1:len(h)]) AS g, unnest(range(1, len(h) + 1)) AS i FROM (SELECT {key}, regexp_extract_all(f, {r}, 0) AS h, regexp_extract_all(f, {r}, {p.group}) AS c, string_split_regex(f, {r}) AS g FROM (SELECT {key}, {f} AS f FROM ({source}) WHERE text IS NOT NULL) WHERE regexp_matches(f, {r})))) JOIN ({source}) USING ({key})"
    )


_D = "regexp_replace(entity, '[^0-9]', '', 'g')"


def _luhn_sql(d: str) -> str:
    digit = f"CAST(substr({d}, CAST(length({d}) - j AS BIGINT), 1) AS INT)"
    return f"(list_sum(list_transform(range(0, length({d})), lambda j: CASE WHEN j % 2 = 0 THEN {digit} ELSE CASE WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END END)) % 10 = 0)"


CARD_OK = f"(length({_D}) BETWEEN 13 AND 19 AND coalesce({_luhn_sql(_D)}, false))"
EMAIL_OK = "(contains(entity, '@') AND contains(split_part(lower(entity), '@', -1), '.') AND split_part(lower(entity), '@', -1) NOT IN ('example.com', 'test.com', 'domain.com'))"
SSN_OK = f"(length({_D}) = 9 AND substr({_D}, 1, 3) NOT IN ('000', '666') AND substr({_D}, 1, 1) <> '9' AND substr({_D}, 4, 2) <> '00' AND substr({_D}, 6, 4) <> '0000')"
SSN_LEGACY = f"(length({_D}) = 9 AND substr({_D}, 1, 3) <> '000' AND substr({_D}, 4, 2) <> '00' AND substr({_D}, 6, 4) <> '0000' AND {_D} NOT IN ('123456789', '987654321'))"
IP_OK = "(len(string_split(entity, '.')) = 4 AND len(list_filter(string_split(entity, '.'), lambda x: coalesce(TRY_CAST(x AS INT) BETWEEN 0 AND 255, false))) = 4)"
_FORMATS = ("%m/%d/%Y", "%m-%d-%Y", "%m.%d.%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y", "%Y/%m/%d", "%Y-%m-%d", "%Y.%m.%d")
DATE_OK = f"(regexp_full_match(entity, '([0-9]{{1,2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{4}}|[0-9]{{4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}})') AND coalesce({', '.join(f'try_strptime(entity, {_q(x)})' for x in _FORMATS)}) IS NOT NULL)"


def spans_sql(patterns: list[C.Pattern], source: str = DOCS, key: str = "doc_id") -> str:
    """All span rows with confidence and the detectors' own filters."""
    rows = " UNION ALL ".join(_found_sql(p, source, key) for p in patterns)
    valid = f"CASE WHEN type = 'credit_card' THEN {CARD_OK} WHEN type = 'email' THEN {EMAIL_OK} WHEN type = 'ssn' THEN {SSN_OK} WHEN type IN ('date', 'date_of_birth') THEN {DATE_OK} END"
    keep = f"(source <> 'rule_based' OR CASE WHEN type = 'credit_card' THEN {_luhn_sql(_D)} WHEN type = 'ssn' THEN {SSN_LEGACY} WHEN type = 'ip_address' THEN {IP_OK} ELSE true END) AND (source <> 'enhanced' OR length(entity) >= 2)"
    return f"SELECT {key}, text, start_char, end_char, entity, type, space, source, subtype, round(CASE WHEN source <> 'enhanced' OR ok IS NULL THEN base WHEN ok THEN least(1.0, base * 1.2) ELSE base * 0.5 END, 6) AS confidence FROM (SELECT *, {valid} AS ok FROM ({rows}) WHERE {keep})"


COLUMNS = ("start_char", "end_char", "type", "source", "confidence", "entity")


def _rows(docs: DataFrame, patterns: list[C.Pattern], key: str = "doc_id", *more: str, **columns) -> DataFrame:
    return S.extract_rows(docs, patterns, key, *more, **columns)


def _span_query(name: str, patterns: list[C.Pattern], text: str | None = None) -> None:
    key = "c_custkey" if text else "doc_id"
    source = f"SELECT c_custkey, {text} AS text FROM customer" if text else DOCS

    @query(name, f"SELECT {key}, {', '.join(COLUMNS)} FROM ({spans_sql(patterns, source, key)})")
    def run(spark, sf_dir):
        docs = _customers(spark, sf_dir, text) if text else _table(spark, sf_dir, "documents").select("doc_id", "text")
        return _rows(docs, patterns, key, columns=COLUMNS)


def _of(patterns: list[C.Pattern], *types: str) -> list[C.Pattern]:
    return [p for p in patterns if p.type in types]


SPARSE = [p for p in C.ENHANCED if p.type not in C.DENSE_TYPES]
MAIN = [*_of(SPARSE, "email", "credit_card", "ip_address", "phone"), *C.LEGACY]

_span_query("email_spans", _of(C.LEGACY, "email"))
_span_query("ipv4_spans", _of(C.LEGACY, "ip_address"))
_span_query("card_spans", _of(SPARSE, "credit_card"))
_span_query("digits_spans", _of(SPARSE, "bank_account"))
_span_query("phone_simple_spans", _of(C.SIMPLE, "phone"))
_span_query("person_spans", C.RULER, IDS)
_span_query("simple_detector", C.SIMPLE)
_span_query("legacy_detector", C.LEGACY)
_span_query("enhanced_detector", C.ENHANCED)
_span_query("person_name_spans", _of(C.ENHANCED, "person_name"))
_span_query("enhanced_type_filter", _of(SPARSE, "email", "ip_address"))
_span_query("crypto_spans", _of(C.FINANCIAL, "crypto_address"))
_span_query("healthcare_ids", C.HEALTHCARE, MEDICAL)
_span_query("financial_ids", _of(C.FINANCIAL, "credit_card", "bank_account"), FINANCE)
_span_query("iban_swift", [*_of(C.FINANCIAL, "iban"), *[p for p in C.FINANCIAL if p.subtype in ("swift_code", "routing_number")]], FINANCE)
_span_query("tax_ids", _of(C.FINANCIAL, "tax_id"), FINANCE)
_span_query("ssn_pan_ids", [*_of(C.LEGACY, "ssn", "pan", "credit_card", "phone", "email"), *_of(SPARSE, "ssn", "credit_card", "email")], IDS)

CUSTOM = [C.Pattern("custom", "custom", r"\bsrc-?\d+\b", 0.9), C.Pattern("custom", "junk", r"[%#]{3,}", 0.8)]


@query("custom_rules", f"SELECT doc_id, {', '.join(COLUMNS)} FROM ({spans_sql(CUSTOM)})")
def custom_rules(spark, sf_dir):
    rules = engine.Rules()
    for p in CUSTOM:
        rules.add(p.regex, p.type, p.confidence)
    rules.add("(", "broken")
    return _rows(_table(spark, sf_dir, "documents").select("doc_id", "text"), rules.patterns).select("doc_id", *COLUMNS)


@query("dense_spans", "SELECT doc_id, n, first_start, last_end FROM (SELECT doc_id, len(regexp_extract_all(f, '(?i)\\b[A-Z0-9]{6,12}\\b')) AS n, CAST(length(string_split_regex(f, '(?i)\\b[A-Z0-9]{6,12}\\b')[1]) AS INT) AS first_start, CAST(length(f) - length(string_split_regex(f, '(?i)\\b[A-Z0-9]{6,12}\\b')[-1]) AS INT) AS last_end FROM (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS f FROM documents)) WHERE n > 0")
def dense_spans(spark, sf_dir):
    patterns = _of(C.ENHANCED, "health_insurance_id")
    found = S.extract_all(_table(spark, sf_dir, "documents").select("doc_id", "text"), patterns)
    return found.filter(F.size("spans") > 0).select("doc_id", F.size("spans").cast("long").alias("n"), F.array_min(F.transform("spans", lambda s: s["start"])).alias("first_start"), F.array_max(F.transform("spans", lambda s: s["end"])).alias("last_end"))


# ---------------------------------------------------------------- validators

CARDS = "concat('4', lpad(CAST(c_custkey * 7919 % 100000000000000 AS STRING), 14, '0'), CAST(c_custkey % 10 AS STRING))"


@query("card_luhn", f"SELECT c_custkey, entity AS card, {CARD_OK} AS valid, {_luhn_sql(_D)} AS legacy FROM (SELECT c_custkey, {CARDS} AS entity FROM customer)")
def card_luhn(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{CARDS} AS card").select("c_custkey", "card", validate.card(F.col("card")).alias("valid"), validate.luhn_legacy(F.col("card")).alias("legacy"))


IPS = "concat(CAST(o_orderkey % 300 AS STRING), '.', CAST(o_custkey % 260 AS STRING), '.7.', CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '9' END)"


@query("ipv4_valid", f"SELECT o_orderkey, entity AS ip, {IP_OK} AS valid FROM (SELECT o_orderkey, {IPS} AS entity FROM orders)")
def ipv4_valid(spark, sf_dir):
    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{IPS} AS ip").select("o_orderkey", "ip", validate.ip(F.col("ip")).alias("valid"))


MAILS = "concat('u', CAST(c_custkey AS STRING), CASE WHEN c_custkey % 11 = 0 THEN '' ELSE '@' END, CASE WHEN c_custkey % 5 = 0 THEN 'Example.com' WHEN c_custkey % 5 = 1 THEN 'nodot' ELSE 'mail.org' END)"


@query("email_domain_valid", f"SELECT c_custkey, entity AS email, {EMAIL_OK} AS valid FROM (SELECT c_custkey, {MAILS} AS entity FROM customer)")
def email_domain_valid(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{MAILS} AS email").select("c_custkey", "email", validate.email(F.col("email")).alias("valid"))


SSNS = "concat(lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), '-', lpad(CAST(c_custkey % 10 AS STRING), 2, '0'), '-', lpad(CAST(c_custkey % 9999 AS STRING), 4, '0'))"


@query("ssn_valid", f"SELECT c_custkey, entity AS ssn, {SSN_OK} AS valid, {SSN_LEGACY} AS legacy FROM (SELECT c_custkey, {SSNS} AS entity FROM customer)")
def ssn_valid(spark, sf_dir):
    return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{SSNS} AS ssn").select("c_custkey", "ssn", validate.ssn(F.col("ssn")).alias("valid"), validate.ssn_legacy(F.col("ssn")).alias("legacy"))


DATES = "concat(CAST(1 + o_orderkey % 14 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '.' END, CAST(1 + o_custkey % 33 AS STRING), CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '.' END, '1994')"


@query("date_valid", f"SELECT o_orderkey, d, strftime(coalesce(try_strptime(d, '%m/%d/%Y'), try_strptime(d, '%m-%d-%Y'), try_strptime(d, '%m.%d.%Y'), try_strptime(d, '%d/%m/%Y'), try_strptime(d, '%d-%m-%Y'), try_strptime(d, '%d.%m.%Y')), '%Y-%m-%d') AS iso FROM (SELECT o_orderkey, {DATES} AS d FROM orders)")
def date_valid(spark, sf_dir):
    return _table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{DATES} AS d").select("o_orderkey", "d", validate.iso_date(F.col("d")).alias("iso"))


EXPLAINED = _of(C.ENHANCED, "credit_card", "email", "ssn", "date", "ip_address")
_DOMAIN = "split_part(lower(entity), '@', -1)"
_WHY = f"""CASE WHEN length(entity) < 2 THEN 'Text too short'
  WHEN type = 'credit_card' THEN CASE WHEN length({_D}) NOT BETWEEN 13 AND 19 THEN 'Invalid length' WHEN NOT {_luhn_sql(_D)} THEN 'Failed Luhn check' END
  WHEN type = 'email' THEN CASE WHEN NOT contains(entity, '@') OR NOT contains({_DOMAIN}, '.') THEN 'Invalid format' WHEN {_DOMAIN} IN ('example.com', 'test.com', 'domain.com') THEN 'Test domain' END
  WHEN type = 'ssn' THEN CASE WHEN length({_D}) <> 9 THEN 'Invalid length' WHEN substr({_D}, 1, 3) IN ('000', '666') THEN 'Invalid first group' WHEN substr({_D}, 1, 1) = '9' THEN 'Invalid first digit' WHEN substr({_D}, 4, 2) = '00' THEN 'Invalid second group' WHEN substr({_D}, 6, 4) = '0000' THEN 'Invalid third group' END
  WHEN type = 'date' THEN CASE WHEN NOT {DATE_OK} THEN 'Failed to parse date' END
  ELSE 'No validation available' END"""
# Cards, numbers and dates that pass and fail each test.
PROOFS = f"concat({IDS}, ' on ', CAST(1 + c_custkey % 14 AS STRING), '/', CAST(1 + c_custkey % 33 AS STRING), '/1994 from 10.0.0.', CAST(c_custkey % 300 AS STRING), ' mail x@test.com, ', 'SSN 9', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-12-3456')"


@query("validation_reasons", f"SELECT c_custkey, start_char, type, entity, CASE WHEN why IS NULL THEN 'valid' WHEN why IN ('Text too short', 'No validation available') THEN 'unknown' ELSE 'invalid' END AS verdict, CASE WHEN why IS NULL THEN CASE WHEN type = 'credit_card' THEN 'luhn' ELSE 'format' END END AS method, why AS reason FROM (SELECT *, {_WHY} AS why FROM ({spans_sql(EXPLAINED, f'SELECT c_custkey, {PROOFS} AS text FROM customer', 'c_custkey')}))")
def validation_reasons(spark, sf_dir):
    """Each span's validation: passed or not, by which test, or why not."""
    rows = _rows(_customers(spark, sf_dir, PROOFS), EXPLAINED, "c_custkey", columns=("start_char", "type", "entity"))
    own = rows.withColumn("v", validate.explained(F.col("type"), F.col("entity")))
    verdict = F.when(F.col("v.valid"), "valid").when(~F.col("v.valid"), "invalid").otherwise("unknown")
    return own.select("c_custkey", "start_char", "type", "entity", verdict.alias("verdict"), "v.method", "v.reason")


# ---------------------------------------------------------------- context, risk, confidence

_MAIN_SQL = spans_sql(MAIN)


def _main(spark, sf_dir, *more: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "documents").select("doc_id", "text", *[m for m in more if m != "text"]), MAIN, "doc_id", *more)


def _main_around(spark, sf_dir) -> DataFrame:
    return _rows(_table(spark, sf_dir, "documents").select("doc_id", "text"), MAIN, columns=(*S.COLUMNS, "context"))


@query("context_windows", f"SELECT doc_id, start_char, type, source, substring(text, greatest(0, start_char - 50) + 1, start_char - greatest(0, start_char - 50)) AS before, substring(text, end_char + 1, 50) AS after, concat('...', substring(text, greatest(0, start_char - 30) + 1, start_char - greatest(0, start_char - 30)), '**', entity, '**...') AS short FROM ({_MAIN_SQL})")
def context_windows(spark, sf_dir):
    text, a, b = F.col("text"), F.col("start_char"), F.col("end_char")  # three windows of the text itself
    return _main(spark, sf_dir, "text").select("doc_id", "start_char", "type", "source", score.before(text, a).alias("before"), score.after(text, b).alias("after"), score.domain_context(text, a, b).alias("short"))


_CONTEXT = "substring(text, greatest(0, start_char - 50) + 1, end_char + 50 - greatest(0, start_char - 50))"
_NEGATED = f"regexp_matches(lower({_CONTEXT}), 'not|fake|example|test|dummy|sample')"


@query("negation_flag", f"SELECT doc_id, start_char, type, source, {_NEGATED} AS negated FROM ({_MAIN_SQL})")
def negation_flag(spark, sf_dir):
    return _main_around(spark, sf_dir).select("doc_id", "start_char", "type", "source", validate.negated(F.col("context")).alias("negated"))


_BASE_RISK = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.RISK.items()) + " ELSE 'medium' END"


def _risk_sql(compat: bool = True) -> str:
    base = f"(CASE WHEN space = 'entity' THEN {_BASE_RISK} ELSE 'medium' END)" if compat else f"({_BASE_RISK})"
    lower = "CASE " + base + " WHEN 'critical' THEN 'high' WHEN 'high' THEN 'medium' ELSE 'low' END"
    return f"CASE WHEN confidence >= 0.9 THEN {base} WHEN confidence >= 0.7 THEN {lower} ELSE 'low' END"


@query("risk_join", f"SELECT doc_id, start_char, type, source, {_risk_sql()} AS risk, {_risk_sql(False)} AS strict_risk FROM ({_MAIN_SQL})")
def risk_join(spark, sf_dir):
    level = lambda strict: score.risk(F.col("type"), F.col("space"), F.col("confidence"), strict)
    return _main(spark, sf_dir).select("doc_id", "start_char", "type", "source", level(False).alias("risk"), level(True).alias("strict_risk"))


_FORMAT = f"(space <> 'entity' OR CASE type WHEN 'email' THEN contains(entity, '@') AND contains(entity, '.') WHEN 'phone' THEN length({_D}) BETWEEN 7 AND 15 WHEN 'ssn' THEN length({_D}) = 9 ELSE true END)"
_PENALTY = f"confidence * CASE WHEN {_FORMAT} THEN 1.0 ELSE 0.7 END * CASE WHEN {_NEGATED} THEN 0.5 ELSE 1.0 END * CASE WHEN length(entity) BETWEEN 1 AND 100 THEN 1.0 ELSE 0.8 END"
_ADJUSTED = f"round(CASE WHEN source = 'rule_based' AND confidence >= 0.9 THEN least(1.0, ({_PENALTY}) * 1.1) ELSE {_PENALTY} END, 3)"


@query("adjusted_confidence", f"SELECT doc_id, start_char, type, source, {_ADJUSTED} AS adjusted FROM ({_MAIN_SQL})")
def adjusted_confidence(spark, sf_dir):
    return S.enrich(_main_around(spark, sf_dir)).select("doc_id", "start_char", "type", "source", "adjusted")


# ---------------------------------------------------------------- merge, threshold

MERGED = _of(SPARSE, "ip_address", "email", "credit_card")
_MERGE_SQL = f"""
WITH RECURSIVE c AS (SELECT doc_id, start_char AS s, end_char AS e, confidence AS k, source AS src, row_number() OVER (PARTITION BY doc_id ORDER BY start_char, ord) AS n FROM (SELECT * FROM ({{}}))),
f(doc_id, n, state) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(s INT, e INT, k DOUBLE, src VARCHAR)[]) FROM (SELECT DISTINCT doc_id FROM c)
  UNION ALL
  SELECT f.doc_id, c.n, CASE WHEN p IS NULL THEN list_append(f.state, {{{{'s': c.s, 'e': c.e, 'k': c.k, 'src': c.src}}}})
    ELSE list_transform(f.state, lambda x, i: CASE WHEN i = p THEN {{{{'s': least(x.s, c.s), 'e': greatest(x.e, c.e), 'k': least(1.0, (x.k * (x.e - x.s) + c.k * (c.e - c.s)) / (x.e - x.s + c.e - c.s)), 'src': x.src || '+' || c.src}}}} ELSE x END) END
  FROM (SELECT f.*, c.s AS cs, c.e AS ce, (list_filter(range(1, len(f.state) + 1), lambda i: (least(f.state[i].e, c.e) - greatest(f.state[i].s, c.s)) > 0 AND (least(f.state[i].e, c.e) - greatest(f.state[i].s, c.s)) / (greatest(f.state[i].e, c.e) - least(f.state[i].s, c.s)) >= 0.7))[1] AS p FROM f JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1) f
  JOIN c ON c.doc_id = f.doc_id AND c.n = f.n + 1
)
SELECT doc_id, x.s AS start_char, x.e AS end_char, round(x.k, 6) AS confidence, x.src AS source
FROM (SELECT doc_id, unnest(state) AS x FROM (SELECT doc_id, arg_max(state, n) AS state FROM f GROUP BY doc_id))
"""


def _ordered_sql(patterns: list[C.Pattern]) -> str:
    """Span rows with the pattern's number, which orders spans of one start."""
    return " UNION ALL ".join(f"SELECT *, {i} AS ord FROM ({spans_sql([p])})" for i, p in enumerate(patterns))


@query("merged_spans", _MERGE_SQL.format(_ordered_sql(MERGED)).replace("{{", "{").replace("}}", "}"))
def merged_spans(spark, sf_dir):
    df = S.extract_all(_table(spark, sf_dir, "documents").select("doc_id", "text"), MERGED, merge_at=0.7)
    return S.explode(df, "doc_id").select("doc_id", "start_char", "end_char", F.round("confidence", 6).alias("confidence"), "source")


@query("threshold_sorted", f"SELECT doc_id, start_char, end_char, type, source, confidence FROM ({_MAIN_SQL}) WHERE confidence >= 0.5")
def threshold_sorted(spark, sf_dir):
    rows = _main(spark, sf_dir).filter("confidence >= 0.5").select("doc_id", "start_char", "end_char", "type", "source", "confidence")
    return rows.orderBy(F.col("confidence").desc(), "doc_id", "start_char", "end_char", "type", "source")


@query("overlap_pairs", f"WITH s AS (SELECT * FROM ({_MAIN_SQL})) SELECT a.doc_id, a.start_char, b.start_char AS other_start, a.source, b.source AS other_source, a.type, b.type AS other_type, round((least(a.end_char, b.end_char) - greatest(a.start_char, b.start_char)) / (greatest(a.end_char, b.end_char) - least(a.start_char, b.start_char)), 6) AS ratio FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.start_char < b.end_char AND b.start_char < a.end_char AND (a.source < b.source)")
def overlap_pairs(spark, sf_dir):
    df = S.extract_all(_table(spark, sf_dir, "documents").select("doc_id", "text"), MAIN)
    pairs = F.flatten(F.transform("spans", lambda a: F.transform(F.filter("spans", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & (a["source"] < b["source"])), lambda b: F.struct(a["start"].alias("start_char"), b["start"].alias("other_start"), a["source"].alias("source"), b["source"].alias("other_source"), a["type"].alias("type"), b["type"].alias("other_type"), F.round(S.overlap_ratio(a, b), 6).alias("ratio")))))
    return df.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", "p.*")


# ---------------------------------------------------------------- reports

_SUM = f"SELECT d.doc_id, coalesce(n, 0) AS total_entities, coalesce(h, 0) AS high_confidence_entities, CAST(length(d.text) AS INT) AS text_length, round(100.0 * coalesce(n, 0) / greatest(len(list_filter(regexp_split_to_array(d.text, '\\s+'), lambda w: w <> '')), 1), 2) AS detection_coverage FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (confidence >= 0.8) AS h FROM ({_MAIN_SQL}) GROUP BY doc_id) s USING (doc_id)"


@query("coverage", _SUM)
def coverage(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return report.summary(docs, _rows(docs, MAIN)).drop("entity_types")


@query("type_counts", f"SELECT type, count(*) AS n FROM ({_MAIN_SQL}) GROUP BY type")
def type_counts(spark, sf_dir):
    return report.counts(_main(spark, sf_dir), "type")


@query("type_counts_by_lang", f"SELECT lang, type, count(*) AS n, count(DISTINCT entity) AS distinct_entities FROM ({_MAIN_SQL}) JOIN documents USING (doc_id) GROUP BY lang, type")
def type_counts_by_lang(spark, sf_dir):
    return _main(spark, sf_dir, "lang").groupBy("lang", "type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("entity").alias("distinct_entities"))


@query("risk_distribution", f"SELECT risk, count(*) AS n FROM (SELECT {_risk_sql()} AS risk FROM ({_MAIN_SQL})) GROUP BY risk")
def risk_distribution(spark, sf_dir):
    return report.counts(_main(spark, sf_dir).withColumn("risk", score.risk(F.col("type"), F.col("space"), F.col("confidence"))), "risk")


@query("stats_by_detector", f"WITH s AS (SELECT * FROM ({_MAIN_SQL})) SELECT 'detector' AS kind, source AS name, count(*) AS n FROM s GROUP BY source UNION ALL SELECT 'type', type, count(*) FROM s GROUP BY type UNION ALL SELECT 'confidence', concat(CAST(CAST(floor(confidence * 10) * 10 AS INT) AS STRING), '%-', CAST(CAST(floor(confidence * 10) * 10 + 9 AS INT) AS STRING), '%'), count(*) FROM s GROUP BY 2")
def stats_by_detector(spark, sf_dir):
    return report.statistics(_main(spark, sf_dir))


@query("pii_rollup", f"SELECT source AS src, type, count(*) AS n FROM ({_MAIN_SQL}) GROUP BY ROLLUP (source, type)")
def pii_rollup(spark, sf_dir):
    return report.rollup(_main(spark, sf_dir).withColumnRenamed("source", "src"), "src", "type")


_VOTE = f"SELECT doc_id, start_char, end_char, type, count(*) AS votes, round(CASE WHEN count(*) > 1 THEN least(1.0, avg(confidence) + least(0.2, 0.1 * (count(*) - 1))) ELSE avg(confidence) END, 6) AS confidence, array_to_string(list_sort(list(source)), '+') AS sources FROM ({_MAIN_SQL}) GROUP BY ALL"


@query("ensemble_vote", _VOTE)
def ensemble_vote(spark, sf_dir):
    return S.ensemble(_main(spark, sf_dir), "doc_id").withColumn("sources", F.array_join("sources", "+"))


# ---------------------------------------------------------------- knowledge base

_KB_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, start_char, end_char, entity, type, {_q(d.sensitivity)} AS sensitivity, {' OR '.join(f'contains(around, {_q(k)})' for k in d.keywords)} AS context_match, round(least(1.0, 0.7 + {C.SENSITIVITY_BOOST[d.sensitivity]} + CASE WHEN {' OR '.join(f'contains(around, {_q(k)})' for k in d.keywords)} THEN 0.15 ELSE 0 END + CASE WHEN lower(entity) IN ({', '.join(_q(e.lower()) for e in d.examples)}) THEN 0.1 ELSE 0 END), 6) AS confidence FROM (SELECT *, lower({_CONTEXT}) AS around FROM ({_found_sql(C.Pattern('rag', d.entity_type, r, 0.7, True), DOCS, 'doc_id')}))"
    for d in C.KNOWLEDGE
    for r in d.patterns
)


@query("kb_pattern_hits", f"SELECT doc_id, start_char, end_char, entity, type, sensitivity, context_match FROM ({_KB_ROWS})")
def kb_pattern_hits(spark, sf_dir):
    return knowledge.pattern_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), None, "doc_id", columns=("start_char", "end_char", "entity", "type", "sensitivity", "context_match"))


@query("kb_confidence", f"SELECT doc_id, start_char, type, confidence FROM ({_KB_ROWS})")
def kb_confidence(spark, sf_dir):
    return knowledge.pattern_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), None, "doc_id", columns=("start_char", "type", "confidence"))


NOTES = "concat(CASE WHEN c_custkey % 2 = 0 THEN 'Contact email of ' ELSE 'Company name: ' END, 'Ann Lee, ', c_mktsegment, ' Corp. Mobile phone number ', CAST(c_custkey AS STRING), ' server address; social security', CASE WHEN c_custkey % 3 = 0 THEN ' number' ELSE 's' END, ' and credit card of Bob Stone')"
_NOTES_SRC = f"SELECT c_custkey, {NOTES} AS text FROM customer"


def _keywords_sql(source: str, key: str) -> str:
    """key, entity_type, keywords: keywords and key phrases that stand in a text as whole words, each on its own."""
    f = "lower(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g'))"
    per = [f"SELECT {key}, {_q(d.entity_type)} AS entity_type, " + " + ".join(f"CAST(regexp_matches(f, {_q(chr(92) + 'b' + k + chr(92) + 'b')}) AS BIGINT)" for k in d.keywords) + f" AS keywords FROM (SELECT {key}, {f} AS f FROM ({source}))" for d in C.KNOWLEDGE]
    return " UNION ALL ".join(per)


def _called_sql(source: str, key: str) -> str:
    """Token score, keywords and pattern hits of every definition with any of them."""
    words = f"SELECT {key}, unnest(list_filter(regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g')), '\\w+'), lambda w: length(w) >= 4)[1:10]) AS word FROM ({source})"
    terms = ", ".join(f"({_q(d.entity_type)}, {_q(w)})" for d in C.KNOWLEDGE for w in sorted(knowledge.terms(d)))
    hits = " UNION ALL ".join(f"SELECT {key}, type AS entity_type FROM ({_found_sql(C.Pattern('rag', d.entity_type, r, 0.7, True), source, key)})" for d in C.KNOWLEDGE for r in d.patterns)
    return f"""
SELECT * FROM (
  SELECT {key}, entity_type, coalesce(token_score, 0) AS token_score, coalesce(keywords, 0) AS keywords, coalesce(pattern_hits, 0) AS pattern_hits
  FROM ({_keywords_sql(source, key)}) k
  LEFT JOIN (SELECT {key}, entity_type, count(*) AS token_score FROM ({words}) JOIN (VALUES {terms}) t(entity_type, word) USING (word) GROUP BY ALL) USING ({key}, entity_type)
  LEFT JOIN (SELECT {key}, entity_type, count(*) AS pattern_hits FROM ({hits}) GROUP BY ALL) USING ({key}, entity_type)
) WHERE token_score + keywords + pattern_hits > 0
"""


@query("kb_keyword_join", f"SELECT c_custkey, entity_type, keywords FROM ({_keywords_sql(_NOTES_SRC, 'c_custkey')}) WHERE keywords > 0")
def kb_keyword_join(spark, sf_dir):
    return knowledge.keyword_hits(_customers(spark, sf_dir, NOTES), None, "c_custkey")


@query("kb_relevant", f"SELECT *, token_score + pattern_hits > 0 AS relevant FROM ({_called_sql(DOCS, 'doc_id')})")
def kb_relevant(spark, sf_dir):
    return knowledge.called(_table(spark, sf_dir, "documents").select("doc_id", "text"), None, "doc_id")


def _context_sql(source: str, key: str) -> str:
    """Phrases in the windows around keywords of the definitions that a text calls for, each once."""
    parts = []
    for d in C.KNOWLEDGE:
        if d.entity_type in knowledge.PHRASES:
            at = " UNION ".join(f"SELECT {key}, start_char AS s, end_char AS e FROM ({_found_sql(C.Pattern('k', 'k', chr(92) + 'b' + k + chr(92) + 'b', 0.6, True), source, key)})" for k in d.keywords)
            windows = f"SELECT {key}, s, e, greatest(0, s - 50) AS off, substring(text, greatest(0, s - 50) + 1, e + 50 - greatest(0, s - 50)) AS text FROM ({at}) JOIN ({source}) USING ({key})"
            found = _found_sql(C.Pattern("p", d.entity_type, knowledge.PHRASES[d.entity_type], 0.6), windows, f"{key}, s, e")
            parts.append(f"SELECT DISTINCT {key}, CAST(start_char + greatest(0, s - 50) AS INT) AS start_char, CAST(end_char + greatest(0, s - 50) AS INT) AS end_char, entity, type FROM ({found}) WHERE lower(entity) NOT IN ({', '.join(_q(k) for k in d.keywords)})")
    gate = f"SELECT {key}, entity_type AS type FROM ({_called_sql(source, key)}) WHERE token_score + pattern_hits > 0"
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) SEMI JOIN ({gate}) USING ({key}, type)"


@query("kb_context_range_join", f"SELECT *, CAST(0.6 AS DOUBLE) AS confidence FROM ({_context_sql(_NOTES_SRC, 'c_custkey')})")
def kb_context_range_join(spark, sf_dir):
    return knowledge.context_spans(_customers(spark, sf_dir, NOTES), None, "c_custkey")


_KB_ALL = f"SELECT doc_id, start_char, end_char, type FROM ({_KB_ROWS}) UNION ALL SELECT doc_id, start_char, end_char, type FROM ({_context_sql(DOCS, 'doc_id')})"


@query(
    "kb_driver",
    f"""
WITH s AS (SELECT *, max(end_char) OVER (PARTITION BY doc_id, type ORDER BY start_char, end_char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({_KB_ALL}))
SELECT doc_id, type, count(*) AS spans, count(*) FILTER (reach IS NULL OR start_char > reach) AS intervals,
       CAST(sum(greatest(0, end_char - greatest(start_char, coalesce(reach, start_char)))) AS BIGINT) AS covered
FROM s GROUP BY doc_id, type
""",
)
def kb_driver(spark, sf_dir):
    """Pattern and context spans of the relevant definitions, and the union of their intervals."""
    return knowledge.coverage(_table(spark, sf_dir, "documents").select("doc_id", "text"), None, "doc_id")


# ---------------------------------------------------------------- plug-ins, token windows


def _registry() -> plugins.Registry:
    """The rules of two catalogs, and a tagging model of our own that raises on texts with a tab."""

    def load():
        import re

        word = re.compile(r"\w+|[^\w\s]")

        def tag(piece):
            if "\t" in piece:
                raise ValueError("tab")
            last = "O"
            for m in word.finditer(piece):
                name = m[0][:1].isupper() and len(m[0]) > 1
                last = ("I-PER" if last != "O" else "B-PER") if name else "O"
                yield m.start(), m.end(), last, 0.6

        return tag

    return plugins.Registry(plugins.of_patterns("rules", C.LEGACY), plugins.of_patterns("simple", C.SIMPLE), plugins.tagger("capitals", load))


@query("plugin_detection")
def plugin_detection(spark, sf_dir):
    """Spans and errors of detectors that run side by side."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = _registry().detect(docs)
    return found.select("doc_id", F.size("spans").alias("spans"), F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s["source"]))), ",").alias("sources"), F.array_join(F.transform("errors", lambda e: e["detector"]), ",").alias("errors"))


_TOKENS = "regexp_extract_all({}, '[A-Za-z0-9_]+|[^\\sA-Za-z0-9_]')"
_AROUND = f"list_concat(list_concat({_TOKENS.format('substring(text, 1, start_char)')}[-3:], {_TOKENS.format('entity')}), {_TOKENS.format('substring(text, end_char + 1)')}[1:3])"
_STRONG = " OR ".join(f"(label = '{k}' AND list_has_any(around, [{', '.join(map(_q, v))}]))" for k, v in C.INDICATORS.items() if k in ("PERSON", "ORG"))
_LABEL = "CASE type WHEN 'person' THEN 'PERSON' WHEN 'organization' THEN 'ORG' ELSE 'LOC' END"


@query(
    "token_windows",
    f"""
WITH s AS (SELECT c_custkey, start_char, entity, {_LABEL} AS label, list_transform({_AROUND}, lambda t: lower(t)) AS around FROM ({spans_sql(C.RULER, f'SELECT c_custkey, {IDS} AS text FROM customer', 'c_custkey')}))
SELECT c_custkey, start_char, entity, array_to_string(around, ' ') AS around, strong,
       round(least(1.0, 0.75 + CASE WHEN length(entity) > 2 THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches(entity, '[A-Z]') AND NOT regexp_matches(entity, '[A-Za-z][A-Z]') AND NOT regexp_matches(entity, '(^|[^A-Za-z])[a-z]') THEN 0.1 ELSE 0 END
             + CASE WHEN strong THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches(entity, '[A-Z]') AND NOT regexp_matches(entity, '[a-z]') AND length(entity) > 1 THEN 0.05 ELSE 0 END), 6) AS confidence
FROM (SELECT *, coalesce({_STRONG}, false) AS strong FROM s)
""",
)
def token_windows(spark, sf_dir):
    """Persons and organisations with the tokens around them, and the confidence that these give."""
    found = _rows(_customers(spark, sf_dir, IDS), C.RULER, "c_custkey", "text")
    label = F.when(F.col("type") == "person", "PERSON").when(F.col("type") == "organization", "ORG").otherwise("LOC")
    near = found.withColumn("label", label).withColumn("around", tokens.window(F.col("text"), F.col("start_char"), F.col("end_char")))
    strong = near.withColumn("strong", tokens.strong_context(F.col("label"), F.col("around")))
    return strong.select("c_custkey", "start_char", "entity", F.array_join("around", " ").alias("around"), "strong", tokens.tagged_confidence(F.col("label"), F.col("entity"), F.col("strong")).alias("confidence"))


# ---------------------------------------------------------------- compliance, semi and anti joins

_BRIDGE = ", ".join(f"({_q(f)}, {_q(t)})" for f, types in C.FRAMEWORKS.items() for t in types)


@query("compliance_matrix", f"SELECT framework, b.pii_type, CAST(len(list_filter([{', '.join(f'{_q(f)} || {_q(t)}' for f, t in C.REQUIRED_STRATEGIES)}], lambda x: x = framework || b.pii_type)) > 0 AS BOOLEAN) AS demands, count(s.type) AS found FROM (VALUES {_BRIDGE}) b(framework, pii_type) LEFT JOIN ({_MAIN_SQL}) s ON s.type = b.pii_type GROUP BY framework, b.pii_type")
def compliance_matrix(spark, sf_dir):
    """What each framework protects, whether it demands a strategy, and how often the documents have it."""
    found = report.counts(_main(spark, sf_dir), "type").select(report.pii_type(F.col("type")).alias("pii_type"), F.col("n").alias("found"))
    matrix = report.framework_types(spark).join(found, "pii_type", "left")
    return matrix.select("framework", "pii_type", (F.size("strategies") > 0).alias("demands"), F.coalesce("found", F.lit(0)).alias("found"))


@query("compliance_check", f"SELECT doc_id, framework, count(*) AS entities, array_to_string(list_sort(list(DISTINCT type)), ',') AS types, false AS is_compliant FROM ({_MAIN_SQL}) s JOIN (VALUES {_BRIDGE}) b(framework, pii_type) ON b.pii_type = s.type GROUP BY doc_id, framework")
def compliance_check(spark, sf_dir):
    return report.compliance(_main(spark, sf_dir), "doc_id").withColumn("types", F.array_join("types", ","))


@query("docs_with_pii", f"SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM ({_MAIN_SQL}))")
def docs_with_pii(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang").join(_rows(docs.select("doc_id", "text"), MAIN).select("doc_id"), "doc_id", "left_semi")


@query("unlabelled_docs", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "source").join(_table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


_SUPPORTED = ", ".join(f"({_q(n)}, {_q(t)})" for n, ps in C.DETECTORS.items() for t in sorted({p.type for p in ps}))


@query("supported_types", f"SELECT detector, k.type, count(s.type) AS found FROM (VALUES {_SUPPORTED}) k(detector, type) LEFT JOIN ({_MAIN_SQL}) s ON s.source = k.detector AND s.type = k.type GROUP BY detector, k.type")
def supported_types(spark, sf_dir):
    """What the detectors know, and how often the main patterns found it."""
    known = spark.createDataFrame([(n, p.type) for n, ps in C.DETECTORS.items() for p in ps], "detector string, type string").distinct()
    found = report.counts(_main(spark, sf_dir).withColumnRenamed("source", "detector"), "detector", "type")
    return known.join(found, ["detector", "type"], "left").select("detector", "type", F.coalesce("n", F.lit(0)).alias("found"))


# ---------------------------------------------------------------- redaction

_LAST4 = f"substr({_D}, -4)"
_DEFAULT = "CASE WHEN length(entity) > 2 THEN substr(entity, 1, 1) || repeat('X', length(entity) - 2) || substr(entity, -1) WHEN length(entity) = 2 THEN substr(entity, 1, 1) || 'X' ELSE 'X' END"
_KEEP4 = f"array_to_string(list_transform(range(1, length(entity) + 1), lambda i: CASE WHEN regexp_matches(substr(entity, i, 1), '[0-9]') AND length(regexp_replace(substr(entity, i), '[^0-9]', '', 'g')) > 4 THEN 'X' ELSE substr(entity, i, 1) END), '')"
_CARD = f"CASE WHEN length({_D}) < 4 THEN {_DEFAULT} WHEN regexp_matches(entity, '[- ]') THEN {_KEEP4} ELSE repeat('X', length({_D}) - 4) || {_LAST4} END"
_SSN = f"CASE WHEN length({_D}) = 9 THEN CASE WHEN contains(entity, '-') THEN 'XXX-XX-' ELSE 'XXXXX' END || {_LAST4} ELSE {_DEFAULT} END"
_PHONE = f"CASE WHEN length({_D}) < 4 THEN {_DEFAULT} ELSE {_KEEP4} END"
_EMAIL = f"CASE WHEN contains(entity, '@') AND length(split_part(entity, '@', 1)) > 1 THEN substr(entity, 1, 1) || repeat('X', length(split_part(entity, '@', 1)) - 1) || substr(entity, length(split_part(entity, '@', 1)) + 1) ELSE {_DEFAULT} END"
_NAME = f"CASE WHEN len(list_filter(string_split_regex(trim(entity), '\\s+'), lambda p: p <> '')) >= 2 THEN array_to_string(list_transform(list_filter(string_split_regex(trim(entity), '\\s+'), lambda p: p <> ''), lambda p: substr(p, 1, 1) || repeat('X', length(p) - 1)), ' ') ELSE {_DEFAULT} END"
NAMES = "concat('Ann ', CASE WHEN c_custkey % 3 = 0 THEN 'B ' ELSE '' END, c_mktsegment, CASE WHEN c_custkey % 5 = 0 THEN '  Lee' ELSE '' END)"
PHONES = "concat('(', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0'), ') 555-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))"
PLATES = "CASE WHEN c_custkey % 2 = 0 THEN concat('4111-1111-1111-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) ELSE concat('411111111111', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')) END"


def _mask_query(name: str, value: str, sql: str, mask) -> None:
    @query(name, f"SELECT c_custkey, {sql} AS masked FROM (SELECT c_custkey, {value} AS entity FROM customer)")
    def run(spark, sf_dir):
        return _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{value} AS entity").select("c_custkey", mask(F.col("entity")).alias("masked"))


_mask_query("mask_card", PLATES, _CARD, redact.mask_card)
_mask_query("mask_ssn", SSNS, _SSN, redact.mask_ssn)
_mask_query("mask_phone", PHONES, _PHONE, redact.mask_phone)
_mask_query("mask_email", MAILS, _EMAIL, redact.mask_email)
_mask_query("mask_name", NAMES, _NAME, redact.mask_name)
_mask_query("mask_default", "substring(c_name, 1, CAST(c_custkey % 5 AS INT))", _DEFAULT, redact.mask_default)
_mask_query("full_mask", "c_mktsegment", "repeat('X', length(entity)) ", redact.full_mask)
_mask_query("hash_token", MAILS, "'TOK_' || substr(sha256(entity), 1, 15)", redact.hash_token)
_mask_query("full_removal", MAILS, "''", lambda c: redact.replacement(F.lit("email"), c, "full_removal"))
_mask_query("no_redaction", MAILS, "entity", lambda c: redact.replacement(F.lit("email"), c, "none"))
_mask_query("custom_replacement", MAILS, "'<mail>'", lambda c: redact.replacement(F.lit("email"), c, custom={"email": "<mail>"}))


@query("generalize", f"SELECT doc_id, start_char, type, source, CASE type {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in C.GENERAL_LABELS.items())} ELSE '[' || upper(type) || ']' END AS label FROM ({_MAIN_SQL})")
def generalize(spark, sf_dir):
    return _main(spark, sf_dir).select("doc_id", "start_char", "type", "source", redact.generalize(F.col("type"), F.col("entity")).alias("label"))


@query("pseudonyms", "SELECT c_custkey, CASE WHEN true THEN list_extract([" + ", ".join(_q(x) for x in redact.FIRST) + "], CAST(1 + CAST('0x' || substr(md5('f' || c_name), 1, 8) AS BIGINT) % 8 AS BIGINT)) || ' ' || list_extract([" + ", ".join(_q(x) for x in redact.LAST) + "], CAST(1 + CAST('0x' || substr(md5('l' || c_name), 1, 8) AS BIGINT) % 7 AS BIGINT)) END AS person FROM customer")
def pseudonyms(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select("c_custkey", redact.pseudonym(F.lit("person_name"), F.col("c_name")).alias("person"))


@query("keyed_tokens", f"SELECT c_custkey, {MAILS} AS value FROM customer")
def keyed_tokens(spark, sf_dir):
    """Tokens and back: what comes out of the vault is what went in."""
    rows = _table(spark, sf_dir, "customer").selectExpr("c_custkey", f"{MAILS} AS value")
    sealed = redact.vault(rows, "key")
    return redact.reveal(rows.select("c_custkey", redact.keyed_token(F.col("value"), "key").alias("token")), sealed, "key").select("c_custkey", "value")


def _redacted(docs: DataFrame, **options) -> DataFrame:
    return engine.redact_docs(docs, **options)


def _redacted_docs(spark, sf_dir, **options) -> DataFrame:
    return _redacted(_table(spark, sf_dir, "documents").select("doc_id", "text"), **options)


# All that the detectors find is redacted, overlaps resolved: an ordered fold that SQL cannot express; tests/test_whole.py has brute force.


@query("redact_documents")
def redact_documents(spark, sf_dir):
    return _redacted_docs(spark, sf_dir).select("doc_id", "redacted_text", writers.total(F.col("redaction_count")).alias("redactions"))


@query("redact_strict")
def redact_strict(spark, sf_dir):
    """With the patterns that match almost every word narrowed: prose stays readable."""
    return _redacted_docs(spark, sf_dir, strict=True).select("doc_id", "redacted_text", writers.total(F.col("redaction_count")).alias("redactions"))


@query("redact_conversations")
def redact_conversations(spark, sf_dir):
    rows = _redacted(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).withColumn("redactions", writers.total(F.col("redaction_count")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "redacted_text"))), lambda r: r["redacted_text"]), "|")
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("redactions").alias("redactions"), F.md5(text).alias("digest"))


@query("redaction_type_counts")
def redaction_type_counts(spark, sf_dir):
    counts = engine.redaction_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return counts.select(F.explode("redaction_count").alias("type", "c")).groupBy("type").agg(F.sum("c").alias("n"))


@query("entity_csv")
def entity_csv(spark, sf_dir):
    found = engine.detect_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", columns=writers.ENTITY_FROM)
    return writers.entity_columns(found, lambda t, c: redact.replacement(t, c))


@query("audit_entries")
def audit_entries(spark, sf_dir):
    """Every redacted document's audit row."""
    log = report.audit_entries(_redacted_docs(spark, sf_dir).filter(F.size("redaction_count") > 0), "json", "u1", ["GDPR"])
    return log.select("operation", "document_id", F.array_join("pii_types_processed", ",").alias("types"), "entity_count")


@query("audit_filter", "SELECT event_id, CAST(user_id AS STRING) AS user_id, event_type AS operation FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, CAST(event_id AS STRING) LIMIT 100")
def audit_filter(spark, sf_dir):
    log = _table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("operation"), F.col("event_id").cast("string").alias("document_id"))
    return report.audit_query(log, operation="purchase").select("event_id", "user_id", "operation")


@query("file_status_latest", "SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def file_status_latest(spark, sf_dir):
    return report.latest(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", F.col("event_type").alias("status"), "event_id")


@query("result_store")
def result_store(spark, sf_dir):
    """Results stored twice: of the legacy detector for all documents, then of the whole detection for those where it finds
    something surer; each document's last result comes back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = store.ResultStore(spark)
    kept.upsert(store.records(engine.detect(docs, ("rule_based",)), user=F.lit("first")), 1)
    again = store.records(engine.detect(docs, strict=True), user=F.lit("second"))
    kept.upsert(again.filter("summary.high_confidence_entities > 0"), 2)
    last = kept.latest()
    return last.select(F.col("file_id").cast("long").alias("doc_id"), "user_id", "entity_count", F.array_join("summary.entity_types", ",").alias("types"), "summary.high_confidence_entities", "summary.text_length")


MAILED = _of(C.LEGACY, "email")
_AT = "2024-01-31 08:00:00"
_ENTITIES = """string_agg('{"pii_type":"email","original_text":' || to_json(entity) || ',"redacted_text":"<mail>","confidence":' || confidence || ',"risk_level":"' || risk || '","start_position":' || start_char || ',"end_position":' || end_char || '}', ',' ORDER BY start_char)"""


@query(
    "output_forms",
    f"""
WITH s AS (SELECT doc_id, text, start_char, end_char, entity, confidence, {_risk_sql()} AS risk, lag(end_char, 1, 0) OVER (PARTITION BY doc_id ORDER BY start_char) AS low FROM ({spans_sql(MAILED)})),
r AS (SELECT doc_id, count(*) AS n, max(end_char) AS last, string_agg(substring(text, low + 1, start_char - low) || '<mail>', '' ORDER BY start_char) AS cut, {_ENTITIES} AS entities,
             string_agg('email,' || entity || ',<mail>,' || confidence || ',' || risk || ',' || start_char || ',' || end_char || chr(10), '' ORDER BY start_char) AS lines FROM s GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN text ELSE cut || substring(text, last + 1) END AS t, coalesce(entities, '') AS entities, coalesce(lines, '') AS lines,
             CASE WHEN n IS NULL THEN '{{}}' ELSE '{{"email":' || n || '}}' END AS by_type FROM documents LEFT JOIN r USING (doc_id)),
f AS (SELECT doc_id, n, 'json' AS format, '{{"document_id":"' || doc_id || '","redacted_text":' || to_json(t) || ',"redaction_count":' || by_type || ',"detected_entities":[' || entities || '],"processed_at":"2024-01-31T08:00:00","metadata":{{"batch":"b1"}}}}' AS content FROM d
      UNION ALL SELECT doc_id, n, 'csv', CASE WHEN t IS NOT NULL THEN 'pii_type,original_text,redacted_text,confidence,risk_level,start_position,end_position' || chr(10) || lines END FROM d
      UNION ALL SELECT doc_id, n, 'text', '===== REDACTED DOCUMENT =====' || chr(10) || 'Processed: {_AT}' || chr(10) || 'Document ID: ' || doc_id || chr(10) || repeat('=', 30) || chr(10) || chr(10) || t FROM d
      UNION ALL SELECT doc_id, n, 'api_response', '{{"success":true,"redacted_text":' || to_json(t) || ',"metadata":{{"batch":"b1"}},"timestamp":"2024-01-31T08:00:00","redaction_statistics":{{"total_redactions":' || n || ',"by_type":' || by_type || '}}}}' FROM d)
SELECT doc_id, format, content IS NOT NULL AS success, content, CAST(strlen(content) AS BIGINT) AS size_bytes, CASE WHEN format = 'csv' AND content IS NOT NULL THEN n ELSE 0 END AS row_count, 'redact_' || format AS operation, n AS entity_count FROM f
""",
)
def output_forms(spark, sf_dir):
    """Documents whose mail addresses are replaced, in four forms with their audit."""
    custom = {"email": "<mail>"}
    done = engine.redact(S.extract_all(_table(spark, sf_dir, "documents").select("doc_id", "text"), MAILED, cut_col="__cut"), custom=custom)
    out = writers.formatted(done, "json", "csv", "text", "api_response", at=F.lit(_AT).cast("timestamp"), metadata={"batch": "b1"}, custom=custom)
    return out.select("doc_id", "format", "success", F.col("content").cast("string").alias("content"), "size_bytes", F.coalesce("row_count", F.lit(0)).alias("row_count"), "audit.operation", "audit.entity_count")


@query("output_files")
def output_files(spark, sf_dir):
    """Redacted documents as PDF and DOCX files with header and statistics: their size, digest and audit."""
    docs = dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))  # a file of one row group would be one task's work
    out = writers.formatted(_redacted(docs, strict=True), "pdf", "docx", at=F.lit(_AT).cast("timestamp"), frameworks=("GDPR",))
    return out.select("doc_id", "format", "success", "size_bytes", F.sha2("content", 256).alias("digest"), F.array_join("audit.pii_types_processed", ",").alias("types"), "audit.entity_count")


# ---------------------------------------------------------------- sources, normalisation, streams

_HTML = "trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


@query("html_text", f"SELECT page_id, {_HTML} AS text FROM pages")
def html_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", normalize.html_text(F.col("html")).alias("text"))


@query("html_pii")
def html_pii(spark, sf_dir):
    return engine.detect_rows(html_text(spark, sf_dir), "page_id", columns=COLUMNS)


@query("whitespace_norm", f"SELECT doc_id, regexp_replace({SPACED}, '[ \\t]+', ' ', 'g') AS text FROM documents")
def whitespace_norm(spark, sf_dir):
    return normalize.preprocess(_spaced(spark, sf_dir), ["normalize_whitespace"])


@query("control_chars", f"SELECT doc_id, c AS text, CAST(length(t) - length(c) AS INT) AS removed FROM (SELECT doc_id, t, regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}\\p{{Cf}}\\p{{Co}}]', '', 'g') AS c FROM (SELECT doc_id, {SPACED} AS t FROM documents))")
def control_chars(spark, sf_dir):
    df = _spaced(spark, sf_dir)
    clean = normalize.remove_control_chars(F.col("text"))
    return df.select("doc_id", clean.alias("text"), (F.length("text") - F.length(clean)).alias("removed"))


def _blank_sql(c: str, pattern: str) -> str:
    r = _q("(?i)" + pattern)
    return f"CASE WHEN regexp_matches({c}, {r}) THEN array_to_string(list_transform(list_zip(string_split_regex({c}, {r}), regexp_extract_all({c}, {r})), lambda x: x[1] || repeat(' ', coalesce(length(x[2]), 0))), '') ELSE {c} END"


@query("boilerplate", "SELECT doc_id, " + "t5" + " AS text FROM (SELECT *, " + _blank_sql("t4", normalize.BOILERPLATE[4]) + " AS t5 FROM (SELECT *, " + _blank_sql("t2", normalize.BOILERPLATE[3]) + " AS t4 FROM (SELECT *, " + _blank_sql("t1", normalize.BOILERPLATE[1]) + " AS t2 FROM (SELECT doc_id, " + _blank_sql("t0", normalize.BOILERPLATE[0]) + f" AS t1 FROM (SELECT doc_id, {SPACED} AS t0 FROM documents)))))")
def boilerplate(spark, sf_dir):
    return normalize.preprocess(_spaced(spark, sf_dir), ["clean_boilerplate"])


@query("ocr_fix", "SELECT doc_id, replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(f, 'l\\b', '1', 'g'), '\\b0\\b', 'O', 'g'), 'rn', 'm', 'g'), 'S$', '$'), '，', ',', 'g'), '  ', ' ') AS text FROM (SELECT doc_id, regexp_replace(" + SPACED + ", '[^\\x00-\\x7F]', '_', 'g') AS f FROM documents)")
def ocr_fix(spark, sf_dir):
    df = _spaced(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "_"))
    return df.select("doc_id", F.replace(normalize.fix_ocr(F.col("text")), F.lit("  "), F.lit(" ")).alias("text"))


@query("segments", f"SELECT doc_id, start, stop, text FROM (SELECT doc_id, CAST(coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x) + 2)), 0) AS INT) AS start, CAST(coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x) + 2)), 0) + length(p[i]) AS INT) AS stop, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, string_split_regex({SPACED}, '\\n\\s*\\n') AS p FROM documents))) WHERE trim(text) <> ''")
def segments(spark, sf_dir):
    return _spaced(spark, sf_dir).select("doc_id", F.explode(normalize.segments(F.col("text"))).alias("s")).select("doc_id", "s.start", F.col("s.end").alias("stop"), "s.text")


def _written_and_read(spark, sf_dir, kind) -> DataFrame:
    """Blocks of documents as files of a kind: a task writes and reads one file at a time, so no column of files is ever held."""
    make, read = {"docx": writers.docx, "pdf": writers.pdf}[kind], blocks.READERS[kind]
    docs = dealt(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return blocks.blocks(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), kind, {kind: lambda text: read(make(text or ""))})


@query("block_totals", "SELECT doc_id, CAST(n > 0 AS BIGINT) AS pages, CAST(n AS BIGINT) AS blocks FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\s]'))) AS n FROM documents) WHERE n > 0")
def block_totals(spark, sf_dir):
    """Documents written as DOCX and read back by block."""
    found = blocks.totals(_written_and_read(spark, sf_dir, "docx"))
    return found.select(F.col("path").cast("long").alias("doc_id"), "pages", "blocks")


@query("pdf_lines")
def pdf_lines(spark, sf_dir):
    """Documents written as PDF and read back by page: lines that are not blank, and their characters."""
    found = _written_and_read(spark, sf_dir, "pdf")
    lines = found.filter(F.col("error").isNull()).groupBy(F.col("path").cast("long").alias("doc_id"), "page")
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("characters"))


@query("line_counts", "SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS lines FROM documents")
def line_counts(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", readers.line_count(F.col("text")).alias("lines"))


@query("table_ingest", "SELECT c_custkey, concat_ws(chr(10) || chr(10), c_name, c_mktsegment) AS text FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 100")
def table_ingest(spark, sf_dir):
    return readers.from_table(_table(spark, sf_dir, "customer"), ["c_name", "c_mktsegment", "none"], "c_acctbal > 0", 100, "c_custkey").select("c_custkey", "text")


@query("events_props_json", "SELECT event_id, array_to_string(json_keys(props), ',') AS keys FROM events WHERE props IS NOT NULL")
def events_props_json(spark, sf_dir):
    return _table(spark, sf_dir, "events").filter("props is not null").select("event_id", F.array_join(readers.json_shape(F.col("props"))["keys"], ",").alias("keys"))


@query("chunk_stream_batch", "SELECT conv_id, chunk, CAST(count(*) AS INT) AS n, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, CAST((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS BIGINT) AS chunk FROM conversations) GROUP BY conv_id, chunk")
def chunk_stream_batch(spark, sf_dir):
    return streams.chunk_batch(_table(spark, sf_dir, "conversations"), "conv_id", "turn", size=3)


@query("event_rates", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def event_rates(spark, sf_dir):
    return streams.rates(_table(spark, sf_dir, "events"), "ts", "1 hour", "2 hours", "event_type")


@query("language_guess")
def language_guess(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", normalize.guess_language(F.col("text")).alias("guess"))


@query("detect_pipeline")
def detect_pipeline(spark, sf_dir):
    """The whole detection: all patterns of the default detectors, merged, filtered, ordered, enriched."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = engine.detect_rows(docs, "doc_id", columns=(*COLUMNS, "space", "context"))
    return S.enrich(rows).select("doc_id", "start_char", "end_char", "type", "source", F.round("confidence", 6).alias("confidence"), "risk", "adjusted")


@query("detection_report")
def detection_report(spark, sf_dir):
    """Each document's result: its summary, its redaction, and the characters of the row as JSON."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    done = engine.redact_result(engine.report(docs, "doc_id", strict=True))
    whole = F.length(F.to_json(F.struct("success", "candidates", "summary", "metadata")))
    by = lambda c: F.to_json(F.col(c))
    return done.select("doc_id", "success", "summary.total_entities", "summary.high_confidence_entities", by("summary.entities_by_type").alias("entities_by_type"), by("summary.risk_distribution").alias("risk_distribution"), "summary.detection_coverage", "redaction.error", "redaction.redacted_text", (whole > 0).alias("as_json"))


@query("mrz_check")
def mrz_check(spark, sf_dir):
    zone = F.concat(F.lit("P<UTOERIKSSON<<ANNA<MARIA"), F.repeat(F.lit("<"), F.lit(19)), F.lit("\n"), F.rpad(F.concat(F.lit("L"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")), 44, "<"))
    return _table(spark, sf_dir, "customer").select("c_custkey", validate.mrz_kind(zone).alias("kind"), validate.mrz_check_digit(F.concat(F.lit("L"), F.lpad(F.col("c_custkey").cast("string"), 8, "0"))).alias("check_digit"))


def _check_sql(c: str) -> str:
    """Check digit of the characters of an expression: weights 7, 3, 1, fillers 0."""
    return f"CAST(list_sum(list_transform(range(1, length({c}) + 1), lambda i: CASE WHEN substr({c}, i, 1) = '<' THEN 0 ELSE instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({c}, i, 1)) - 1 END * CASE i % 3 WHEN 1 THEN 7 WHEN 2 THEN 3 ELSE 1 END)) % 10 AS STRING)"


# Five kinds of zones in a note; the number's last letter is the customer's, so that some check digits agree.
_N = "CAST(c_custkey % 10 AS STRING)"
ZONED = f"""concat('Guest ', c_name, chr(10), CASE c_custkey % 7
 WHEN 0 THEN concat('I<UTOD2314589', {_N}, '7<<<<<<<<<<<<<<<', chr(10), '7408122F1204159UTO<<<<<<<<<<<6', chr(10), 'ERIKSSON<<ANNA<MARIA<<<<<<<<<<')
 WHEN 1 THEN concat('P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<', chr(10), 'L898902C', {_N}, '6UTO7408122F1204159ZE184226B<<<<<10')
 WHEN 2 THEN concat('V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<', chr(10), 'L898902C', {_N}, '6XXX4009078F96121096ZE184226B<<<<<<')
 WHEN 3 THEN concat('I<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<', chr(10), 'D2314589', {_N}, '7UTO7408122F1204159<<<<<<<6')
 WHEN 4 THEN concat('V<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<', chr(10), 'L898902C', {_N}, '6XXX4009078F9612109<<<<<<<<')
 WHEN 5 THEN concat('P<UTO ERIKSSON<<ANNA<MARIA<<<<<<<<<<<<<<<<<<<', chr(10), 'L898902C', {_N}, '6UTO7408122F120 4159ZE184226B<<<<<10')
 ELSE 'P<UTOSHORT<<' END, chr(10), 'seen')"""


def _zones_sql() -> str:
    # The zones of ZONED stand after the first line of a text, so that SQL can cut it by lines.
    parts = []
    for kind, (lines, width, fields, covered, last) in validate.ZONES.items():
        zone = [f"l[{i + 2}]" for i in range(lines)]
        part = lambda at, z=zone: f"substr({z[at[0] - 1]}, {at[1]}, {at[2]})"
        tests = [f"{_check_sql(part(f))} = {part((f[0], f[1] + f[2], 1))}" for f in fields]
        if last:
            tests.append(f"{_check_sql('(' + ' || '.join(part(c) for c in covered) + ')')} = {part((*last, 1))}")
        shape = " AND ".join(f"regexp_full_match(coalesce({z}, ''), '[A-Z0-9<]{{{width}}}')" for z in zone)
        letter = f" AND substr({zone[0]}, 1, 1) {'=' if kind.startswith('MRV') else '<>'} 'V'" if lines == 2 else ""
        number, birth, expiry = (part(f) for f in fields)
        parts.append(f"SELECT c_custkey, '{kind}' AS kind, rtrim({number}, '<') AS number, {birth} AS birth, {expiry} AS expiry, {' AND '.join(tests)} AS valid FROM z WHERE {shape}{letter}")
    return f"WITH z AS (SELECT c_custkey, string_split(replace({ZONED}, ' ', ''), chr(10)) AS l FROM customer) " + " UNION ALL ".join(parts)


@query("mrz_zones", _zones_sql())
def mrz_zones(spark, sf_dir):
    """Machine-readable zones inside texts, by kind, with all their check digits."""
    rows = _customers(spark, sf_dir, ZONED).select("c_custkey", validate.mrz_zone(F.col("text")).alias("z")).filter("z is not null")
    return rows.select("c_custkey", "z.kind", "z.number", "z.birth", "z.expiry", "z.valid")
