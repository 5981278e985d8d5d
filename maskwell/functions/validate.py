"""Validators: Column -> Column predicates, null for null input unless said otherwise."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import BLOCKED_DOMAINS, COMMON_WORDS, NEGATIONS


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn_legacy(c: Column) -> Column:
    """Mod-10 check of the text without hyphens and white space; other characters fail it."""
    bare = F.regexp_replace(c, r"[-\s]", "")
    return F.when(bare.rlike("^[0-9]+$"), F.call_function("luhn_check", bare)).otherwise(F.lit(False))


def card(c: Column) -> Column:
    """Mod-10 check of the digits, which must be 13 to 19."""
    d = digits(c)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def email(c: Column) -> Column:
    """One local part, a dot in the domain, and not a placeholder domain."""
    domain = F.lower(F.substring_index(c, "@", -1))
    return F.contains(c, F.lit("@")) & F.contains(domain, F.lit(".")) & ~domain.isin(*BLOCKED_DOMAINS)


def ssn(c: Column) -> Column:
    """Nine digits in an issued range."""
    d = digits(c)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return (F.length(d) == 9) & ~area.isin("000", "666") & ~F.startswith(area, F.lit("9")) & (group != "00") & (serial != "0000")


def ssn_legacy(c: Column) -> Column:
    """Nine digits, none of the parts zero, not one of the two sequences."""
    d = F.regexp_replace(F.regexp_replace(c, r"(?i)SSN:?\s*", ""), r"[-\s]", "")
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    return d.rlike("^[0-9]{9}$") & (area != "000") & (group != "00") & (serial != "0000") & ~d.isin("123456789", "987654321")


DATE_FORMATS = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "yyyy/M/d", "yyyy-M-d", "yyyy.M.d")


def iso_date(c: Column) -> Column:
    """The date in ISO form under the first format that reads it, else null."""
    return F.date_format(F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS]), "yyyy-MM-dd")


def ip(c: Column) -> Column:
    """Exactly four dotted numbers, 0 to 255."""
    parts = F.split(c, r"\.", -1)
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^[0-9]+$") & F.coalesce(p.try_cast("int").between(0, 255), F.lit(False)))


def orchestrator_format(type_: Column, c: Column) -> Column:
    """The report's own format test; types it doesn't know pass."""
    n = F.length(digits(c))
    return F.when(type_ == "email", F.contains(c, F.lit("@")) & F.contains(c, F.lit("."))).when(type_ == "phone", n.between(7, 15)).when(type_ == "ssn", n == 9).otherwise(F.lit(True))


def negated(context: Column) -> Column:
    """A doubtful word stands, even inside another word, in the context."""
    return F.lower(context).rlike("|".join(NEGATIONS))


def common_word(c: Column) -> Column:
    return F.lower(c).isin(*COMMON_WORDS)


def by_type(type_: Column, c: Column) -> Column:
    """Three-valued: valid, invalid, or null for types without a validator."""
    return F.when(type_ == "credit_card", card(c)).when(type_ == "email", email(c)).when(type_ == "ssn", ssn(c)).when(type_.isin("date", "date_of_birth"), iso_date(c).isNotNull())


def explained(type_: Column, c: Column) -> Column:
    """struct<valid, method, reason>: :func:`by_type` with the test that was passed, or why there is no pass."""
    d, domain = digits(c), F.lower(F.substring_index(c, "@", -1))
    no = lambda why: F.struct(F.lit(False).alias("valid"), F.lit(None).cast("string").alias("method"), F.lit(why).alias("reason"))
    yes = lambda how: F.struct(F.lit(True).alias("valid"), F.lit(how).alias("method"), F.lit(None).cast("string").alias("reason"))
    none = lambda why: F.struct(F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("string").alias("method"), F.lit(why).alias("reason"))
    own_card = F.when(~F.length(d).between(13, 19), no("Invalid length")).when(F.call_function("luhn_check", d), yes("luhn")).otherwise(no("Failed Luhn check"))
    own_email = F.when(~(F.contains(c, F.lit("@")) & F.contains(domain, F.lit("."))), no("Invalid format")).when(domain.isin(*BLOCKED_DOMAINS), no("Test domain")).otherwise(yes("format"))
    area = F.substring(d, 1, 3)
    own_ssn = (
        F.when(F.length(d) != 9, no("Invalid length")).when(area.isin("000", "666"), no("Invalid first group")).when(F.startswith(area, F.lit("9")), no("Invalid first digit"))
        .when(F.substring(d, 4, 2) == "00", no("Invalid second group")).when(F.substring(d, 6, 4) == "0000", no("Invalid third group")).otherwise(yes("format"))
    )
    own_date = F.when(iso_date(c).isNotNull(), yes("format")).otherwise(no("Failed to parse date"))
    known = F.when(type_ == "credit_card", own_card).when(type_ == "email", own_email).when(type_ == "ssn", own_ssn).when(type_.isin("date", "date_of_birth"), own_date).otherwise(none("No validation available"))
    return F.when(F.coalesce(F.length(c), F.lit(0)) < 2, none("Text too short")).otherwise(known)


def legacy_keeps(type_: Column, c: Column) -> Column:
    """Whether the legacy detector keeps a match."""
    return F.when(type_ == "credit_card", luhn_legacy(c)).when(type_ == "ssn", ssn_legacy(c)).when(type_ == "ip_address", ip(c)).otherwise(F.lit(True))


def looks_like_name(c: Column) -> Column:
    """Title case, two letters or more, and no common word."""
    return c.rlike(r"^\p{Lu}\p{Ll}+$") & ~common_word(c)


def scanned_page(text: Column, text_area: Column, page_area: Column) -> Column:
    return (F.length(F.trim(text)) < 100) | (text_area / page_area < 0.01)


def mrz_kind(c: Column) -> Column:
    """Machine-readable zone by shape, blanks removed: TD1, TD3, TD2 or null."""
    bare = F.regexp_replace(c, " ", "")
    return F.when(bare.rlike("^([A-Z0-9<]{30}\n){2}[A-Z0-9<]{30}$"), "TD1").when(bare.rlike("^[A-Z0-9<]{44}\n[A-Z0-9<]{44}$"), "TD3").when(bare.rlike("^[A-Z0-9<]{36}\n[A-Z0-9<]{36}$"), "TD2")


def mrz_check_digit(c: Column) -> Column:
    """Check digit over digits, letters (A is 10) and fillers with the weights 7, 3, 1."""
    place = F.sequence(F.lit(1), F.length(c))
    total = F.aggregate(place, F.lit(0), lambda acc, i: acc + (F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(c, i, F.lit(1))) - 1) .cast("int") * F.when(F.substring(c, i, F.lit(1)) == "<", 0).otherwise(F.element_at(F.array(F.lit(1), F.lit(7), F.lit(3)), (i % 3 + 1).cast("int"))))
    return F.when(F.length(c) > 0, total % 10)


_LINE = "[A-Z0-9<]"
# Per kind the lines' number and width, the places (line, first, length) of number, birth and expiry, each followed by its check
# digit, and the parts that the last check digit covers; visas have none.
ZONES = {
    "TD1": (3, 30, ((1, 6, 9), (2, 1, 6), (2, 9, 6)), ((1, 6, 25), (2, 1, 7), (2, 9, 7), (2, 19, 11)), (2, 30)),
    "TD3": (2, 44, ((2, 1, 9), (2, 14, 6), (2, 22, 6)), ((2, 1, 10), (2, 14, 7), (2, 22, 22)), (2, 44)),
    "MRVA": (2, 44, ((2, 1, 9), (2, 14, 6), (2, 22, 6)), (), None),
    "TD2": (2, 36, ((2, 1, 9), (2, 14, 6), (2, 22, 6)), ((2, 1, 10), (2, 14, 7), (2, 22, 14)), (2, 36)),
    "MRVB": (2, 36, ((2, 1, 9), (2, 14, 6), (2, 22, 6)), (), None),
}


_VALUE = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")} | {"<": 0}
_ZONE = "struct<kind:string,zone:string,number:string,birth:string,expiry:string,valid:boolean>"


def check_digit(s: str) -> str:
    """As :func:`mrz_check_digit`."""
    return str(sum(_VALUE[c] * (7, 3, 1)[i % 3] for i, c in enumerate(s)) % 10)


def zone_finder():
    """A function that gives the fields of the first zone of a text, or None."""
    made = []
    for kind, (lines, width, fields, covered, last) in ZONES.items():
        first = "V" + _LINE + "{%d}" % (width - 1) if kind.startswith("MRV") else ("(?!V)" if lines == 2 else "") + _LINE + "{%d}" % width
        made.append((kind, re.compile(r"(?<![A-Z0-9<])" + first + ("\n" + _LINE + "{%d}" % width) * (lines - 1) + r"(?![A-Z0-9<])"), width, fields, covered, last))

    def find(text: str | None) -> tuple | None:
        bare = (text or "").replace(" ", "")
        for kind, pattern, width, fields, covered, last in made:
            if m := pattern.search(bare):
                zone = m[0]
                part = lambda line, first, n, z=zone, w=width: z[(at := (line - 1) * (w + 1) + first - 1) : at + n]
                valid = all(check_digit(part(*f)) == part(f[0], f[1] + f[2], 1) for f in fields) and (not last or check_digit("".join(part(*c) for c in covered)) == part(*last, 1))
                number, birth, expiry = (part(*f) for f in fields)
                return kind, zone, number.rstrip("<"), birth, expiry, valid
        return None

    return find


def mrz_zone(text: Column) -> Column:
    """struct<kind, zone, number, birth, expiry, valid>: the first machine-readable zone that stands in a text, blanks removed.

    Visas are told from passports and cards of the same size by their first letter, V.  ``valid`` is whether the check digits of
    number, birth and expiry agree, and the last one over all of them where the kind has it.  Without a zone it is null.
    A text is read once: as built-in expressions, each field and each test of the result read it anew.
    """

    @F.arrow_udf(_ZONE)
    def zones(texts):
        import pyarrow as pa

        find, names = zone_finder(), [x.split(":")[0] for x in _ZONE[7:-1].split(",")]
        kind = pa.struct([pa.field(n, pa.bool_() if n == "valid" else pa.string()) for n in names])
        return pa.array([z and dict(zip(names, z, strict=True)) for z in map(find, texts.to_pylist())], kind)

    return zones.asNondeterministic()(text)  # else the optimizer runs it once more for each use
