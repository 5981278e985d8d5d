"""The validators of :mod:`validate` on Python strings, for passes that see a text at a time; tests hold the two against each other."""

from __future__ import annotations

import re
from datetime import date

from ..plans.catalog import BLOCKED_DOMAINS

_NOT_DIGIT, _BLANK = re.compile("[^0-9]"), re.compile(r"[-\s]")
_LABEL = re.compile(r"SSN:?\s*", re.IGNORECASE)
_DAY_LAST = re.compile(r"([0-9]{4})([/.-])([0-9]{1,2})\2([0-9]{1,2})")
_YEAR_LAST = re.compile(r"([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def luhn_legacy(s: str) -> bool:
    bare = _BLANK.sub("", s)
    return bare.isascii() and bare.isdigit() and luhn(bare)


def card(s: str) -> bool:
    d = _NOT_DIGIT.sub("", s)
    return 13 <= len(d) <= 19 and luhn(d)


def email(s: str) -> bool:
    domain = s.rpartition("@")[2].lower()
    return "@" in s and "." in domain and domain not in BLOCKED_DOMAINS


def ssn(s: str) -> bool:
    d = _NOT_DIGIT.sub("", s)
    return len(d) == 9 and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn_legacy(s: str) -> bool:
    d = _BLANK.sub("", _LABEL.sub("", s))
    return len(d) == 9 and d.isascii() and d.isdigit() and d[:3] != "000" and d[3:5] != "00" and d[5:] != "0000" and d not in ("123456789", "987654321")


def ip(s: str) -> bool:
    parts = s.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) <= 255 for p in parts)


def _day(year: str, month: str, day: str) -> bool:
    try:
        date(int(year), int(month), int(day))
    except ValueError:
        return False
    return True


def a_date(s: str) -> bool:
    """Some format of ``validate.DATE_FORMATS`` reads it."""
    if m := _YEAR_LAST.fullmatch(s):
        return _day(m[4], m[1], m[3]) or _day(m[4], m[3], m[1])
    return bool(m := _DAY_LAST.fullmatch(s)) and _day(m[1], m[3], m[4])


#: Of the enhanced detector: a valid match is surer, an invalid one less sure.
BY_TYPE = {"credit_card": card, "email": email, "ssn": ssn, "date": a_date, "date_of_birth": a_date}
#: Of the legacy detector: an invalid match is dropped.
LEGACY_KEEPS = {"credit_card": luhn_legacy, "ssn": ssn_legacy, "ip_address": ip}
