"""Token windows: what stands within three tokens of a span, and the confidence of tagged entities from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.catalog import ADDRESS_WORDS, INDICATORS

TOKEN = r"[\p{L}\p{M}\p{N}_]+|[^\s\p{L}\p{M}\p{N}_]"
WINDOW = 3


def tokens(text: Column) -> Column:
    """Words, and other signs one by one."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def window(text: Column, start: Column, end: Column, n: int = WINDOW) -> Column:
    """Lower-case tokens from ``n`` before the span (which begins and ends at tokens' borders) to ``n`` after it."""
    before = tokens(F.substring(text, F.lit(1), start))
    own = tokens(F.substring(text, start + 1, end - start))
    after = tokens(F.substring(text, end + 1, F.length(text)))
    last = F.slice(before, F.greatest(F.lit(1), F.size(before) - n + 1), F.lit(n))
    return F.transform(F.concat(last, own, F.slice(after, 1, n)), lambda t: F.lower(t))


def strong_context(label: Column, around: Column) -> Column:
    """An indicator of the label stands in the window."""

    def of(own: Column) -> Column:
        out = F.lit(False)
        for name, words in INDICATORS.items():
            out = F.when(label == name, F.arrays_overlap(own, F.array(*map(F.lit, words)))).otherwise(out)
        return out

    return F.transform(F.array(around), of)[0]  # a lambda's variable is computed once


def title_case(text: Column) -> Column:
    """Every run of letters begins with a capital and goes on in small letters."""
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{L}\p{Lu}") & ~text.rlike(r"(?<!\p{L})\p{Ll}")


def all_capitals(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def tagged_confidence(label: Column, text: Column, strong: Column) -> Column:
    """Base 0.75; more for length, title case of persons and organisations, and a strong context; less for capitals; 1 at most."""
    value = 0.75 + F.when(F.length(text) > 2, 0.05).otherwise(0.0) + F.when(label.isin("PERSON", "ORG") & title_case(text), 0.10).otherwise(0.0)
    value = value + F.when(strong, 0.10).otherwise(0.0) - F.when(all_capitals(text) & (F.length(text) > 1), 0.05).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), value), 6)


def looks_like_address(text: Column) -> Column:
    """A word of addresses stands in the text, even within another word."""
    return F.lower(text).rlike("|".join(ADDRESS_WORDS))
