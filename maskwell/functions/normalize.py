"""Text normalisation: Column -> Column steps, and a driver that applies them by name."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = r"[\p{C}&&[^\t\n\r ]]"

# OCR rewrites in order, and boilerplate.
OCR_FIXES = ((r"l\b", "1"), (r"\b0\b", "O"), (r"rn", "m"), (r"S\$", "$"), ("，", ","))
BOILERPLATE = (r"Page \d+ of \d+", r"CONFIDENTIAL", r"©\s*\d{4}.*\bAll rights reserved\b", r"www\.[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", r"Powered by.*")


def remove_control_chars(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, "")


def normalize_whitespace(c: Column, strict: bool = False) -> Column:
    """Runs of spaces and tabs become one space; ``strict`` also trims lines and limits blank ones."""
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r" ?\n ?", "\n"), r"\n{3,}", "\n\n") if strict else c


def normalize_unicode(c: Column) -> Column:
    """NFKC.  Spark has no such function, so this step is an Arrow UDF; ASCII text is the same before and after."""

    @F.pandas_udf("string")
    def nfkc(s):
        import unicodedata

        return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")

    return F.when(c.rlike(r"[^\x00-\x7F]"), nfkc(c)).otherwise(c)


def fix_ocr(c: Column) -> Column:
    for pattern, put in OCR_FIXES:
        c = F.regexp_replace(c, pattern, put.replace("$", "\\$"))
    return c


def ocr_changes(c: Column) -> Column:
    """How many rewrites :func:`fix_ocr` makes."""
    total = F.lit(0)
    for pattern, put in OCR_FIXES:
        total = total + F.regexp_count(c, F.lit(pattern))
        c = F.regexp_replace(c, pattern, put.replace("$", "\\$"))
    return total


def blank(c: Column, pattern: str) -> Column:
    """Matches become as many spaces, so offsets stay."""

    def of(t: Column) -> Column:
        gaps, hits = F.split(t, pattern, -1), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        return F.when(t.rlike(pattern), F.array_join(F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.repeat(F.lit(" "), F.coalesce(F.length(h), F.lit(0))))), "")).otherwise(t)

    return F.transform(F.array(c), of)[0]  # a lambda's variable is computed once, so chained calls do not multiply


def clean_boilerplate(c: Column) -> Column:
    for pattern in BOILERPLATE:
        c = blank(c, "(?i)" + pattern)
    return c


def boilerplate_count(c: Column) -> Column:
    total = F.lit(0)
    for pattern in BOILERPLATE:
        total = total + F.regexp_count(c, F.lit("(?i)" + pattern))
        c = blank(c, "(?i)" + pattern)
    return total


def segments(c: Column) -> Column:
    """Paragraphs between blank lines: array<struct<start, end, text>>; empty ones are skipped but counted."""
    fold = F.aggregate(
        F.split(c, r"\n\s*\n", -1),
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string>>)").alias("out")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p) + 2).alias("at"),
            F.when(F.trim(p) == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.length(p)).alias("end"), p.alias("text"))))).alias("out"),
        ),
        lambda s: s["out"],
    )
    return fold


def html_text(c: Column) -> Column:
    """Tags out, white space collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def character_map(original: Column, drop: str) -> Column:
    """Positions in ``original`` of the characters that remain when those matching ``drop`` (one character) go."""
    at = F.sequence(F.lit(0), F.length(original) - 1)
    return F.when(F.length(original) > 0, F.filter(at, lambda i: ~F.substring(original, i + 1, F.lit(1)).rlike(drop))).otherwise(F.expr("cast(array() as array<int>)"))


def map_position(char_map: Column, position: Column) -> Column:
    """Original position, or -1."""
    return F.coalesce(F.try_element_at(char_map, position + 1), F.lit(-1))


STEPS = {
    "remove_control_chars": remove_control_chars,
    "normalize_whitespace": normalize_whitespace,
    "normalize_unicode": normalize_unicode,
    "normalize_ocr_text": fix_ocr,
    "clean_boilerplate": clean_boilerplate,
}
DEFAULT_STEPS = ("remove_control_chars", "normalize_whitespace", "normalize_unicode")


def preprocess(df: DataFrame, steps=DEFAULT_STEPS, text_col: str = "text") -> DataFrame:
    """``df`` with the steps applied to ``text_col``; an unknown step is skipped with a warning."""
    for step in steps:
        if step not in STEPS:
            warnings.warn(f"unknown preprocessing step: {step}", stacklevel=2)
            continue
        df = df.withColumn(text_col, STEPS[step](F.col(text_col)))
    return df


# Own tables: frequent words of the languages that the built-in guess knows.
STOP_WORDS = {
    "de": "der die das und ist nicht ein eine zu den mit von für auf",
    "en": "the of and to in is that it for was with as on be",
    "es": "el los las que de y en una por con para se su del",
    "fr": "le les des et est une que dans pour qui sur pas la du",
}


def _in(own: str):
    return lambda w: w.isin(*own.split())


def guess_language(c: Column) -> Column:
    """The language with most stop words in the text, null without any; ties go to the first in the alphabet."""
    words = F.split(F.lower(c), r"[^\p{L}]+")
    scored = [F.struct(F.size(F.filter(words, _in(own))).alias("n"), (-F.lit(i)).alias("i"), F.lit(lang).alias("lang")) for i, (lang, own) in enumerate(sorted(STOP_WORDS.items()))]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["lang"])
