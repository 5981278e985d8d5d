"""Offsets through preprocessing: what a place in the processed text was in the original one.

A step changes a text at some places and leaves the rest, so its map is a list of pieces: (place in the result, place in
the source, width in the result, width in the source), kept where something changed, in order.  A place between two pieces
is as far behind the last piece's end as it was; a place within a piece is the piece's whole source.  Steps compose by
mapping a place through the last step's pieces, then the step's before it, and so on: two binary searches a step and span,
no array as long as the text.

Unicode normalisation works on runs: a run starts at a character that neither decomposes nor combines with what stands
before it, so runs normalise by themselves, and a run that changes is one piece.
"""

from __future__ import annotations

import bisect
import functools
import re
import unicodedata
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .normalize import BOILERPLATE, OCR_FIXES

PIECES = T.ArrayType(T.ArrayType(T.IntegerType()))  # a step: four numbers a piece, flat

Change = tuple[int, int, str]  # start and end in the source, and what stands there now


def _substituted(pattern: str, put: Callable[[re.Match], str] | str) -> Callable[[str], list[Change]]:
    find = re.compile(pattern).finditer
    of = put if callable(put) else lambda m: put
    return lambda text: [(m.start(), m.end(), new) for m in find(text) if (new := of(m)) != m.group()]


def _control(text: str) -> list[Change]:
    return [(i, i + 1, "") for i, c in enumerate(text) if not c.isprintable() and c not in "\t\n\r " and unicodedata.category(c)[0] == "C"]


def _unicode(text: str) -> list[Change]:
    if text.isascii():
        return []
    out, start = [], 0
    for i in range(1, len(text) + 1):
        # a starter that NFKC leaves alone when it follows anything closes the run before it
        if i == len(text) or _closed(text[i]):
            run = text[start:i]
            new = run if run.isascii() else unicodedata.normalize("NFKC", run)
            if new != run:
                out.append((start, i, new))
            start = i
    return out


@functools.cache
def _closed(c: str) -> bool:
    """Nothing before ``c`` can change with it: it combines with nothing and stays as it is.  Vowel and final jamo combine
    though their class is 0, as do some marks."""
    marks = unicodedata.combining(c) != 0 or unicodedata.category(c)[0] == "M" or "\u1100" <= c <= "\u11ff"
    return not marks and unicodedata.normalize("NFKC", c) == c


#: Step names to the substitutions that they make, one after the other.
CHANGES: dict[str, list[Callable[[str], list[Change]]]] = {
    "remove_control_chars": [_control],
    "normalize_whitespace": [_substituted(r"[ \t]+", " ")],
    "normalize_unicode": [_unicode],
    "normalize_ocr_text": [_substituted(p, put) for p, put in OCR_FIXES],
    "clean_boilerplate": [_substituted("(?i)" + p, lambda m: " " * len(m.group())) for p in BOILERPLATE],
}


def apply(text: str, changes: list[Change]) -> tuple[str, list[int]]:
    """The changed text and its pieces, flat."""
    out, pieces, at, length = [], [], 0, 0
    for a, b, new in changes:
        out += (text[at:a], new)
        length += a - at
        pieces += (length, a, len(new), b - a)
        length += len(new)
        at = b
    return "".join([*out, text[at:]]), pieces


def through(text: str, steps) -> tuple[str, list[list[int]]]:
    """``text`` after the steps, and the pieces of each substitution that changed something."""
    maps = []
    for step in steps:
        for find in CHANGES[step]:
            if changes := find(text):
                text, pieces = apply(text, changes)
                maps.append(pieces)
    return text, maps


def back(maps: list[list[int]], start: int, end: int) -> tuple[int, int]:
    """The range of the original that became [start, end) of the result; what a touched piece was belongs to it as a whole."""
    for pieces in reversed(maps):
        start, end = _place(pieces, start, False), max(_place(pieces, end, True), 0)
    return start, max(start, end)


def _place(pieces: list[int], at: int, is_end: bool) -> int:
    """Source place of a result place.  An end looks at the character before it, so a removed run after it stays out."""
    look = at - 1 if is_end else at
    if look < 0:
        return 0
    starts = pieces[0::4]
    # the last piece that begins at or before the character; of pieces at one place the last
    k = bisect.bisect_right(starts, look) - 1
    if k < 0:
        return at
    new, old, n_new, n_old = pieces[4 * k : 4 * k + 4]
    if look < new + n_new:  # within what was put there
        if n_new == n_old:
            return old + at - new
        return old + n_old if is_end else old
    return old + n_old + at - new - n_new


def known(steps) -> list[str]:
    """The steps that exist; others are skipped with a warning."""
    for step in steps:
        if step not in CHANGES:
            warnings.warn(f"unknown preprocessing step: {step}", stacklevel=3)
    return [s for s in steps if s in CHANGES]


def preprocessed(df: DataFrame, steps, text_col: str = "text") -> DataFrame:
    """``df`` with the text after the steps in ``__seen`` and its pieces in ``__map``."""
    names = known(steps)
    kind = T.StructType([T.StructField("seen", T.StringType()), T.StructField("map", PIECES)])

    @F.pandas_udf(kind)
    def walk(texts):
        import pandas as pd

        return pd.DataFrame([(None, []) if t is None else through(t, names) for t in texts], columns=["seen", "map"])

    return df.withColumn("__walked", walk(F.col(text_col))).withColumns({"__seen": F.col("__walked.seen"), "__map": F.col("__walked.map")}).drop("__walked")


def mapped_back(found: DataFrame, text_col: str = "text", col: str = "spans") -> DataFrame:
    """``found`` with its spans (of ``__seen``) at the places of the original text, and with the text found there."""

    @F.pandas_udf("array<struct<start:int,end:int,text:string>>")
    def places(texts, maps, starts, ends):
        import pandas as pd

        out = []
        for text, own, a, b in zip(texts, maps, starts, ends, strict=True):
            rows, steps = [], [p.tolist() for p in own] if own is not None else []
            for s, e in zip(a if a is not None else [], b if b is not None else [], strict=True):
                s, e = back(steps, int(s), int(e))
                rows.append({"start": s, "end": e, "text": text[s:e]})
            out.append(rows)
        return pd.Series(out)

    at = places(F.col(text_col), F.col("__map"), F.transform(col, lambda x: x["start"]), F.transform(col, lambda x: x["end"]))
    moved = F.transform(F.arrays_zip(F.col(col).alias("s"), F.col("__at").alias("p")), lambda z: z["s"].withField("start", z["p"]["start"]).withField("end", z["p"]["end"]).withField("text", z["p"]["text"]))
    return found.withColumn("__at", at).withColumn(col, moved).drop("__at")
