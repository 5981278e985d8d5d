"""Knowledge-base detection: which definitions a document calls for, and their spans by pattern and near keywords.

One narrow Arrow pass reads each text once: an automaton over the keywords and key phrases of all definitions finds every
occurrence at once, the patterns follow, and capitalised phrases are taken from the windows around occurrences.  The
knowledge base travels with the plan; its size is the user's table of definitions, not the data's.
"""

from __future__ import annotations

import bisect
import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.catalog import KNOWLEDGE, SENSITIVITY_BOOST, Definition, Pattern
from .scan import Need, need, parts

WINDOW = 50
TOKENS, TOKEN_LENGTH = 10, 4  # the first tokens of this length or more speak for the document
# What counts as a phrase near a keyword, by type; other types have none.
PHRASES = {"person": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", "organization": r"\b[A-Z][a-zA-Z\s&,.-]+\b", "location": r"\b[A-Z][a-zA-Z\s,-]+\b"}


def definitions(spark: SparkSession, rows: list[Definition] | None = None) -> DataFrame:
    """The knowledge base as a frame; add, replace and look up with ordinary operators."""
    return spark.createDataFrame(
        [(d.entity_type, d.name, d.description, list(d.patterns), list(d.keywords), d.sensitivity, list(d.examples)) for d in (KNOWLEDGE if rows is None else rows)],
        "entity_type string, name string, description string, patterns array<string>, keywords array<string>, sensitivity string, examples array<string>",
    )


def upsert(base: DataFrame, changed: DataFrame) -> DataFrame:
    """``base`` with the definitions of ``changed`` in place of those of the same type."""
    return base.join(changed.select("entity_type"), "entity_type", "left_anti").unionByName(changed)


def terms(d: Definition) -> set[str]:
    """The words by which a document's tokens find a definition."""
    return {w for text in (d.name, d.description, *d.keywords) for w in re.findall(r"\w+", text.lower()) if len(w) >= TOKEN_LENGTH}


CALLED = T.StructType([T.StructField("entity_type", T.StringType()), T.StructField("token_score", T.LongType()), T.StructField("keywords", T.LongType()), T.StructField("pattern_hits", T.LongType()), T.StructField("spans", T.LongType()), T.StructField("intervals", T.LongType()), T.StructField("covered", T.LongType())])
HIT = T.StructType(
    [
        T.StructField("start_char", T.IntegerType()), T.StructField("end_char", T.IntegerType()), T.StructField("entity", T.StringType()), T.StructField("type", T.StringType()),
        T.StructField("sensitivity", T.StringType()), T.StructField("source", T.StringType()), T.StructField("context_match", T.BooleanType()), T.StructField("confidence", T.DoubleType()),
    ]
)


_TOKEN, _DIGITS = re.compile(r"\w{%d,}" % TOKEN_LENGTH), re.compile(r"\d+")
_ENDING = re.compile(r"\\b\[A-Z\](\[[^\]]+\]\+)(\(\?:[A-Za-z|]+\)\\b)")


def finder(pattern: str):
    """``finditer`` of the pattern, in any case.  One that runs over a class of characters up to some last word would try every
    start of a text without that word, to its end; it is tried on runs that have the word, up to its last place in them."""
    whole = re.compile(pattern, re.IGNORECASE)
    m = _ENDING.fullmatch(pattern)
    if not m:
        return whole.finditer
    runs, last = (re.compile(x, re.IGNORECASE) for x in m.groups())

    def find(text: str):
        for run in runs.finditer(text) if last.search(text) else ():
            end = max((x.end() for x in last.finditer(text, run.start(), run.end()) if x.end() < run.end() or last.match(text, x.start())), default=-1)
            if end >= 0:
                yield from whole.finditer(text, run.start(), end)

    return find


def _within(places: list[tuple[int, int]], low: int, high: int) -> bool:
    """One of the places, which are in order, lies in [low, high)."""
    for k in range(bisect.bisect_left(places, (low, 0)), len(places)):
        if places[k][0] >= high:
            return False
        if places[k][1] <= high:
            return True
    return False


def union(places) -> tuple[int, int]:
    """How many intervals the union of places has (touching ones are one), and how many characters."""
    n, total, reach = 0, 0, -1
    for a, b in sorted(places):
        n += a > reach
        total += max(0, b - max(a, reach))
        reach = max(reach, b)
    return n, total


class Base:
    """Definitions made ready for texts."""

    _lower = {c: c + 32 for c in range(65, 91)}  # keeps the places of characters

    def __init__(self, rows: list[Definition]):
        import ahocorasick

        self.rows = rows
        # the default patterns are tried only on texts that have what each of their matches needs
        needs = {r: need(Pattern("rule_based", d.entity_type, r, 0.7)) for d in KNOWLEDGE for r in d.patterns}
        self.compiled = [[(needs.get(p, Need()), finder(p)) for p in d.patterns] for d in rows]
        self.phrases = [re.compile(PHRASES[d.entity_type]) if d.entity_type in PHRASES else None for d in rows]
        self.keywords = [{k.lower() for k in d.keywords} for d in rows]
        self.examples = [{e.lower() for e in d.examples} for d in rows]
        self.terms: dict[str, list[int]] = {}
        owners: dict[str, list[int]] = {}
        for i, d in enumerate(rows):
            for w in terms(d):
                self.terms.setdefault(w, []).append(i)
            for k in self.keywords[i]:
                owners.setdefault(k, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for k, own in owners.items():
            self.automaton.add_word(k, (k, own))
        if owners:
            self.automaton.make_automaton()

    def occurrences(self, low: str) -> tuple[list[list[tuple[int, int, str]]], list[list[tuple[int, int]]]]:
        """Of each definition: where its keywords stand as whole words, and where they stand at all, in order of start."""
        whole: list[list[tuple[int, int, str]]] = [[] for _ in self.rows]
        found: list[list[tuple[int, int]]] = [[] for _ in self.rows]
        word = lambda i: 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")
        for last, (k, own) in self.automaton.iter(low) if len(self.automaton) else ():
            start, end = last + 1 - len(k), last + 1
            alone = word(start) != word(start - 1) and word(end - 1) != word(end)
            for i in own:
                found[i].append((start, end))
                if alone:
                    whole[i].append((start, end, k))
        for own in found:
            own.sort()
        return whole, found

    def _score(self, text: str) -> list[int]:
        score = [0] * len(self.rows)
        for m in itertools.islice(_TOKEN.finditer(text.lower()), TOKENS):
            for i in self.terms.get(m[0], ()):
                score[i] += 1
        return score

    def _low(self, text: str) -> str:
        return text.lower() if text.isascii() else text.translate(self._lower)

    def _finders(self, text: str) -> list[list]:
        """Of each definition the finders of patterns that the text may match."""
        digits = max(map(len, _DIGITS.findall(text)), default=0)
        return [[find for want, find in own if want.run <= digits and want.literal in text] for own in self.compiled]

    def keywords_of(self, text: str) -> list[tuple]:
        """(entity type, keywords that stand in the text) of the definitions with any."""
        keys, _ = self.occurrences(self._low(text))
        return [(d.entity_type, len({k for _, _, k in own})) for d, own in zip(self.rows, keys, strict=True) if own]

    def called(self, text: str) -> list[tuple]:
        """Rows of CALLED."""
        score, finders, (keys, _), out = self._score(text), self._finders(text), self.occurrences(self._low(text)), []
        for i, d in enumerate(self.rows):
            at = [m.span() for find in finders[i] for m in find(text)]
            if score[i] or at or keys[i]:
                n = len(at)
                if self.phrases[i] and (score[i] or at):
                    at += [x[:2] for x in self._near(text, i, keys[i])]
                out.append((d.entity_type, score[i], len({k for _, _, k in keys[i]}), n, len(at), *union(at)))
        return out

    def matches(self, text: str) -> list[tuple]:
        """Rows of HIT: matches of patterns."""
        finders, (_, anywhere), out = self._finders(text), self.occurrences(self._low(text)), []
        for i, d in enumerate(self.rows):
            places, examples, base = anywhere[i], self.examples[i], 0.7 + SENSITIVITY_BOOST.get(d.sensitivity, 0.0)
            sure = [[round(min(1.0, base + 0.15 * match + 0.1 * example), 6) for example in (False, True)] for match in (False, True)]
            for find in finders[i]:
                for m in find(text):
                    (a, b), said = m.span(), m.group()
                    match = bool(places) and _within(places, a - WINDOW, b + WINDOW)
                    out.append((a, b, said, d.entity_type, d.sensitivity, "rag", match, sure[match][said.lower() in examples]))
        return out

    def context(self, text: str) -> list[tuple]:
        """Rows of HIT: phrases near keywords of the definitions that the text calls for."""
        score, finders, (keys, _), out = self._score(text), self._finders(text), self.occurrences(self._low(text)), []
        for i in range(len(self.rows)):
            if self.phrases[i] and keys[i] and (score[i] or any(next(iter(find(text)), None) for find in finders[i])):
                out += self._near(text, i, keys[i])
        return out

    def hits(self, text: str) -> list[tuple]:
        return self.matches(text) + self.context(text)

    def _near(self, text: str, i: int, occurrences) -> list[tuple]:
        d, found = self.rows[i], {}
        for start, end, _ in occurrences:
            a = max(0, start - WINDOW)
            for m in self.phrases[i].finditer(text[a : end + WINDOW]):
                if m.group().lower() not in self.keywords[i]:
                    found[a + m.start(), a + m.end()] = m.group()
        return [(a, b, w, d.entity_type, d.sensitivity, "rag_context", True, 0.6) for (a, b), w in sorted(found.items())]


def look(docs: DataFrame, rows: list[Definition] | None, keep: tuple[str, ...], text_col: str, of: str, kind: T.StructType, columns: tuple[str, ...] | None = None) -> DataFrame:
    """The columns kept with a row for each that the method ``of`` of :class:`Base` gives; of its fields, the ``columns`` asked for."""
    rows = list(KNOWLEDGE if rows is None else rows)
    given = docs.select(*keep, F.col(text_col).alias("__text"))
    fields = [kind[c] for c in columns or kind.names]
    places = [kind.names.index(f.name) for f in fields]
    schema = T.StructType([*given.schema.fields[:-1], *fields])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        find = getattr(Base(rows), of)
        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for part in parts(batch, batch.num_columns - 1):
                seen = [find(t or "") for t in part.column(part.num_columns - 1).to_pylist()]
                own = pa.array(np.repeat(np.arange(part.num_rows), [len(s) for s in seen]))
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(own) for i in range(part.num_columns - 1)], *[pa.array([x[i] for s in seen for x in s], k) for i, k in zip(places, kinds, strict=True)]], names=schema.names)

    return given.mapInArrow(run, schema)


def called(docs: DataFrame, rows: list[Definition] | None = None, *keep: str, text_col: str = "text") -> DataFrame:
    """Definitions that a document calls for: how many of its first tokens are among the definition's terms, how many of the
    definition's keywords and key phrases stand in it as whole words, how often its patterns match; ``relevant`` are those
    with a token or a match, whose spans :func:`detect` gives."""
    found = look(docs, rows, keep, text_col, "called", CALLED, ("entity_type", "token_score", "keywords", "pattern_hits"))
    return found.withColumn("relevant", (F.col("token_score") > 0) | (F.col("pattern_hits") > 0))


def detect(docs: DataFrame, rows: list[Definition] | None = None, *keep: str, text_col: str = "text") -> DataFrame:
    """Span rows of the relevant definitions: matches of their patterns (``rag``; confidence by sensitivity, a keyword within 50
    characters, and exact examples), and phrases near their keywords (``rag_context``, each once)."""
    return look(docs, rows, keep, text_col, "hits", HIT)


def pattern_spans(docs: DataFrame, rows: list[Definition] | None = None, *keep: str, text_col: str = "text", columns: tuple[str, ...] | None = None) -> DataFrame:
    """Of :func:`detect` the matches of patterns; phrases are not looked for."""
    return look(docs, rows, keep, text_col, "matches", HIT, columns or tuple(c for c in HIT.names if c != "source"))


def context_spans(docs: DataFrame, rows: list[Definition] | None = None, *keep: str, text_col: str = "text") -> DataFrame:
    return look(docs, rows, keep, text_col, "context", HIT, ("start_char", "end_char", "entity", "type", "confidence"))


def keyword_hits(docs: DataFrame, rows: list[Definition] | None = None, *keep: str, text_col: str = "text") -> DataFrame:
    """Definitions whose keywords or key phrases stand in a document, and how many of them."""
    return look(docs, rows, keep, text_col, "keywords_of", T.StructType([CALLED["entity_type"], CALLED["keywords"]]))


def coverage(docs: DataFrame, rows: list[Definition] | None = None, *keep: str, text_col: str = "text") -> DataFrame:
    """Per document and definition: the spans that :func:`detect` gives, and the intervals that their union consists of with
    the characters these cover.  Row-local: no shuffle."""
    return look(docs, rows, keep, text_col, "called", CALLED, ("entity_type", "spans", "intervals", "covered")).withColumnRenamed("entity_type", "type").filter("spans > 0")
