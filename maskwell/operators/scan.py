"""Detection in one pass: all patterns of a plan over a text at a time, scored, merged, filtered and ordered in the same Arrow batch.

This is the engine's main path.  Patterns that match almost every word make some hundred spans a kilobyte, so spans stay
numbers (start, end, pattern, confidence) until the batch's columns are built at once.  The pass is narrow, batches cut to
BATCH_BYTES of text.  It gives only what is asked for: :func:`scan` a row a text with its spans, what redaction needs of them, or
both; :func:`rows` a row a span.

A pattern runs on a text only where the text has what each of its matches needs: an ``@``, a colon, a run of digits of some
length, or the label it begins with.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions import plain
from ..plans.catalog import Pattern

BATCH_BYTES = 1 << 18

#: Digits in a row that every match of a type has.
RUNS = {"phone": 3, "ssn": 4, "pan": 4, "credit_card": 4, "bank_account": 8, "passport": 6, "drivers_license": 4, "iban": 7, "date": 4, "date_of_birth": 2, "address": 1, "gps_coordinates": 1}
LABEL = re.compile(r"\\b([A-Za-z]{2,}(?: [A-Za-z]+)*)(?![A-Za-z?*{+|])")


@dataclass(frozen=True)
class Need:
    """What a text must have before a pattern is tried on it."""

    run: int = 0  # digits in a row
    literal: str = ""
    label: str = ""  # in any case


def need(p: Pattern) -> Need:
    if p.detector in ("healthcare", "financial") and p.group and (m := LABEL.match(p.regex)):
        return Need(label=m[1].lower())
    if p.detector == "custom":
        return Need()
    if p.type == "email":
        return Need(literal="@")
    if p.type == "url":
        return Need(literal="://")
    if p.type == "ip_address":
        return Need(literal=":") if "fA-F" in p.regex else Need(run=1, literal=".")
    return Need(run=RUNS.get(p.type, 0)) if p.detector in ("enhanced", "rule_based", "simple") or p.type == "iban" else Need()


def folded(text: str) -> str:
    """``text`` as patterns that ignore case see it."""
    return text.lower() if text.isascii() else text.replace("İ", "i").casefold().replace("ı", "i")


class Scanner:
    """Compiled patterns; ``spans(text)`` gives parallel lists of starts, ends, patterns' numbers and confidences."""

    def __init__(self, patterns: list[Pattern]):
        self.rules = []
        for i, p in enumerate(patterns):
            valid = plain.BY_TYPE.get(p.type) if p.detector == "enhanced" else None
            keeps = plain.LEGACY_KEEPS.get(p.type) if p.detector == "rule_based" else None
            self.rules.append((i, re.compile(p.full).finditer, p.group, need(p), p.confidence, min(1.0, round(p.confidence * 1.2, 6)), round(p.confidence * 0.5, 6), valid, keeps, 2 if p.detector == "enhanced" else 0))
        self.labels = any(r[3].label for r in self.rules)

    def spans(self, text: str) -> tuple[list, list, list, list]:
        starts, ends, which, sure = [], [], [], []
        digits = max(map(len, re.findall(r"\d+", text)), default=0)
        low = folded(text) if self.labels else ""
        for i, find, group, want, base, up, down, valid, keeps, least in self.rules:
            if want.run > digits or want.literal not in text or want.label not in low:
                continue
            if valid is None and keeps is None:
                found = [m.span(group) for m in find(text)]
                if least:
                    found = [x for x in found if x[1] - x[0] >= least]
                starts += [x[0] for x in found]
                ends += [x[1] for x in found]
                which += [i] * len(found)
                sure += [base] * len(found)
                continue
            for m in find(text):
                a, b = m.span(group)
                if (keeps is None or keeps(text[a:b])) and b - a >= least:
                    starts.append(a)
                    ends.append(b)
                    which.append(i)
                    sure.append(base if valid is None else up if valid(text[a:b]) else down)
        return starts, ends, which, sure


def merged(starts: list, ends: list, sure: list, at: float) -> tuple[list, list, list, list, list]:
    """The ordered greedy merge of :func:`spans.fold` on numbers: starts, ends and confidences of what is left, the span that
    each takes its type and text from, and the spans it was made of."""
    out_start, out_end, out_sure, base, parts = [], [], [], [], []
    live: list[int] = []
    for i in sorted(range(len(starts)), key=starts.__getitem__):
        a, b, c = starts[i], ends[i], sure[i]
        live = [k for k in live if out_end[k] > a]
        for k in live:
            low, high = out_start[k], out_end[k]
            inter, hull = min(high, b) - max(low, a), max(high, b) - min(low, a)
            if inter > 0 and inter / hull >= at:
                n, m = high - low, b - a
                if out_sure[k] < c:
                    base[k] = i
                out_sure[k] = min(1.0, (out_sure[k] * n + c * m) / (n + m))
                out_start[k], out_end[k] = min(low, a), max(high, b)
                parts[k].append(i)
                break
        else:
            live.append(len(base))
            out_start.append(a)
            out_end.append(b)
            out_sure.append(c)
            base.append(i)
            parts.append([i])
    return out_start, out_end, out_sure, base, parts


OWN = T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
#: Parts of a cut: the spans that stay and the text around them, or how many of each type stay.
CUT = {"own": T.ArrayType(OWN), "gaps": T.ArrayType(T.StringType()), "types": T.ArrayType(T.StringType()), "counts": T.ArrayType(T.LongType())}


def resolved(starts: list, ends: list) -> list:
    """Of spans that overlap, in order of start, the first and longest stays: their places in the lists."""
    own, at = [], 0
    for i in sorted(range(len(starts)), key=lambda i: (starts[i], -ends[i])):
        if starts[i] >= at:
            own.append(i)
            at = ends[i]
    return own


class Spans:
    """Spans of a batch of texts as parallel lists, ``sizes[i]`` of them before text i."""

    def __init__(self, patterns: list[Pattern], merge_at: float | None, least: float | None, window: int | None, cut: tuple[str, ...] = ()):
        import pyarrow as pa

        self.scanner, self.merge_at, self.least, self.window, self.cut = Scanner(patterns), merge_at, least, window, cut
        self.sources = [p.detector for p in patterns]
        self.names = {f: pa.array([getattr(p, f) for p in patterns], pa.string()) for f in ("type", "space", "subtype")} | {"source": pa.array(self.sources, pa.string())}
        self.types = [p.type for p in patterns]

    def read(self, texts: list) -> Spans:
        self.sizes, self.starts, self.ends, self.which, self.sure, self.words, self.joined, self.around = [0], [], [], [], [], [], [], []
        self.kept: dict[str, list] = {name: [] for name in self.cut}
        sources = self.sources
        for text in texts:
            a, b, w, c = self.scanner.spans(text or "")
            if self.merge_at is None:
                own, made = range(len(a)), None
                words = [text[x:y] for x, y in zip(a, b, strict=True)]
            else:
                a0, b0, w0 = a, b, w
                a, b, c, base, made = merged(a, b, c, self.merge_at)
                w, own = [w0[i] for i in base], range(len(a))
                words = [text[a0[i] : b0[i]] for i in base]
            if self.least is not None:
                own = sorted((i for i in own if c[i] >= self.least), key=lambda i: -c[i])  # noqa: B023
            starts, ends, which = [a[i] for i in own], [b[i] for i in own], [w[i] for i in own]
            self.sizes.append(self.sizes[-1] + len(own))
            self.starts += starts
            self.ends += ends
            self.which += which
            self.sure += [c[i] for i in own]
            own_words = [words[i] for i in own]
            self.words += own_words
            if self.window is not None:
                self.around += [text[max(0, x - self.window) : y + self.window] for x, y in zip(starts, ends, strict=True)]
            if made is not None:
                self.joined += [sources[w0[made[i][0]]] if len(made[i]) == 1 else "+".join(sources[w0[j]] for j in made[i]) for i in own]
            if self.cut:
                self._resolve(text, starts, ends, which, own_words)
        return self

    def _resolve(self, text, starts, ends, which, words) -> None:
        stay = resolved(starts, ends)
        if "own" in self.kept:
            self.kept["own"].append([(which[i], words[i]) for i in stay])
        if "gaps" in self.kept:
            at = [0, *[ends[i] for i in stay]]
            self.kept["gaps"].append([None] if text is None else [text[x:y] for x, y in zip(at, [*[starts[i] for i in stay], None], strict=True)])
        if "counts" in self.kept:
            n: dict[str, int] = {}
            for i in stay:
                n[self.types[which[i]]] = n.get(self.types[which[i]], 0) + 1
            self.kept["types"].append(list(n))
            self.kept["counts"].append(list(n.values()))

    def column(self, name: str):
        import numpy as np
        import pyarrow as pa

        if name in ("type", "space", "subtype") or (name == "source" and self.merge_at is None):
            return self.names[name].take(pa.array(np.array(self.which, np.int64)))
        if name in ("start", "end"):
            return pa.array(np.array(self.starts if name == "start" else self.ends, np.int32))
        if name == "confidence":
            return pa.array(np.array(self.sure, float))
        return pa.array({"source": self.joined, "text": self.words, "around": self.around}[name], pa.string())

    def pieces(self, name: str):
        """A part of the cut, as lists."""
        import numpy as np
        import pyarrow as pa

        lists = self.kept[name]
        sizes = pa.array(np.cumsum([0, *map(len, lists)]), pa.int32())
        flat = [x for own in lists for x in own]
        if name == "own":
            types = self.names["type"].take(pa.array(np.array([x[0] for x in flat], np.int64)))
            return pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays([types, pa.array([x[1] for x in flat], pa.string())], names=OWN.names))
        return pa.ListArray.from_arrays(sizes, pa.array(flat, pa.int64() if name == "counts" else pa.string()))


def parts(batch, text_at: int):
    """Pieces of the batch with some BATCH_BYTES of text."""
    import pyarrow.compute as pc

    sizes, a, held = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist(), 0, 0
    for b, size in enumerate(sizes, 1):
        held += size
        if held >= BATCH_BYTES or b == len(sizes):
            yield batch.slice(a, b - a)
            a, held = b, 0


def scan(df: DataFrame, patterns: list[Pattern], span_type: T.StructType, text_col: str = "text", out_col: str | None = "spans", merge_at: float | None = None, least: float | None = None, around_col: str | None = None, window: int = 50, cut_col: str | None = None, cut: tuple[str, ...] = tuple(CUT)) -> DataFrame:
    """``df`` with array<span> ``out_col``: in order of pattern, then place; merged if ``merge_at`` is given; with ``least``
    only spans of that confidence, the surest first.  A null text has no spans.  ``around_col`` is an array of the spans'
    contexts, each the span with ``window`` characters on either side, so that what follows need not carry the text.  ``cut_col``
    is a struct of what redaction needs (see CUT); with it the text is left out, and without ``out_col`` the spans are."""
    cut = cut if cut_col else ()
    kept = [f for f in df.schema.fields if f.name not in (out_col, around_col, cut_col) and not (f.name == text_col and cut_col and not out_col)]
    more = [T.StructField(out_col, T.ArrayType(span_type))] if out_col else []
    more += [T.StructField(around_col, T.ArrayType(T.StringType()))] if around_col else []
    more += [T.StructField(cut_col, T.StructType([T.StructField(n, CUT[n]) for n in cut]))] if cut_col else []
    schema = T.StructType([*kept, *more])
    names = schema.names

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in more]
        spans = Spans(patterns, merge_at, least, window if around_col else None, cut)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in parts(batch, at):
                found, new = spans.read(part.column(at).to_pylist()), []
                sizes = pa.array(found.sizes, pa.int32())
                if out_col:
                    new.append(pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays([found.column(n) for n in span_type.names], names=span_type.names)))
                if around_col:
                    new.append(pa.ListArray.from_arrays(sizes, found.column("around")))
                if cut_col:
                    new.append(pa.StructArray.from_arrays([found.pieces(n) for n in cut], names=list(cut)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(f.name)) for f in kept], *[c.cast(k) for c, k in zip(new, kinds, strict=True)]], names=names)

    return df.mapInArrow(run, schema)


#: Columns of span rows by the fields of a span.
ROW = {"start": "start_char", "end": "end_char", "type": "type", "space": "space", "source": "source", "confidence": "confidence", "text": "entity", "subtype": "subtype", "around": "context"}


def rows(df: DataFrame, patterns: list[Pattern], span_type: T.StructType, *keep: str, columns: tuple[str, ...], text_col: str = "text", merge_at: float | None = None, least: float | None = None, window: int = 50) -> DataFrame:
    """A row a span, in order, with the columns of ``df`` to keep and those of ROW that are asked for.  Spans are no arrays on the
    way: an array of some hundred spans a kilobyte is some twenty times its text."""
    field_of = {c: f for f, c in ROW.items()}
    kinds = {f.name: f.dataType for f in span_type.fields} | {"around": T.StringType()}
    schema = T.StructType([*[df.schema[k] for k in keep], *[T.StructField(c, kinds[field_of[c]]) for c in columns]])
    names = schema.names

    def run(batches):
        import numpy as np
        import pyarrow as pa

        spans = Spans(patterns, merge_at, least, window if "context" in columns else None)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for part in parts(batch, at):
                found = spans.read(part.column(at).to_pylist())
                of = pa.array(np.repeat(np.arange(part.num_rows), np.diff(found.sizes)))
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(k)).take(of) for k in keep], *[found.column(field_of[c]) for c in columns]], names=names)

    return df.select(*dict.fromkeys((*keep, text_col))).mapInArrow(run, schema)
